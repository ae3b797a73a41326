from tablewise import schemas
from tablewise.streaming import reviews as store


def test_a_batch_with_lists_reads_the_run_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    base = spark.createDataFrame([("u", "a", 5, 1), ("u", "b", 4, 1), ("v", "a", 3, 1)], "user_id string, gmap_id string, rating int, time bigint")
    store.init_store(base, root, parts=2, slices=1)
    centroids = spark.createDataFrame([(0, "a", 5.0), (1, "b", 1.0)], "cluster_id int, gmap_id string, value double")
    lists = spark.createDataFrame(
        [(c, [(i, 1.0) for i in "abx"]) for c in range(2)], "cluster_id int, recommendations array<struct<gmap_id:string,score:double>>"
    )
    batch = spark.createDataFrame([("add", "u", "x", "5", 2, 1), ("delete", "v", "a", None, 2, 2)], schemas.REVIEW_CHANGES)
    readers, stored = [], store.stored

    def noted(df, label):
        if any("/reviews/run_id=" in f for f in df.inputFiles()):
            readers.append(label)
        return stored(df, label)

    monkeypatch.setattr(store, "stored", noted)
    store.apply_batch(batch, 0, root, store.Model(centroids, lists, 2))
    assert readers == ["touched"]
    got = {r.user_id: (r.cold, [x.gmap_id for x in r.recommendations]) for r in spark.read.parquet(f"{root}/recommendations/batch_id=0").collect()}
    assert got == {"u": (False, []), "v": (True, [])}
