"""Arrays cut at every border against Python's own reader."""

import json
import random

import pytest

from tablewise.sources.json_arrays import read_split_array

SCHEMA = "id int, text string, inner struct<a:array<int>,b:string>"


def records(n, seed=1):
    rng = random.Random(seed)
    odd = ['"', "\\", "}", "{", "]", "[", "}{", '\\"', "\\\\", "é", "\n", ",", "x" * 40, '"}', "},{", " "]
    return [
        {"id": k, "text": "".join(rng.choices(odd, k=rng.randint(0, 12))), "inner": {"a": [1] * rng.randint(0, 3), "b": rng.choice(odd)}}
        for k in range(n)
    ]


@pytest.mark.parametrize("width, indent", [(64, None), (1 << 20, 2)])
def test_one_file_over_many_ranges(spark, tmp_path, width, indent):
    want = records(25)
    (tmp_path / "a.json").write_text(json.dumps(want, ensure_ascii=False, indent=indent), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows, rejects = read_split_array(spark, str(tmp_path / "a.json"), SCHEMA)
        got = sorted((r.asDict(recursive=True) for r in rows.collect()), key=lambda r: r["id"])
        parts = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
        assert rejects.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == want and (parts > 20 or width > 64)


def test_several_files_and_broken_ones(spark, tmp_path):
    texts = {
        "a": json.dumps(records(5)) + "\n",
        "b": "[]",
        "c": "",
        "d": ' [ {"id": 100} , {"id": 101, "text": "}"}\n]\n',
        "e": '[{"id": 200}, {"id": 201, "text": "open',
        "f": '[{"id": 300}, 7, {"id": 301}, {"id": "no number"}]',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, rejects = read_split_array(spark, str(tmp_path), SCHEMA)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4, 100, 101, 200, 300]
    left = sorted(r.value for r in rejects.collect())
    assert len(left) == 3 and left[0].startswith("7, {") and "no number" in left[1] and "open" in left[2]
