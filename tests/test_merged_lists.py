import datetime
import re

import __spark_entry__ as entry


def test_lists_are_dealt_by_user_once(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    orders = spark.createDataFrame([(o, o % 3) for o in range(6)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame(
        [(o, i, 10.0 * i + 5, day) for o in range(6) for i in range(3)],
        "l_orderkey long, l_partkey long, l_quantity double, l_shipdate timestamp_ntz",
    )
    events = spark.createDataFrame([(1, "view", day, "{}")] * 2, "user_id long, event_type string, ts timestamp_ntz, props string")
    for name, rows in (("orders", orders), ("lineitem", lines), ("events", events)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    merged = entry.queries()["merged_recommendations"](spark, str(tmp_path))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(user_id#\d+, gmap_id#\d+", plan)
    got = {(r.user_id, r.gmap_id): r.score for r in merged.collect()}
    assert got == {(str(u), str(i)): (i + 1.0) * (-1 if u == 1 else 1) for u in range(3) for i in range(3)}
