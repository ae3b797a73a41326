"""Run registered queries against their SQL: python tests/run_oracles.py [folder] [name ...]"""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main(folder="/root/testdata/sf0.01", *names):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tablewise-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            out = difference(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # report and go on to the next query
            out = f"{type(e).__name__}: {str(e)[:600]}"
        bad += out is not None and not out.startswith("rows only")
        print(f"{time.time() - start:6.1f}s {name}: {out or 'same'}", flush=True)
    print("different:", bad)


main(*sys.argv[1:])
