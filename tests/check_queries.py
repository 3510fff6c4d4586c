"""Run named queries against their SQL and print the result of each.

Usage: python tests/check_queries.py [folder] [name ...]
"""

import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from comparing import connect, differences  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            problems = differences(df, con, oracles[name]) if name in oracles else []
            note = "" if name in oracles else f"(no SQL) {df.count()} rows"
        except Exception as error:
            problems, note = [str(error)[:600]], ""
            if wanted:
                traceback.print_exc()
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s {note}", flush=True)
        for p in problems:
            print("     ", p)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
