"""Compare every registered query with its SQL on the same tables.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def database(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(table) -> Counter:
    """Multiset of rows with columns in name order."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return Counter(tuple(canonical(v) for v in row) for row in zip(*columns))


def kind(arrow_type) -> str:
    text = str(arrow_type).replace("large_", "")
    return {"decimal128(38, 0)": "huge"}.get(text, text)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty if they agree."""
    left, right = df.toArrow(), con.sql(sql).to_arrow_table()
    problems = []
    if sorted(left.column_names) != sorted(right.column_names):
        return [f"columns {sorted(left.column_names)} != {sorted(right.column_names)}"]
    for n in left.column_names:
        a, b = kind(left.schema.field(n).type), kind(right.schema.field(n).type)
        if a != b:
            problems.append(f"type of {n}: {a} != {b}")
    a, b = rows_of(left), rows_of(right)
    if a != b:
        problems.append(f"rows {sum(a.values())} vs {sum(b.values())}; only left "
                        f"{list((a - b).items())[:2]}; only right {list((b - a).items())[:2]}")
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = database(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problems = compare(fn(spark, sf), con, sqls[name]) if name in sqls else ["no SQL"]
        except Exception as error:  # report and go on
            problems = [str(error)[:700]]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", *problems, sep="\n    "
              if problems else " ", flush=True)
    print("differing:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
