"""Runs registered queries beside their DuckDB SQL: python tests/compare.py SF_DIR [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    clean = lambda x: "null" if x is None or str(x) in ("<NA>", "nan", "NaT") else repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__.startswith(("int", "float")) else str(x)
    return sorted("|".join(clean(x) for x in row) for row in frame.astype(object).itertuples(index=False, name=None))


def compare(spark, name: str, sf_dir: str) -> tuple[bool, str]:
    import __spark_entry__ as e

    began = time.time()
    out = e.queries()[name](spark, sf_dir)
    got = out.toPandas()
    took = time.time() - began
    sql = e.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    want = oracle(sf_dir).sql(sql).df()
    if sorted(want.columns) != sorted(got.columns):
        return False, f"{name}: columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    first = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), "")
    return a == b and bool(a), f"{name}: {len(a)} rows, {len(b)} by SQL, {took:.1f} s {first if a != b else ''}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tapeqc.plans import catalog

    for name in sys.argv[2:] or catalog.QUERIES:
        try:
            good, said = compare(spark, name, sys.argv[1])
        except Exception as x:
            good, said = False, f"{name}: {type(x).__name__} {str(x)[:300]}"
        print("ok  " if good else "FAIL", said, flush=True)
