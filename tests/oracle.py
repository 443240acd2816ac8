"""Runs registered queries beside their SQL on one scale factor: python tests/oracle.py SF [NAME...]"""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(clean, v)) if isinstance(v, (list, tuple)) else v


def oracle_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(spark, sf_dir: str, name: str) -> str:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    names, rows = oracle_rows(sf_dir, entry.oracle_sql()[name])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(clean(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    b = sorted((tuple(clean(r[i]) for i in at) for r in rows), key=repr)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {wrong}"
    if [type(x) for x in a[0]] != [type(x) for x in b[0]] if a else False:
        return f"types {a[0]} {b[0]}"
    return "" if a else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:] or sorted(entry.oracle_sql()):
        t = time.time()
        try:
            said = compare(spark, f"/root/testdata/{sys.argv[1]}", n)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{n:28} {time.time() - t:5.1f} s  {said or 'ok'}", flush=True)
