"""Compare a registered query with its SQL: names, row counts and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, build, sql, sf_dir):
    """None when equal, else a description of the difference."""
    got = build(spark, sf_dir)
    arrow = got.toArrow()
    have = _rows(got.columns, zip(*[c.to_pylist() for c in arrow.columns]) if arrow.num_columns else [])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(names)}", len(have)
    want = _rows(names, cursor.fetchall())
    if have != want:
        extra = sorted(set(have) - set(want))[:3]
        missing = sorted(set(want) - set(have))[:3]
        return f"{len(have)} rows vs {len(want)}; only ours {extra}; only SQL {missing}", len(have)
    return None, len(have)


def main():
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    pick = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = e.oracle_sql()
    for name, build in e.queries().items():
        if pick and not any(p in name for p in pick):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff, n = compare(spark, con, build, oracles[name], sf)
            else:
                diff, n = None, build(spark, sf).count()
        except Exception as x:  # noqa: BLE001
            diff, n = f"{type(x).__name__}: {str(x)[:1500]}", -1
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} rows={n} {time.time() - t:.1f}s {diff or ''}", flush=True)


if __name__ == "__main__":
    main()
