"""Run queries against their SQL on the same tables and compare all values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else (int(x) if x == int(x) else x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a description."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return None
    diff = next(((g, w) for g, w in zip(got, want) if g != w), None)
    extra, lacking = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
    return (f"{len(got)} / {len(want)} rows, {len(extra)} only here, {len(lacking)} only in SQL\n   "
            + "\n   ".join(sorted(extra)[:2]) + "\n   --\n   " + "\n   ".join(sorted(lacking)[:2])) if diff or extra or lacking else "order"


def main(names, sf_dir):
    from pyspark.sql import SparkSession

    from workload.queries import ORACLES, QUERIES

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names or QUERIES:
        t = time.time()
        try:
            if n in ORACLES:
                problem = compare(spark, con, QUERIES[n], ORACLES[n], sf_dir)
            else:
                problem = None
                print(n, "rows", QUERIES[n](spark, sf_dir).count())
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'OK ' if problem is None else 'BAD'} {n} {time.time() - t:.1f}s {problem or ''}"[:2500], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[2:], sys.argv[1])
