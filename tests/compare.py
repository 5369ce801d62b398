"""Compare registered queries with their SQL on DuckDB. Also a script: ``python tests/compare.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").appName("latentlake").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple("\0" if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(row[i] for i in at) for row in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got.sort(key=_key), want.sort(key=_key)
    bad = []
    for a, b in zip(got, want):
        for c, x, y in zip(cols, a, b):
            same = abs(x - y) <= 1.5e-6 * max(1, abs(y)) or (x != x and y != y) if isinstance(x, float) and isinstance(y, (int, float)) else x == y
            if not same:
                bad.append((c, a, b))
                break
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    exact = sum(repr(a) == repr(tuple(float(v) if isinstance(u, float) else v for u, v in zip(a, b))) for a, b in zip(got, want))
    return None if exact == len(got) else f"CLOSE: {len(got) - exact} of {len(got)} rows equal only within 1e-6"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark, con, bad = session(), database(sf), 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            sql = oracle_sql().get(name)
            said = compare(df, con, sql) if sql else f"rows={len(df.collect())} (no SQL)"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:600].replace("\n", " ")
        bad += said is not None and "no SQL" not in said
        print(f"{name:32s} {time.time() - t:6.2f}s {said or 'ok'}", flush=True)
    print("problems:", bad)
    os._exit(bad > 0)
