"""Run registered queries next to their SQL: python tests/compare.py [sf] [prefix ...]"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def session(cpus=8):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").appName("sitemosaic-tests").config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.local.dir", os.environ.get("SPARK_SCRATCH", "/tmp")).getOrCreate())


def duck(d):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return ("n",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", v, math.copysign(1, v))
    if isinstance(v, int):
        return ("i", v)
    return (type(v).__name__, str(v))


def rows(records, order):
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def compare(df, con, sql):
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    cols = sorted(names)
    g, w = rows(got, [df.columns.index(c) for c in cols]), rows(want, [names.index(c) for c in cols])
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    return None if not bad else f"{len(bad)} of {len(g)} rows differ, e.g. {cols} {bad[0][0]} vs {bad[0][1]}"


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    d = f"/root/testdata/sf{sf}"
    from sitemosaic.catalog import ORACLES, QUERIES
    spark, con, fails = session(), duck(d), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in QUERIES.items():
        if args and not any(name == a or name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, d)
            err = compare(df, con, ORACLES[name]) if name in ORACLES else (None if df.count() > 0 else "no rows")
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:1500]}"
        fails += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {name} {time.time() - t:.1f}s {'' if name in ORACLES else '(rows only)'} {err or ''}", flush=True)
    print("failures", fails)


if __name__ == "__main__":
    main()
