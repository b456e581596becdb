"""Local stand-in for the driver's correctness gate: Spark vs DuckDB oracle.

Usage: python tests/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of values.
"""
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    if os.environ.get("PLAIN_SESSION"):
        # Mimic a caller's session: defaults only, no checkpoint folder set.
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                 .getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        from chatlake.session import local_session
        spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        dt = time.time() - t0
        if name not in os_:
            print(f"{name:34s} rows={len(srows):6d} (no oracle) {dt:.1f}s")
            continue
        rel = con.execute(os_[name])
        ocols = [d[0] for d in rel.description]
        orows = rel.fetchall()
        sh, sl = digest(scols, srows)
        oh, ol = digest(ocols, orows)
        ok = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and sh == oh
        bad += not ok
        print(f"{name:34s} rows={len(srows):6d}/{len(orows):6d} {'OK ' if ok else 'BAD'} {dt:.1f}s")
        if not ok:
            if sorted(scols) != sorted(ocols):
                print("   cols spark:", sorted(scols), "\n   cols duck: ", sorted(ocols))
            d1 = [x for x in sl if x not in set(ol)][:3]
            d2 = [x for x in ol if x not in set(sl)][:3]
            for x in d1:
                print("   spark-only:", x[:400])
            for x in d2:
                print("   duck-only: ", x[:400])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
