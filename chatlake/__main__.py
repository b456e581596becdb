"""Command line: ``python -m chatlake <extract|stats|report|compact> …`` (or spark-submit).

A thin front over the library: every command builds DataFrames and shows or
writes them; the cluster settings come from the Spark session.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import json
import sys

from pyspark.sql import SparkSession

from .config import load_config
from .functions.pricing import merge_prices
from .plans import pipeline, reports as R
from .plans.partials import refresh
from .plans.tiers import FANOUT, compact_tiers
from .plans.sqlsurface import run_sql
from .session import apply_engine_conf
from .sources.export import export_csv


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("chatlake").getOrCreate()
    apply_engine_conf(spark)
    return spark


def _print(df) -> None:
    """Every row, tab-separated, a partition of them at a time on the driver."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="chatlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ex = sub.add_parser("extract", help="extract new and changed transcripts (I1) or rebuild (--full)")
    ex.add_argument("--root", required=True)
    ex.add_argument("--claude-dir")
    ex.add_argument("--cowork-dir")
    ex.add_argument("--full", action="store_true")
    ex.add_argument("--code-only", action="store_true")
    ex.add_argument("--cowork-only", action="store_true")
    ex.add_argument("--on-error", choices=["line", "file"], default="line")
    ex.add_argument("--prices", help="JSON object: model -> {input, output, cache_read, cache_create}")
    ex.add_argument("--config", help="YAML config with sources and pricing")
    st = sub.add_parser("stats", help="the statistics block (R1-R11)")
    st.add_argument("--root", required=True)
    rp = sub.add_parser("report", help="a canned report or free SQL over the tables")
    rp.add_argument("--root", required=True)
    g = rp.add_mutually_exclusive_group(required=True)
    g.add_argument("--today", action="store_true")
    g.add_argument("--costs", action="store_true")
    g.add_argument("--tools", action="store_true")
    g.add_argument("--models", action="store_true")
    g.add_argument("--sessions", type=int, metavar="DAYS")
    g.add_argument("--sql")
    rp.add_argument("--as-of", default=_dt.date.today().isoformat())
    rp.add_argument("--export", help="write the result as CSV to this folder")
    rp.add_argument("--single-file", action="store_true", help="export a small report as one file, by one task")
    cp = sub.add_parser("compact", help="rewrite the current views as one batch")
    cp.add_argument("--root", required=True)
    cp.add_argument("--tiers", action="store_true", help="merge only neighbouring batches of like size")
    cp.add_argument("--fanout", type=int, default=FANOUT, help="batches of one size that become one (with --tiers)")
    rf = sub.add_parser("refresh", help="bring the sums for stored reports up to the current views")
    rf.add_argument("--root", required=True)
    a = ap.parse_args(argv)

    spark = _spark()
    if a.cmd == "extract":
        cfg = load_config(a.config) if a.config else {}
        src = pipeline.DiskSource(a.claude_dir or cfg.get("claude_dir"), a.cowork_dir or cfg.get("cowork_dir"),
                                  a.code_only, a.cowork_only)
        prices = merge_prices(json.loads(a.prices)) if a.prices else cfg.get("prices")
        res = pipeline.run(spark, src, a.root, mode="full" if a.full else "incremental",
                           prices=prices, on_error=a.on_error)
        print(json.dumps({"batch_id": res.batch_id, "files": res.files_extracted, **res.summary},
                         default=str))
    elif a.cmd == "stats":
        t = pipeline.TableRoot(spark, a.root).views()
        for name, df in R.stats(t).items():
            print(f"== {name}")
            _print(df)
    elif a.cmd == "report":
        t = pipeline.TableRoot(spark, a.root).views()
        if a.today:
            df = R.r12_today(t, a.as_of)
        elif a.costs:
            df = R.r13_cost_by_project(t)
        elif a.tools:
            df = R.r14_tool_ranking(t)
        elif a.models:
            df = R.r15_model_breakdown(t)
        elif a.sessions is not None:
            df = R.r16_daily_summary(t, a.as_of, a.sessions)
        else:
            df = run_sql(spark, t, a.sql)
        if a.export:
            print("exported" if export_csv(df, a.export, single_file=a.single_file) else "no rows, nothing written")
        else:
            _print(df)
    elif a.cmd == "compact" and a.tiers:
        for batch, inputs, n in compact_tiers(spark, a.root, fanout=a.fanout):
            print(f"{batch}\t{len(inputs)} batches\t{n} bytes")
    elif a.cmd == "compact":
        print(pipeline.compact(spark, a.root))
    elif a.cmd == "refresh":
        print(refresh(spark, a.root) or "nothing has changed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
