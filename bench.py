"""Benchmark: full extraction, a no-change incremental run, and the reports.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1): the
driver's ``conversations`` and ``events`` tables are rendered as transcript
lines, extracted by the pipeline into a table root (bronze + 8 tables +
manifest), then every report R1-R24 runs over the current views. Prints one
JSON line; ``value`` is the end-to-end wall time in seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatlake.plans import pipeline, reports as R  # noqa: E402
from chatlake.session import local_session  # noqa: E402
from chatlake.sources.synth import CORPUS_PRICES, corpus_files, corpus_lines  # noqa: E402

REPORTS = {
    "r1": R.r1_session_count, "r2": R.r2_sessions_by_source, "r3": R.r3_agent_session_count,
    "r4": R.r4_table_counts, "r5": R.r5_unique_files, "r6": R.r6_token_totals,
    "r7": R.r7_model_usage, "r8": R.r8_top_commands, "r9": R.r9_top_tools,
    "r10": R.r10_sessions_by_project, "r11": R.r11_latest_cowork,
    "r12": lambda t: R.r12_today(t, "2024-01-15"), "r13": R.r13_cost_by_project,
    "r14": R.r14_tool_ranking, "r15": R.r15_model_breakdown,
    "r16": lambda t: R.r16_daily_summary(t, "2024-01-30", 7), "r17": R.r17_sessions_by_day,
    "r18": R.r18_most_expensive, "r19": R.r19_tool_error_rates, "r20": R.r20_command_usage,
    "r21": R.r21_cache_by_model, "r22": R.r22_most_edited, "r23": R.r23_projects_by_sessions,
    "r24": R.r24_latest_sessions,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    scratch = tempfile.mkdtemp(prefix="chatlake-bench-")
    spark = local_session(cpus, shuffle_partitions=max(cpus, 4),
                          extra={"spark.checkpoint.dir": f"{scratch}/ckpt",
                                 "spark.driver.memory": "16g"})
    root = f"{scratch}/tables"
    times: dict[str, float] = {}
    t_all = time.time()

    t0 = time.time()
    src = pipeline.LinesSource(corpus_lines(spark, sf_dir), corpus_files(spark, sf_dir))
    steps: dict[str, float] = {}
    res = pipeline.run(spark, src, root, mode="full", prices=CORPUS_PRICES, timings=steps)
    times["full_build"] = time.time() - t0

    t0 = time.time()
    res2 = pipeline.run(spark, pipeline.LinesSource(corpus_lines(spark, sf_dir), corpus_files(spark, sf_dir)),
                        root, mode="incremental", prices=CORPUS_PRICES)
    times["incremental_noop"] = time.time() - t0

    # 1% of the files "changed" on disk (their listed size differs from the
    # manifest): the incremental run re-reads exactly those files, whole.
    from pyspark.sql import functions as F
    files = corpus_files(spark, sf_dir).withColumn(
        "file_size", F.when(F.pmod(F.hash("session_id"), F.lit(100)) == 0, F.lit(1)).cast("long"))
    t0 = time.time()
    res3 = pipeline.run(spark, pipeline.LinesSource(corpus_lines(spark, sf_dir), files),
                        root, mode="incremental", prices=CORPUS_PRICES)
    times["incremental_1pct"] = time.time() - t0

    views = pipeline.TableRoot(spark, root).views()
    for name, fn in REPORTS.items():
        runs = []
        for _ in range(reps):
            t0 = time.time()
            fn(views).collect()
            runs.append(time.time() - t0)
        times[name] = statistics.median(runs)
    total = time.time() - t_all
    sessions = res.summary.get("sessions", 0)
    out = {
        "metric": "end_to_end_sec", "value": round(total, 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": sf_dir.rstrip("/").split("sf")[-1],
        "sessions": sessions, "messages": res.summary.get("messages"),
        "sessions_per_sec_full_build": round(sessions / times["full_build"], 1) if times["full_build"] else None,
        "incremental_files_changed": res2.files_extracted,
        "incremental_1pct_files": res3.files_extracted,
        "cpus": cpus,
        "full_build_steps": steps,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
