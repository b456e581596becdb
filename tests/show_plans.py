"""Print the physical operator trees of the tables and some reports (for review).

Usage: python tests/show_plans.py [sf_dir]  (writes nothing; prints to stdout)
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatlake.plans import reports as R  # noqa: E402
from chatlake.plans.corpus import corpus_tables  # noqa: E402
from chatlake.session import local_session  # noqa: E402

KEEP = re.compile(r"(Exchange|Aggregate|Join|Window|Scan parquet|BroadcastExchange|TakeOrdered|Sort\b|Generate|Union)")


def tree(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            out.append(line[:160])
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # show the at-scale shape
    t = corpus_tables(spark, sf)
    items = {n: t[n] for n in ("sessions", "messages", "tool_calls", "command_invocations",
                               "files_referenced", "model_usage")}
    items["r13_cost_by_project"] = R.r13_cost_by_project(t)
    items["r9_top_tools"] = R.r9_top_tools(t)
    for name, df in items.items():
        print(f"### {name}\n```\n{tree(df)}\n```\n")


if __name__ == "__main__":
    main()
