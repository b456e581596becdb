"""Properties over the corpus rendered from the driver's sf0.001 tables."""
from pyspark.sql import functions as F

from chatlake.plans import pipeline
from chatlake.plans.corpus import corpus_tables
from chatlake.sources.synth import CORPUS_PRICES, corpus_files, corpus_lines

SF = "/root/testdata/sf0.001"


def test_model_usage_sums_to_session_totals(spark):
    t = corpus_tables(spark, SF)
    cols = ["total_input_tokens", "total_output_tokens", "total_cache_creation_tokens",
            "total_cache_read_tokens"]
    mu = t["model_usage"].agg(*[F.sum(c).alias(c) for c in cols]).first()
    se = t["sessions"].agg(*[F.sum(c).alias(c) for c in cols]).first()
    assert mu.asDict() == se.asDict()
    per_session = (t["model_usage"].groupBy("session_id").agg(F.sum("message_count").alias("n"))
                   .join(t["sessions"].select("session_id", "assistant_message_count"), "session_id"))
    # every assistant message of the corpus with a model carries usage
    assert per_session.filter(F.col("n") > F.col("assistant_message_count")).count() == 0


def test_tool_calls_and_counts_agree(spark):
    t = corpus_tables(spark, SF)
    uses = t["sessions"].agg(F.sum("tool_call_count")).first()[0]
    assert t["tool_calls"].count() == uses          # corpus ids are unique and named
    seq = t["messages"].groupBy("session_id").agg(F.max("sequence_number").alias("m"), F.count("*").alias("n"))
    assert seq.filter(F.col("m") != F.col("n") - 1).count() == 0


def test_full_run_twice_gives_same_views(spark, tmpdir_path):
    def build(root):
        src = pipeline.LinesSource(corpus_lines(spark, SF), corpus_files(spark, SF))
        pipeline.run(spark, src, root, mode="full", prices=CORPUS_PRICES)
        v = pipeline.TableRoot(spark, root).views()
        return {name: sorted(map(str, v[name].drop("extracted_at").collect()))
                for name in ("sessions", "messages", "tool_calls", "files_referenced", "model_usage")}
    assert build(f"{tmpdir_path}/a") == build(f"{tmpdir_path}/b")


def test_plans_have_no_python_udfs(spark):
    """§5 plan check: every table and report stays in the JVM (no Python
    evaluation nodes anywhere in the physical plans)."""
    from chatlake.plans import reports as R
    t = corpus_tables(spark, SF)
    dfs = [t[n] for n in ("sessions", "messages", "tool_calls", "command_invocations",
                          "files_referenced", "model_usage", "cowork_sessions")]
    dfs += [R.r13_cost_by_project(t), R.r14_tool_ranking(t), R.r16_daily_summary(t, "2024-01-30", 7)]
    for df in dfs:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "PythonUDF" not in plan and "MapInPandas" not in plan
