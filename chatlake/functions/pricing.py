"""The price table and session cost.

Prices are USD per million tokens. A session is priced at its primary
model's rates for all of its tokens (quirk Q1); a model missing from the
table uses the fallback rates. A price row named ``default`` is ignored,
as the reference ignores it (Q5): pass ``fallback=`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default price table (model -> input, output, cache_read,
# cache_create), and the fallback rates for any other model.
DEFAULT_PRICES = {
    "claude-opus-4-6":            (15.00, 75.00, 1.50, 18.75),
    "claude-opus-4-5-20250620":   (15.00, 75.00, 1.50, 18.75),
    "claude-sonnet-4-5-20250929": (3.00, 15.00, 0.30, 3.75),
    "claude-sonnet-4-6":          (3.00, 15.00, 0.30, 3.75),
    "claude-haiku-4-5-20251001":  (0.80, 4.00, 0.08, 1.00),
}
FALLBACK_PRICE = (3.00, 15.00, 0.30, 3.75)

PRICE_COLS = ["price_input", "price_output", "price_cache_read", "price_cache_create"]
# A price table is configuration typed in by people; this bound is what
# makes broadcasting it safe.
MAX_PRICE_ROWS = 10000


def merge_prices(user_prices: dict | None = None, base: dict | None = None) -> dict:
    """Defaults overlaid with user rows; a user ``default`` row is skipped."""
    out = dict(DEFAULT_PRICES if base is None else base)
    for model, p in (user_prices or {}).items():
        if model == "default":
            continue
        if isinstance(p, dict):
            p = (p["input"], p["output"], p["cache_read"], p["cache_create"])
        out[model] = tuple(float(x) for x in p)
    return out


def price_table(spark: SparkSession, prices: dict | None = None) -> DataFrame:
    prices = DEFAULT_PRICES if prices is None else prices
    rows = [(m, *[float(x) for x in p]) for m, p in prices.items()]
    schema = "price_model string, " + ", ".join(f"{c} double" for c in PRICE_COLS)
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= MAX_PRICE_ROWS else out


def attach_prices(sessions: DataFrame, prices: DataFrame, model_col: str = "model",
                  fallback=FALLBACK_PRICE) -> DataFrame:
    """Left join on the primary model ('unknown' when none), then fall back.

    A price table within the bound that :func:`price_table` checks is
    broadcast, and the sessions side is not shuffled for it.
    """
    key = F.coalesce(F.col(model_col), F.lit("unknown"))
    joined = sessions.join(prices, key == F.col("price_model"), "left")
    return joined.select(
        *[c for c in sessions.columns],
        *[F.coalesce(F.col(c), F.lit(float(v))).alias(c) for c, v in zip(PRICE_COLS, fallback)],
    )


def cost_columns(tin, tout, tcc, tcr) -> dict[str, Column]:
    """input (= input + cache create + cache read), output and total cost.

    Same operation order as the reference so doubles agree bit for bit.
    """
    m = F.lit(1000000.0)
    c_in = F.col(tin).cast("double") / m * F.col("price_input")
    c_out = F.col(tout).cast("double") / m * F.col("price_output")
    c_cc = F.col(tcc).cast("double") / m * F.col("price_cache_create")
    c_cr = F.col(tcr).cast("double") / m * F.col("price_cache_read")
    return {
        "estimated_input_cost_usd": c_in + c_cc + c_cr,
        "estimated_output_cost_usd": c_out,
        "estimated_total_cost_usd": c_in + c_out + c_cc + c_cr,
    }
