"""Volume and cost estimate for enriching a set of texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.functions import text as X


def approx_tokens(text):
    return F.greatest(F.lit(1), F.floor(F.length(X.or_empty(text)) / 4))


def enrichment_estimate(
    df: DataFrame, prices: DataFrame, instruction_tokens: list[int], system_tokens: int,
    max_output: int = 1024, min_output: int = 64, use_cache: bool = True, batch_factor: float = 1.0,
) -> DataFrame:
    """One row per priced model. `prices`: model, in_price, out_price per million tokens."""
    calls_per_row = len(instruction_tokens)
    avg_instruction = sum(instruction_tokens) / calls_per_row
    row = df.agg(F.count("*").alias("n"), F.avg(approx_tokens(F.col("text"))).alias("t")).first()
    n_calls, tokens = row["n"] * calls_per_row, float(row["t"] or 0.0)
    if use_cache:  # first call writes the shared prefix, later calls read it
        shared = system_tokens * 1.25 + (n_calls - 1) * (system_tokens * 0.1)
    else:
        shared = n_calls * float(system_tokens)
    avg_out = min(float(max_output), max(float(min_output), tokens))
    priced = prices.select(
        "model", F.lit(row["n"]).cast("long").alias("n_rows"), F.lit(n_calls).cast("long").alias("n_calls"),
        F.lit(tokens).alias("avg_tokens"),
        F.lit(n_calls * (avg_instruction + tokens) + shared).alias("input_tokens"),
        F.lit(n_calls * avg_out).alias("output_tokens"), "in_price", "out_price",
    )
    return priced.select(
        "model", "n_rows", "n_calls", "avg_tokens", "input_tokens", "output_tokens",
        ((F.col("input_tokens") / 1e6 * F.col("in_price") + F.col("output_tokens") / 1e6 * F.col("out_price"))
         * F.lit(batch_factor)).alias("cost"),
    )
