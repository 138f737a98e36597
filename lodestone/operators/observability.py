"""Query costs, logs and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.evaluation import interpolated

#: Fixed values, USD: an embedding token, 1000 rerank tokens, and 1000 input and output tokens by provider.
EMBEDDING, RERANK = 2e-8, 1.5e-5
RATES = {"gemini": (0.000075, 0.0003), "groq": (0.00005, 0.00008)}
DEFAULT_PROVIDER = "gemini"


def query_costs(log: DataFrame) -> DataFrame:
    """``log`` with embedding, input, output, rerank and total cost; unknown providers pay the default's rates."""

    def rate(k: int) -> Column:
        out = F.lit(RATES[DEFAULT_PROVIDER][k])
        for name, rates in RATES.items():
            out = F.when(F.col("provider") == name, rates[k]).otherwise(out)
        return out

    parts = {
        "embedding_cost": F.col("embedding_tokens") * EMBEDDING,
        "input_cost": F.col("input_tokens") / 1000 * rate(0),
        "output_cost": F.col("output_tokens") / 1000 * rate(1),
        "rerank_cost": F.col("rerank_tokens") / 1000 * RERANK,
    }
    return log.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in parts.items()}).withColumn("total_cost", sum(F.col(k) for k in parts))


def with_late_scores(log: DataFrame, scores: DataFrame) -> DataFrame:
    """``log`` with faithfulness from ``scores`` (log_id, faithfulness, reasoning) where there is one, the reasoning in details."""
    late = scores.select("log_id", F.col("faithfulness").alias("__f"), F.col("reasoning").alias("__r"))
    joined = log.join(late, "log_id", "left")
    details = F.when(F.col("__r").isNotNull(), F.map_concat("details", F.create_map(F.lit("reasoning"), "__r"))).otherwise(F.col("details"))
    return joined.withColumns({"faithfulness": F.coalesce("__f", "faithfulness"), "details": details}).drop("__f", "__r")


def latest(log: DataFrame, n: int, by: str = "tenant_id", order: str = "log_id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    return log.withColumn("nth", rank).where(F.col("nth") <= n)


def log_summary(log: DataFrame, n: int = 100) -> DataFrame:
    """Per tenant over its last ``n`` queries."""
    return latest(log, n).groupBy("tenant_id").agg(
        F.count("*").alias("n_queries"), F.round(F.sum("total_cost"), 6).alias("total_cost"), F.round(F.avg("total_cost"), 6).alias("avg_cost"), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms")
    )


def stage_durations(events: DataFrame) -> DataFrame:
    means = events.groupBy("event").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"))
    at = interpolated(events, "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, "event")
    return means.join(at.select("event", F.round("p50_ms", 4).alias("p50_ms"), F.round("p95_ms", 4).alias("p95_ms")), "event", "left")
