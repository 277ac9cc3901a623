"""Choosing exemplars: spreads of a bank, costs of its exemplars for a query, and the cheapest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the terms, and how many times longer or shorter an exemplar may be.
WEIGHTS = {"duration": 1.0, "channel_dev": 1.0, "keypoints": 1.0, "rest": 0.5}
MAX_RATIO = 1.5


def spreads(bank: DataFrame, hz: float) -> DataFrame:
    """Per type: standard deviations of log duration, of each deviation, of onsets and offsets together, and of rest.

    Each has a least value, so that a bank of equal exemplars divides by no 0. Of onsets and offsets, sums are put together.
    """
    over = lambda c, least: F.greatest(F.stddev_pop(c), F.lit(least))
    width = F.max(F.size("cdev"))
    times = F.sum(F.col("onset") * F.col("onset") + F.col("offset") * F.col("offset")) / (2 * F.count("*")) - F.pow(F.sum(F.col("onset") + F.col("offset")) / (2 * F.count("*")), 2)
    whole = bank.groupBy("type").agg(over(F.ln("duration"), 1e-3).alias("sd_duration"), F.greatest(F.sqrt(F.greatest(times, F.lit(0.0))), F.lit(1.0 / hz)).alias("sd_time"), over("rest", 1e-4).alias("sd_rest"), width.alias("_w"))
    each = bank.select("type", F.posexplode("cdev").alias("_k", "_v")).groupBy("type", "_k").agg(over("_v", 1e-4).alias("_s"))
    each = each.groupBy("type").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]).alias("sd_cdev"))
    return whole.drop("_w").join(each, "type")


def costs(queries: DataFrame, bank: DataFrame, hz: float, weights: dict[str, float] = WEIGHTS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """query_id, exemplar_id, cost and relaxed, for each query and each other exemplar of its type that may be used.

    Exemplars over max_ratio times longer or shorter than the query are left out; where all are, all are kept and relaxed
    is true. Queries and bank have type, duration (seconds, over 0), cdev, onset, offset (seconds) and rest. Spreads are one
    row a type; the queries are the smaller side.
    """
    bank = bank.join(F.broadcast(spreads(bank, hz)), "type")
    asked = queries.select("query_id", "type", *[F.col(c).alias(f"q_{c}") for c in ("duration", "cdev", "onset", "offset", "rest")])
    both = bank.join(asked, "type").filter("exemplar_id <> query_id")
    dev: Column = F.aggregate(F.zip_with(F.zip_with("q_cdev", "cdev", lambda a, b: F.abs(a - b)), "sd_cdev", lambda d, s: d / s), F.lit(0.0), lambda a, v: a + v) / F.size("cdev")
    terms = {
        "duration": F.abs(F.ln(F.col("q_duration") / F.col("duration"))) / F.col("sd_duration"),
        "channel_dev": dev,
        "keypoints": (F.abs(F.col("q_onset") - F.col("onset")) + F.abs(F.col("q_offset") - F.col("offset"))) / F.col("sd_time"),
        "rest": F.abs(F.col("q_rest") - F.col("rest")) / F.col("sd_rest"),
    }
    ratio = F.col("q_duration") / F.col("duration")
    rated = both.select("query_id", "exemplar_id", sum(weights[k] * c for k, c in terms.items()).alias("cost"), ratio.between(1 / max_ratio, max_ratio).alias("_ok"))
    rated = rated.withColumn("_any", F.max("_ok").over(Window.partitionBy("query_id")))
    return rated.filter("_ok OR NOT _any").select("query_id", "exemplar_id", "cost", (~F.col("_any")).alias("relaxed"))


def cheapest(rated: DataFrame, n: int) -> DataFrame:
    """The n cheapest exemplars of each query, with rank from 1; of equal cost the lesser id first."""
    w = Window.partitionBy("query_id").orderBy("cost", "exemplar_id")
    return rated.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
