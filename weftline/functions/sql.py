"""Functions of the engine under names that SQL text can call; they are SQL themselves, so the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "level_of(x DOUBLE, edges ARRAY<DOUBLE>)": ("INT", "CAST(signum(x) AS INT) * size(filter(edges, e -> abs(x) >= e))"),
    "loss_weight(quality DOUBLE, observed BOOLEAN, gap_filled BOOLEAN, padding BOOLEAN)": ("DOUBLE", "CASE WHEN padding OR gap_filled OR NOT observed THEN 0D ELSE greatest(0D, least(1D, quality)) END"),
    "frames_for_seconds(seconds DOUBLE, rate DOUBLE)": ("BIGINT", "greatest(floor(round(seconds * rate, 9) + 0.5), 2L)"),
}


def register(spark: SparkSession) -> None:
    """Create the functions for the session; signed levels, weights of a loss, frames of a duration."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
