"""Dynamics of signals: derivatives of three orders over uneven times, their summary, and errors of a reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.timeseries import finite, gradient

ORDERS = ("velocity", "acceleration", "jerk")
#: Steps that differ by no more are uniform.
UNIFORM = 1e-6


def derivatives(df: DataFrame, keys: list[str], order: list[str], t: str, value: str) -> DataFrame:
    """Add velocity, acceleration and jerk, each the gradient of the one before; all null for a lone sample. Raises where times don't rise."""
    before = value
    for name in ORDERS:
        df, before = gradient(df, keys, order, t, before, name), name
    return df


def summary(df: DataFrame, keys: list[str], order: list[str], t: str, value: str) -> DataFrame:
    """Per unit: frames, steps, missing inputs, and for each order the mean, most and missing of magnitudes.

    Interior figures leave out as many frames at each end as the order is, whose values come from one-sided differences.
    Values that aren't finite are missing and count in no mean. Units of one frame have no steps and no derivatives.
    """
    w, own = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    rows = derivatives(df, keys, order, t, value).withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(own), "_d": F.col(t) - F.lag(t).over(w)})
    found: list[Column] = [
        F.count("*").alias("n_frames"), F.min("_d").alias("step_min"), F.max("_d").alias("step_max"), F.avg("_d").alias("step_mean"),
        (F.max("_d") - F.min("_d") <= UNIFORM).alias("is_uniform"), F.count_if(finite(F.col(value)).isNull()).alias("n_missing"),
    ]
    for k, name in enumerate(ORDERS, 1):
        size = F.abs(finite(F.col(name)))
        inside = F.when((F.col("_i") >= k) & (F.col("_i") < F.col("_n") - k), size)
        found += [F.avg(size).alias(f"{name}_mean"), F.max(size).alias(f"{name}_max"), F.avg(inside).alias(f"{name}_interior_mean"), F.max(inside).alias(f"{name}_interior_max"), F.count_if(size.isNull()).alias(f"{name}_n_missing")]
    return rows.groupBy(*keys).agg(*found)


def errors(df: DataFrame, keys: list[str], order: list[str], t: str, value: str, rebuilt: str) -> DataFrame:
    """Of each order over all units of two frames or more: mean magnitudes of value and rebuilt, mean and largest error."""
    rows = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n >= 2")
    first = derivatives(rows, keys, order, t, value).withColumnsRenamed({n: f"_{n}" for n in ORDERS})
    both = derivatives(first, keys, order, t, rebuilt)
    each = both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("derivative"), F.col(f"_{n}").alias("_a"), F.col(n).alias("_b")) for n in ORDERS])))
    return each.groupBy("derivative").agg(F.avg(F.abs("_a")).alias("mean_abs_original"), F.avg(F.abs("_b")).alias("mean_abs_rebuilt"), F.avg(F.abs(F.col("_b") - F.col("_a"))).alias("mae"), F.max(F.abs(F.col("_b") - F.col("_a"))).alias("max_abs"))
