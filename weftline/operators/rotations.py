"""Rotations over time: interpolation between samples and means, by quaternions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import geometry, vectors


def _finite(x: Column) -> Column:
    return F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def with_quaternion(df: DataFrame, six: str) -> DataFrame:
    """df with ``_q``, the quaternion of a rotation of six values; null where a value isn't finite."""
    q = vectors.let(vectors.rotation(F.col(six)), lambda m: F.array(*geometry.quaternion([F.element_at(m, i) for i in range(1, 10)])))
    return df.withColumn("_q", F.when(_finite(F.col(six)), q))


def interpolate(source: DataFrame, targets: DataFrame, keys: list[str], t: str, six: str) -> DataFrame:
    """Rotations of a unit at other times: keys, t and six values, by quaternions blended between the samples around.

    The later quaternion's sign follows the earlier one's, so a blend takes the short way. A sample that isn't finite
    repeats the one before, or is the identity where there is none. Before the first sample and after the last one
    they stay as they are; a unit without samples gives none. Samples of one time: the last six values in order count.
    Repeated targets give repeated rows. Samples and targets meet in one sort by unit and time, without a join.
    """
    w = Window.partitionBy(*keys)
    identity = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))
    rows = with_quaternion(source.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias(t), six), six)
    rows = rows.withColumn("_q", F.coalesce(F.last("_q", ignorenulls=True).over(w.orderBy(t, six).rowsBetween(Window.unboundedPreceding, 0)), identity))
    marked = rows.select(*keys, t, F.struct(F.col(t).alias("t"), F.col("_q").alias("q")).alias("_s"))
    asked = targets.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias(t), F.lit(None).cast(marked.schema["_s"].dataType).alias("_s"))
    both = marked.unionByName(asked)
    before = w.orderBy(F.col(t), F.col("_s").isNull(), "_s").rowsBetween(Window.unboundedPreceding, 0)
    after = w.orderBy(F.col(t).desc(), F.col("_s").isNull(), F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"_l": F.last("_s", ignorenulls=True).over(before), "_r": F.last("_s", ignorenulls=True).over(after)})
    near = near.filter("_s IS NULL AND (_l IS NOT NULL OR _r IS NOT NULL)").withColumns({"_l": F.coalesce("_l", "_r"), "_r": F.coalesce("_r", "_l")})
    share = F.when(F.col("_r.t") > F.col("_l.t"), (F.col(t) - F.col("_l.t")) / (F.col("_r.t") - F.col("_l.t"))).otherwise(0.0)
    sign = F.when(_dot(F.col("_l.q"), F.col("_r.q")) < 0, -1.0).otherwise(1.0)
    blend = near.withColumns({"_w": share, "_g": sign}).withColumn("_b", F.zip_with("_l.q", "_r.q", lambda a, b: (1 - F.col("_w")) * a + F.col("_w") * F.col("_g") * b))
    size = F.sqrt(_dot(F.col("_b"), F.col("_b")))
    unit = blend.withColumn("_n", size).withColumn("_b", F.when(F.col("_n") > 1e-12, F.transform("_b", lambda v: v / F.col("_n"))).otherwise(F.col("_l.q")))
    m = geometry.matrix([F.element_at("_b", i) for i in range(1, 5)])
    return unit.select(*keys, t, F.array(m[0], m[3], m[6], m[1], m[4], m[7]).alias(six))


def mean_rotation(df: DataFrame, keys: list[str], order: list[str], six: str, decimals: int = 1) -> DataFrame:
    """Mean rotation of a unit as a rotation vector in degrees: keys, rx, ry, rz and n.

    The mean of quaternions on the side of the unit's first one, normalised: the chordal mean. Samples that aren't
    finite don't count; a unit without others gives no row. A unit's first quaternion and its sums are two aggregates
    that start on the map side, so a long unit isn't one task's work.
    """
    rows = with_quaternion(df.select(*keys, *order, six).filter(_finite(F.col(six))), six).select(*keys, *order, "_q")
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, "_q")).getField("_q").alias("_first"))
    sided = rows.join(first, keys).withColumn("_g", F.when(_dot(F.col("_q"), F.col("_first")) < 0, -1.0).otherwise(1.0))
    sums = sided.groupBy(*keys).agg(*[F.avg(F.element_at("_q", i) * F.col("_g")).alias(f"_{i}") for i in range(1, 5)], F.count("*").alias("n"))
    size = F.greatest(F.sqrt(sum(F.col(f"_{i}") * F.col(f"_{i}") for i in range(1, 5))), F.lit(1e-12))
    q = [F.col(f"_{i}") / size * F.when(F.col("_1") < 0, -1.0).otherwise(1.0) for i in range(1, 5)]
    return sums.select(*keys, *[F.round(c, decimals).alias(n) for c, n in zip(geometry.rotation_vector(q), ("rx", "ry", "rz"), strict=True)], "n")
