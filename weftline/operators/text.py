"""Units as text documents: runs of levels with times and hints, written as JSON and read back with every rule checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import levels
from weftline.operators import timeseries as ts

VERSION = 1
#: Decimals of times and hints, and how far from a frame a time may lie, in frames.
DECIMALS, TOLERANCE = 4, 0.05
_SEGMENTS = "segments array<struct<t0: double, t1: double, level: string, hint: double>>"
SCHEMA = f"version int, hz double, n_frames long, {_SEGMENTS}"


def time_of(frame: Column, hz: Column) -> Column:
    return F.round(frame / hz, DECIMALS)


def frame_of(t: Column, hz: Column) -> Column:
    """The frame at a time; one that lies on none raises."""
    frame = F.floor(t * hz + 0.5)
    off = F.raise_error(F.concat(F.lit("no frame at "), t.cast("string"))).cast("long")
    return F.when(F.abs(t * hz - frame) <= TOLERANCE, frame).otherwise(off)


def encode(frames: DataFrame, keys: list[str], idx: str, value: str, described: Column, quantizer: levels.Quantizer, hz: float) -> DataFrame:
    """A document a unit: keys and doc. Each run of one level over described frames is a segment with the mean as its hint, cut to the level.

    Units without described frames have no segments. A unit's segments make one row.
    """
    rows = frames.withColumn("_level", quantizer.level(F.col(value)))
    found = ts.runs(rows, keys, idx, "_level", described, [F.avg(value).alias("_mean")])
    rate = F.lit(float(hz))
    segment = F.struct(time_of(F.col("run_start"), rate).alias("t0"), time_of(F.col("run_stop"), rate).alias("t1"), levels.label(F.col("_level")).alias("level"), F.round(F.round(quantizer.clip(F.col("_level"), F.col("_mean")), 9), DECIMALS).alias("hint"))
    listed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    sizes = frames.groupBy(*keys).agg((F.max(idx) + 1).cast("long").alias("n_frames"))
    none = F.from_json(F.lit("[]"), "array<struct<t0: double, t1: double, level: string, hint: double>>")
    doc = F.to_json(F.struct(F.lit(VERSION).alias("version"), rate.alias("hz"), "n_frames", F.coalesce("segments", none).alias("segments")))
    return sizes.join(listed, keys, "left").select(*keys, doc.alias("doc"))


def decode(docs: DataFrame, keys: list[str], quantizer: levels.Quantizer) -> DataFrame:
    """Described frames of documents: keys, idx, level and value: the hint where it fits its level, or what stands for that.

    Raises on text that isn't such a document, another version, an unknown level, times off the grid, out of the document or
    falling, and on segments that overlap.
    """
    fault = lambda text: F.raise_error(F.lit(text)).cast("long")
    read = docs.select(*keys, F.from_json("doc", SCHEMA, {"mode": "FAILFAST"}).alias("_d"))
    hz = F.when(F.col("_d.version") == VERSION, F.col("_d.hz")).otherwise(fault("another version").cast("double"))
    parts = read.select(*keys, hz.alias("_hz"), F.col("_d.n_frames").alias("_n"), F.explode("_d.segments").alias("_s"))
    parts = parts.select(*keys, "_n", frame_of(F.col("_s.t0"), F.col("_hz")).alias("_a"), frame_of(F.col("_s.t1"), F.col("_hz")).alias("_b"), levels.parse_label(F.col("_s.level")).alias("level"), F.col("_s.hint").alias("_hint"))
    last = F.lag("_b").over(Window.partitionBy(*keys).orderBy("_a", "_b"))
    start = F.when((F.col("_a") < 0) | (F.col("_b") > F.col("_n")) | (F.col("_a") >= F.col("_b")), fault("a segment out of its document")).when(last > F.col("_a"), fault("segments overlap")).otherwise(F.col("_a"))
    lo, hi = quantizer.bounds(F.col("level"))
    value = F.when(F.col("_hint").between(lo, hi), F.col("_hint")).otherwise(quantizer.value(F.col("level")))
    whole = parts.select(*keys, start.alias("_a"), "_b", "level", value.alias("value"))
    return whole.select(*keys, F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("idx"), "level", "value")
