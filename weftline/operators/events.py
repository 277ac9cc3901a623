"""Events: excursions of channels from rest, claims by priority, nearest frames, lagged agreement.

Frames are long here: keys, ref (the channel), idx (0..n-1 in the unit), v and covered. Spans are half-open in idx.
Spans meet frames by equi-joins on the expanded idx, never by range joins, so a long unit is no nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rest_values(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Median of each channel's covered values, to four decimals; 0 for a channel that is never covered."""
    return frames.groupBy(*keys, "ref").agg(F.round(F.coalesce(F.median(F.when(F.col("covered"), F.col("v"))), F.lit(0.0)), 4).alias("rest"))


def deviations(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with the deviation from their channel's rest as ``dev``."""
    return frames.join(rest_values(frames, keys), [*keys, "ref"]).withColumn("dev", F.col("v") - F.col("rest"))


def excursions(devs: DataFrame, keys: list[str], drivers: list[str], members: list[str], low: float, high: float, least: float, most: float, hz: float = 1.0, signed: bool = False) -> DataFrame:
    """Candidates of one kind of event, phrases and rejected ones.

    A driver's run of covered frames at ``low`` or more from rest (a sign at a time if signed) counts when it reaches ``high``.
    Overlapping runs make one candidate. reason is null for a phrase, else too_short, too_long (seconds against least and
    most) or not_fully_described (a member isn't covered throughout). driver is the strongest active one, by name among
    equals; first_peak and last_peak bound its extreme; onset and offset are seconds from the span's ends to them;
    direction is + or -; channel_dev maps members to their mean deviation over the frames of the extreme.
    """
    signs = F.array(F.lit(1.0), F.lit(-1.0)) if signed else F.array(F.lit(1.0))
    hot = devs.filter(F.col("covered") & F.col("ref").isin(drivers)).select(*keys, "ref", "idx", "dev", F.explode(signs).alias("sign"))
    hot = hot.withColumn("up", F.col("sign") * F.col("dev")).filter(F.col("up") >= low)
    island = F.col("idx") - F.row_number().over(Window.partitionBy(*keys, "ref", "sign").orderBy("idx"))
    runs = hot.withColumn("g", island).groupBy(*keys, "ref", "sign", "g").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e"), F.max("up").alias("top")).filter(F.col("top") >= high)
    w = Window.partitionBy(*keys).orderBy("s", "e", "ref", "sign")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.coalesce((F.col("s") >= reach).cast("int"), F.lit(0)))
    runs = runs.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "cluster").agg(F.min("s").alias("start"), F.max("e").alias("stop"), F.collect_set("ref").alias("active"))

    inside = found.withColumn("idx", F.explode(F.sequence("start", F.col("stop") - 1))).join(devs.filter(F.col("ref").isin(members)), [*keys, "idx"])
    size = F.abs("dev")
    per_ref = inside.groupBy(*keys, "start", "stop", "ref").agg(
        F.max(size).alias("extreme"), F.count_if("covered").alias("n"), F.first(F.array_contains("active", F.col("ref"))).alias("is_active"),
    )
    span = Window.partitionBy(*keys, "start")
    ranked = per_ref.withColumn("whole", F.sum("n").over(span) == (F.col("stop") - F.col("start")) * len(members))
    ranked = ranked.withColumn("r", F.row_number().over(span.orderBy(F.desc("is_active"), F.desc("extreme"), "ref"))).filter("r = 1")
    top = ranked.select(*keys, "start", F.col("ref").alias("driver"), "extreme", "whole")

    peaks = inside.join(top, [*keys, "start"]).filter((F.col("ref") == F.col("driver")) & (size == F.col("extreme"))).select(*keys, "start", "idx", F.col("dev").alias("peak_dev"))
    at_peak = inside.join(peaks, [*keys, "start", "idx"]).groupBy(*keys, "start", "ref").agg(F.avg("dev").alias("d"), F.min("idx").alias("a"), F.max("idx").alias("b"), F.min_by("peak_dev", "idx").alias("p"))
    shape = at_peak.groupBy(*keys, "start").agg(
        F.min("a").alias("first_peak"), F.max("b").alias("last_peak"), F.min_by("p", "a").alias("p"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", F.round("d", 4))))).alias("channel_dev"),
    )
    seconds = (F.col("stop") - F.col("start")) / hz
    reason = F.when(seconds < least - 1e-9, "too_short").when(seconds > most + 1e-9, "too_long").when(~F.col("whole"), "not_fully_described")
    out = found.join(top, [*keys, "start"]).join(shape, [*keys, "start"])
    return out.select(
        *keys, "start", "stop", F.array_sort("active").alias("active"), reason.alias("reason"), "driver", F.when(F.col("p") > 0, "+").otherwise("-").alias("direction"),
        "first_peak", "last_peak", F.round((F.col("first_peak") - F.col("start")) / hz, 4).alias("onset"), F.round((F.col("stop") - 1 - F.col("last_peak")) / hz, 4).alias("offset"), "channel_dev",
    )


def claim(kinds: list[tuple[str, int, list[str], DataFrame]], keys: list[str]) -> DataFrame:
    """Spans (keys, start, stop) of several kinds (name, priority, channels, spans) dealt by priority, then name.

    A span that meets a frame claimed on one of its channels is rejected: reason claimed_by_higher_priority, else null.
    Spans of one kind must not overlap. The loop is over kinds only.
    """
    taken, out = None, None
    for name, _, channels, spans in sorted(kinds, key=lambda k: (-k[1], k[0])):
        spans = spans.select(*keys, "start", "stop")
        refs = F.explode(F.array(*map(F.lit, channels)))
        cells = spans.select(*keys, "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("idx")).select("*", refs.alias("channel"))
        if taken is None:
            judged = spans.withColumn("reason", F.lit(None).cast("string"))
        else:
            lost = cells.join(taken, [*keys, "channel", "idx"], "left_semi").select(*keys, "start").distinct().withColumn("reason", F.lit("claimed_by_higher_priority"))
            judged = spans.join(lost, [*keys, "start"], "left")
        won = judged.filter("reason IS NULL").select(*keys, "start")
        fresh = cells.join(won, [*keys, "start"], "left_semi").select(*keys, "channel", "idx")
        taken = fresh if taken is None else taken.unionByName(fresh)
        judged = judged.select(*keys, F.lit(name).alias("kind"), "start", "stop", "reason")
        out = judged if out is None else out.unionByName(judged)
    return out


def nearest(asked: DataFrame, frames: DataFrame, keys: list[str], t: str, source: str) -> DataFrame:
    """For each asked row (keys, t and its own columns) the source of the frame nearest in time, the earlier of equally near.

    One ordered pass each way over the union of both; null where the unit has no frame. asked must not have a column _f.
    """
    frame = F.struct(F.col(t).alias("t"), F.col(source).alias("s"))
    both = asked.withColumn("_f", F.lit(None).cast(f"struct<t:double,s:{dict(frames.dtypes)[source]}>")).unionByName(frames.select(*keys, t, frame.alias("_f")), allowMissingColumns=True)
    tie = F.col("_f.s")
    back = Window.partitionBy(*keys).orderBy(F.col(t), F.col("_f").isNull(), tie.desc())
    ahead = Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("_f").isNull(), tie.desc())
    seen = both.withColumns({"_l": F.last("_f", ignorenulls=True).over(back), "_r": F.last("_f", ignorenulls=True).over(ahead)}).filter("_f IS NULL")
    later = F.col("_l").isNull() | (F.col("_r.t") - F.col(t) < F.col(t) - F.col("_l.t"))
    return seen.withColumn("nearest", F.when(F.coalesce(later, F.lit(False)), F.col("_r.s")).otherwise(F.col("_l.s"))).drop("_f", "_l", "_r")


def lag_curve(df: DataFrame, keys: list[str], idx: str, a: str, b: str, most: int) -> DataFrame:
    """Mean product of two channels' z-scores (population) at each lag of -most..most samples: keys, lag, r, n.

    b is taken ``lag`` samples after a. A channel that doesn't vary gives no rows.
    """
    w = Window.partitionBy(*keys)
    z = {f"_{c}": (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)) for c in (a, b)}
    scored = df.select(*keys, F.col(idx).cast("long").alias("_i"), a, b).withColumns(z).filter(F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull())
    left = scored.select(*keys, F.col(f"_{a}").alias("_x"), "_i", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("_i", F.col("_i") + F.col("lag"))
    both = left.join(scored.select(*keys, "_i", F.col(f"_{b}").alias("_y")), [*keys, "_i"])
    return both.groupBy(*keys, "lag").agg(F.avg(F.col("_x") * F.col("_y")).alias("r"), F.count("*").alias("n"))
