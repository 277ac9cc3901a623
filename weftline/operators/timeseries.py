"""Operators on irregular per-unit time series: audit, gaps, resampling, windows, derivatives, runs, intervals.

Each takes a DataFrame with named key, order and value columns and gives one; order columns must make a total order.
All are window functions, aggregates and equi-joins, one exchange on the unit's key for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def audit(df: DataFrame, keys: list[str], order: list[str], t: str, gap_factor: float = 1.5) -> DataFrame:
    """Per unit: frames, missing times, backward and equal steps, steps over gap_factor medians, and step statistics.

    A step counts between neighbours that both have a time; nothing is repaired or dropped. A time that isn't finite is missing.
    """
    df = df.withColumn(t, finite(F.col(t)))
    stepped = df.withColumn("_d", F.col(t) - F.lag(t).over(_over(keys, order)))
    stepped = stepped.withColumn("_m", F.median("_d").over(Window.partitionBy(*keys)))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return stepped.groupBy(*keys).agg(
        F.count("*").alias("n_frames"),
        count(F.col(t).isNull()).alias("n_missing"),
        count(F.col("_d") < 0).alias("n_backward"),
        count(F.col("_d") == 0).alias("n_duplicate"),
        count(F.col("_d") > gap_factor * F.col("_m")).alias("n_gaps"),
        F.min("_d").alias("step_min"),
        F.max("_d").alias("step_max"),
        F.median("_d").alias("step_median"),
        (F.max(t) - F.min(t)).alias("duration"),
        (count(F.col("_d") > 0) == F.count("*") - 1).alias("strictly_monotonic"),
    )


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def issues(df: DataFrame, keys: list[str], order: list[str], t: str, gap_factor: float = 1.5) -> DataFrame:
    """Per unit: what is wrong with its times, by code, where its large gaps are, and the verdict that follows.

    Columns: keys, n_frames, codes (array), large_gaps (array of frame before the gap and length), strictly_monotonic,
    timeline_label (usable or needs_review) and reasons (``timeline:`` and a code, or that times don't rise strictly).
    A gap is longer than gap_factor median rising steps; the one before the last frame is told apart from those inside.
    """
    w = _over(keys, order)
    rows = df.withColumn(t, finite(F.col(t))).withColumns({"_i": (F.row_number().over(w) - 1).cast("long"), "_d": F.col(t) - F.lag(t).over(w)})
    rows = rows.withColumn("_m", F.median(F.when(F.col("_d") > 0, F.col("_d"))).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    gap, tail = F.col("_d") > gap_factor * F.col("_m"), F.col("_i") == F.col("_n") - 1
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_frames"),
        any_of(F.col(t).isNull()).alias("_a"), any_of(F.col("_d") < 0).alias("_b"), any_of(F.col("_d") == 0).alias("_c"), any_of(gap & ~tail).alias("_e"), any_of(gap & tail).alias("_f"),
        F.sort_array(F.collect_list(F.when(gap, F.struct((F.col("_i") - 1).alias("after_frame"), F.col("_d").alias("gap_sec"))))).alias("large_gaps"),
        (F.count_if(F.col("_d") > 0) == F.count("*") - 1).alias("strictly_monotonic"),
    )
    codes = {"_a": "missing_pts", "_b": "non_monotonic_pts", "_c": "duplicate_pts", "_e": "large_frame_gap", "_f": "tail_frame_gap"}
    found = found.withColumn("codes", F.array_compact(F.array(*[F.when(F.col(c), code) for c, code in codes.items()])))
    reasons = F.when((F.size("codes") == 0) & ~F.col("strictly_monotonic"), F.array(F.lit("timeline:not_strictly_monotonic"))).otherwise(F.transform("codes", lambda c: F.concat(F.lit("timeline:"), c)))
    label = F.when(F.col("strictly_monotonic") & (F.size("codes") == 0), "usable").otherwise("needs_review")
    return found.select(*keys, "n_frames", "codes", "large_gaps", "strictly_monotonic", label.alias("timeline_label"), reasons.alias("reasons"))


def increasing_clock(df: DataFrame, keys: list[str], order: list[str], t: str, out: str = "clock_ms") -> DataFrame:
    """Strictly increasing milliseconds: each at least one after the last. The running form i + max(ms - i) needs no loop."""
    w = _over(keys, order)
    df = df.withColumn("_i", (F.row_number().over(w) - 1).cast("long"))
    ahead = F.max(F.rint(F.col(t) * 1000).cast("long") - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.col("_i") + F.greatest(F.lit(0), F.coalesce(ahead, F.lit(0)))).drop("_i")


def rate(df: DataFrame, keys: list[str], order: list[str], t: str) -> DataFrame:
    """Samples a second by the median step; null with under two samples or a median of 0 or less."""
    steps = df.withColumn("_d", F.col(t) - F.lag(t).over(_over(keys, order))).groupBy(*keys).agg(F.median("_d").alias("_m"))
    return steps.select(*keys, F.when(F.col("_m") > 0, 1 / F.col("_m")).alias("rate"))


def segments(df: DataFrame, keys: list[str], order: list[str], t: str, max_gap: float, valid: Column | None = None, least: int = 2, out: str = "segment_id") -> DataFrame:
    """Number valid rows by the stretches between gaps longer than max_gap; shorter stretches than ``least`` rows go."""
    rows = df if valid is None else df.filter(valid)
    w = _over(keys, order)
    rows = rows.withColumn("_new", F.coalesce((F.col(t) - F.lag(t).over(w) > max_gap).cast("int"), F.lit(0)))
    rows = rows.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, out))).filter(F.col("_n") >= least).drop("_n")


def resample(df: DataFrame, keys: list[str], t: str, value: str, source: str, step: float) -> DataFrame:
    """Each unit (keys name the segment too) on a uniform grid from its first time, linearly interpolated.

    Columns: keys, grid_idx, t_sec, value, source (the nearest sample's, the earlier of equally near) and is_gap_filled: the
    samples around are over 1.5 median steps apart and the nearer is over half a median away. A sample carries its
    successor, so one forward pass over the union of grid and samples finds both neighbours of a grid point.
    """
    w = _over(keys, [t, source])
    own = Window.partitionBy(*keys)
    rows = df.select(*keys, F.col(t).cast("double").alias("t_sec"), F.col(value).alias("_v"), F.col(source).alias("_s"))
    w = _over(keys, ["t_sec", "_s"])
    rows = rows.withColumns({"_nt": F.lead("t_sec").over(w), "_nv": F.lead("_v").over(w), "_ns": F.lead("_s").over(w)})
    rows = rows.withColumn("_m", F.median(F.col("_nt") - F.col("t_sec")).over(own))
    spans = rows.groupBy(*keys).agg(F.min("t_sec").alias("_a"), F.max("t_sec").alias("_b"))
    grid = spans.select(*keys, "_a", F.explode(F.sequence(F.lit(0), F.floor((F.col("_b") - F.col("_a")) / step + 1e-9).cast("int"))).alias("grid_idx"))
    grid = grid.select(*keys, (F.col("_a") + F.col("grid_idx") * F.lit(float(step))).alias("t_sec"), F.col("grid_idx").cast("long").alias("grid_idx"), F.lit(None).alias("_x"))
    sample = F.struct("t_sec", "_v", "_s", "_nt", "_nv", "_ns", "_m")
    both = rows.select(*keys, "t_sec", F.lit(None).cast("long").alias("grid_idx"), sample.alias("_x")).unionByName(grid.withColumn("_x", F.lit(None).cast(_struct_of(rows))))
    seen = F.last("_x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t_sec", F.col("grid_idx").isNotNull(), "_x.t_sec", "_x._s").rowsBetween(Window.unboundedPreceding, 0))
    at = both.withColumn("_x", seen).filter("grid_idx IS NOT NULL")
    after, gap = F.col("t_sec") - F.col("_x.t_sec"), F.col("_x._nt") - F.col("_x.t_sec")
    inside = F.col("_x._nt").isNotNull() & (after > 0)
    before = F.col("_x._nt") - F.col("t_sec")
    return at.select(
        *keys, "grid_idx", "t_sec",
        F.when(inside, F.col("_x._v") + (F.col("_x._nv") - F.col("_x._v")) * after / gap).otherwise(F.col("_x._v")).alias("value"),
        F.when(inside & (before < after), F.col("_x._ns")).otherwise(F.col("_x._s")).alias("source"),
        F.coalesce(inside & (gap > 1.5 * F.col("_x._m")) & (F.least(after, before) > 0.5 * F.col("_x._m") + 1e-9), F.lit(False)).alias("is_gap_filled"),
    )


def _struct_of(rows: DataFrame) -> str:
    types = dict(rows.dtypes)
    return "struct<" + ",".join(f"{c}:{types[c]}" for c in ("t_sec", "_v", "_s", "_nt", "_nv", "_ns", "_m")) + ">"


def hop_of(width: int, overlap: float) -> int:
    """Samples from one window to the next: half-even rounding, one at least. Raises unless 0 <= overlap < 1."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return max(1, round(width * (1 - overlap)))


def slice_windows(df: DataFrame, keys: list[str], idx: str, columns: list[str], width: int, hop: int, pad: bool = True) -> DataFrame:
    """Rows (keys, window_start, k, columns, is_padding) of all windows of ``width`` samples each ``hop`` over each unit's 0..n-1.

    With pad, one more window covers a tail that no window reaches the end of, repeating the last sample as padding;
    a unit of n >= width samples has its whole window with or without it.
    """
    size = df.groupBy(*keys).agg((F.max(idx) + 1).cast("int").alias("_n"))
    full = F.when(F.col("_n") >= width, F.sequence(F.lit(0), F.col("_n") - width, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    ends = F.coalesce(F.try_element_at(full, F.lit(-1)) + width, F.lit(0))
    starts = F.when(ends < F.col("_n"), F.array_append(full, F.coalesce(F.try_element_at(full, F.lit(-1)) + hop, F.lit(0)))).otherwise(full) if pad else full
    spine = size.select(*keys, "_n", F.explode(starts).alias("window_start")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    spine = spine.withColumn(idx, F.least(F.col("window_start") + F.col("k"), F.col("_n") - 1).cast("long"))
    out = spine.join(df.select(*keys, F.col(idx).cast("long").alias(idx), *columns), [*keys, idx])
    return out.select(*keys, F.col("window_start").cast("long").alias("window_start"), F.col("k").cast("long").alias("k"), *columns, (F.col("window_start") + F.col("k") >= F.col("_n")).alias("is_padding"))


def overlap_add(windows: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Samples back from windows, weighted by a raised cosine (ones for under three samples); padding is left out."""
    taper = F.lit(1.0) if width < 3 else 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("k") / (width - 1)) + 1e-6
    rows = windows.filter("NOT is_padding").withColumn("_w", taper)
    return rows.groupBy(*keys, (F.col("window_start") + F.col("k")).alias("idx")).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value), F.count("*").alias("n_windows"))


def stitch(windows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Samples back from windows that must agree where they overlap; raises where they don't."""
    rows = windows.filter("NOT is_padding").groupBy(*keys, (F.col("window_start") + F.col("k")).alias("idx"))
    out = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return out.select(*keys, "idx", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.raise_error(F.lit("windows disagree"))).alias(value))


def gradient(df: DataFrame, keys: list[str], order: list[str], t: str, value: str, out: str) -> DataFrame:
    """First derivative over uneven times, of second order inside and one-sided at the ends; null for a lone sample.

    Raises where times don't rise strictly.
    """
    w = _over(keys, order)
    rising = lambda h: F.when(h <= 0, F.raise_error(F.lit("times must rise strictly")).cast("double")).otherwise(h)
    hs, hd = rising(F.col(t) - F.lag(t).over(w)), rising(F.lead(t).over(w) - F.col(t))
    df = df.withColumns({"_hs": hs, "_hd": hd, "_p": F.lag(value).over(w), "_q": F.lead(value).over(w)})
    s, d, v = F.col("_hs"), F.col("_hd"), F.col(value)
    inner = (s * s * F.col("_q") + (d * d - s * s) * v - d * d * F.col("_p")) / (s * d * (s + d))
    slope = F.when(s.isNull() & d.isNull(), None).when(s.isNull(), (F.col("_q") - v) / d).when(d.isNull(), (v - F.col("_p")) / s).otherwise(inner)
    return df.withColumn(out, slope).drop("_hs", "_hd", "_p", "_q")


def derivative_weight(df: DataFrame, keys: list[str], order: list[str], segment: str, weight: str, taps: int) -> DataFrame:
    """Weight of a difference over ``taps`` samples from each: the least of theirs, 0 across segments or past the end."""
    w = _over(keys, order)
    least, same = F.col(weight), F.lit(True)
    for k in range(1, taps):
        least = F.least(least, F.lead(weight, k).over(w))
        same = same & F.coalesce(F.lead(segment, k).over(w) == F.col(segment), F.lit(False))
    return df.withColumn("derivative_weight", F.when(same, least).otherwise(0.0))


def loss_weight(quality: Column, observed: Column, gap_filled: Column, padding: Column, gap_weight: float = 0.0) -> Column:
    """Quality cut to 0..1; 0 where unobserved, gap_weight where gap-filled, and 0 where padded, which overrides all."""
    return F.when(padding, 0.0).when(gap_filled, gap_weight).when(~observed, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)))


def fill_low(df: DataFrame, keys: list[str], idx: str, value: str, quality: str, threshold: float) -> DataFrame:
    """Interpolate by index where quality is at the threshold or under; ends hold the nearest good value, units without one stay."""
    good = F.when(F.col(quality) > threshold, F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    up, down = Window.partitionBy(*keys).orderBy(F.col(idx)), Window.partitionBy(*keys).orderBy(F.col(idx).desc())
    df = df.withColumn("_l", F.last(good, ignorenulls=True).over(up)).withColumn("_r", F.last(good, ignorenulls=True).over(down))
    i, lo, hi = F.col(idx), F.col("_l"), F.col("_r")
    between = lo.v + (hi.v - lo.v) * (i - lo.i) / (hi.i - lo.i)
    filled = F.when(F.col(quality) > threshold, F.col(value)).when(lo.isNull() & hi.isNull(), F.col(value)).when(lo.isNull(), hi.v).when(hi.isNull(), lo.v).otherwise(between)
    return df.withColumn("filled", filled).withColumn("was_low", F.col(quality) <= threshold).drop("_l", "_r")


def runs(df: DataFrame, keys: list[str], idx: str, level: str, described: Column | None = None, more: list[Column] | None = None) -> DataFrame:
    """Maximal runs of one level over consecutive idx of described rows: keys, run_start, run_stop (exclusive), level, n and further aggregates."""
    rows = df if described is None else df.filter(described)
    w = _over(keys, [idx])
    new = (F.lag(level).over(w).eqNullSafe(F.col(level)) & F.coalesce(F.lag(idx).over(w) == F.col(idx) - 1, F.lit(False))) == F.lit(False)
    rows = rows.withColumn("_n", new.cast("int"))
    rows = rows.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g", level).agg(F.min(idx).alias("run_start"), (F.max(idx) + 1).alias("run_stop"), F.count("*").alias("n"), *(more or [])).drop("_g")


def merge_touching(spans: DataFrame, keys: list[str], start: str, stop: str, same: list[str]) -> DataFrame:
    """Join spans that touch and are equal in ``same``; raises on spans that overlap."""
    w = _over(keys, [start])
    last = F.lag(stop).over(w)
    joins = F.coalesce(last == F.col(start), F.lit(False))
    for c in same:
        joins = joins & F.lag(c).over(w).eqNullSafe(F.col(c))
    checked = spans.withColumn("_j", F.when(F.coalesce(last > F.col(start), F.lit(False)), F.raise_error(F.lit("spans overlap")).cast("int")).otherwise((~joins).cast("int")))
    grouped = checked.withColumn("_g", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g", *same).agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_g")


def cluster(spans: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Clusters of overlapping spans, those that only touch apart: keys, cluster_start, cluster_stop, n."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("_g", F.sum(F.coalesce((F.col(start) >= reach).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min(start).alias("cluster_start"), F.max(stop).alias("cluster_stop"), F.count("*").alias("n")).drop("_g")


def split_at(spans: DataFrame, keys: list[str], start: str, stop: str, cuts: DataFrame, cut: str) -> DataFrame:
    """Each span cut at the points of its unit that lie inside it; spans without one stay whole."""
    points = cuts.groupBy(*keys).agg(F.sort_array(F.collect_set(cut)).alias("_c"))
    both = spans.join(points, keys, "left")
    inner = F.filter(F.coalesce("_c", F.array().cast("array<bigint>")), lambda c: (c > F.col(start)) & (c < F.col(stop)))
    edges = both.withColumn("_e", F.concat(F.array(F.col(start)), inner, F.array(F.col(stop)))).drop("_c")
    pieces = edges.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_e") - 1)))
    return pieces.withColumn(start, F.element_at("_e", F.col("_k"))).withColumn(stop, F.element_at("_e", F.col("_k") + 1)).drop("_e", "_k")
