"""Sound beside pictures: chunks placed by their times, log-mel frames, windows, durations and lags against motion."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Samples a second; a frame's samples, its step and its transform's size; filters, their highest
# frequency and the least power; the jump in seconds from which a chunk breaks off; frames a second.
RATE, WIN, HOP, N_FFT, N_MELS, TOP, FLOOR, JUMP, PER_SECOND = 16_000, 400, 160, 512, 80, 8_000.0, 1e-10, 0.002, 100


def mel_filters(spark: SparkSession, rate: int = RATE, n_fft: int = N_FFT, n_mels: int = N_MELS, top: float = TOP) -> DataFrame:
    """Weights above 0 of triangular filters of peak 1, evenly spaced in mel from 0 Hz to top: mel, bin, weight."""
    step = 2595.0 * math.log10(1.0 + top / 700.0) / (n_mels + 1)
    edge = lambda k: 700.0 * (F.pow(F.lit(10.0), k * F.lit(step / 2595.0)) - 1.0)
    rows = spark.range(n_mels).select(F.col("id").alias("mel"), F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))).alias("bin"))
    hz = F.col("bin") * F.lit(rate / n_fft)
    low, middle, high = (edge(F.col("mel") + i) for i in range(3))
    weight = F.least((hz - low) / (middle - low), (high - hz) / (high - middle))
    return rows.select("mel", F.col("bin").cast("long").alias("bin"), weight.alias("weight")).filter("weight > 0")


@functools.cache
def _filters() -> np.ndarray:
    hz = np.arange(N_FFT // 2 + 1) * (RATE / N_FFT)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, math.log10(1.0 + TOP / 700.0), N_MELS + 2)) - 1.0)
    up = np.subtract.outer(hz, edges[:-2]) / np.diff(edges)[:-1]
    down = -np.subtract.outer(hz, edges[2:]) / np.diff(edges)[1:]
    return np.maximum(np.minimum(up, down), 0.0)


def _log_mel(wave: np.ndarray) -> np.ndarray:
    if len(wave) < WIN:
        return np.zeros((0, N_MELS))
    hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(WIN) / WIN)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(wave, dtype=np.float64), WIN)[::HOP]
    power = np.square(np.abs(np.fft.rfft(frames * hann, n=N_FFT)))
    return np.log(np.maximum(power @ _filters(), FLOOR))


def log_mel(wave: Column) -> Column:
    """Frames of log mel power of a row's samples (-1 to 1); frame k starts at sample k * HOP, and none passes the end.

    Null and short waves give no frames. A row's wave and its frames must fit a task.
    """

    def run(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: [] if w is None else list(_log_mel(w)))

    return F.pandas_udf(run, "array<array<double>>")(wave)


def _placed(chunks: DataFrame, keys: list[str], order: list[str], pts: str, samples: str, rate: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    start = F.first(pts).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.filter(F.col(pts).isNotNull() & (F.size(samples) > 0)).withColumn("_p", F.rint((F.col(pts) - start) * rate).cast("long"))
    return rows.withColumn("_e", F.lag(F.col("_p") + F.size(samples)).over(w))


def discontinuities(chunks: DataFrame, keys: list[str], order: list[str], pts: str, samples: str, rate: int = RATE) -> DataFrame:
    """Chunks that don't begin where the one before ended, beyond JUMP seconds: keys, at_sec and jump_sec.

    Chunks go in the given order; those without time or samples don't count.
    """
    off = F.col("_p") - F.col("_e")
    found = _placed(chunks, keys, order, pts, samples, rate).filter(F.abs(off) > JUMP * rate)
    return found.select(*keys, F.round(pts, 6).alias("at_sec"), F.round(off / rate, 6).alias("jump_sec"))


def sound_spans(chunks: DataFrame, keys: list[str], order: list[str], pts: str, samples: str, rate: int = RATE) -> DataFrame:
    """Seconds from a unit's first sample to the end of its last: keys, audio_start_sec and audio_sec."""
    rows = _placed(chunks, keys, order, pts, samples, rate)
    last = F.max(F.col("_p") + F.size(samples))
    return rows.groupBy(*keys).agg(F.min_by(pts, F.struct(*order)).alias("audio_start_sec"), ((last - F.min("_p")) / rate).alias("audio_sec"))


def picture_spans(frames: DataFrame, keys: list[str], order: list[str], pts: str) -> DataFrame:
    """Seconds of a unit's frames, one median step after the last: keys and video_sec, null for fewer than two with a time.

    A last step over 1.5 times the median of all is a gap at the end: its frame doesn't count, if two or more are left.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    timed = frames.filter(F.col(pts).isNotNull()).select(*keys, *order, F.col(pts).alias("_t"))
    steps = timed.withColumns({"_d": F.col("_t") - F.lag("_t").over(w), "_last": F.lead("_t").over(w).isNull()})
    agg = steps.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.median("_d").alias("_m"), F.median(F.when(~F.col("_last"), F.col("_d"))).alias("_m2"),
        F.max(F.when(F.col("_last"), F.col("_d"))).alias("_tail"), F.max(F.when(F.col("_last"), F.col("_t"))).alias("_stop"), F.min_by("_t", F.struct(*order)).alias("_start"),
    )
    cut = (F.col("_n") > 2) & (F.col("_tail") > 1.5 * F.col("_m"))
    whole = F.col("_stop") - F.col("_start")
    return agg.select(*keys, F.when(F.col("_n") >= 2, F.when(cut, whole - F.col("_tail") + F.col("_m2")).otherwise(whole + F.col("_m"))).alias("video_sec"))


def _lay(pts: list[float], samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = [round((p - pts[0]) * RATE) for p in pts]
    n = max(a + len(s) for a, s in zip(at, samples, strict=True))
    wave, covered = np.zeros(n, np.float32), np.zeros(n, bool)
    for a, s in zip(reversed(at), reversed(samples), strict=True):  # the earlier chunk is written last, so it wins
        b, s = max(a, 0), s[max(-a, 0) :]
        wave[b : b + len(s)], covered[b : b + len(s)] = s, True
    return wave, covered


def _cut(x: np.ndarray, start: int, n: int) -> np.ndarray:
    out = np.zeros(n, x.dtype)
    a, b = max(0, start), min(len(x), start + n)
    if b > a:
        out[a - start : b - start] = x[a:b]
    return out


def window_audio(windows: DataFrame, chunks: DataFrame, keys: list[str], window: str, t0: str, order: str, pts: str, samples: str, seconds: float, padding_from: str | None = None) -> DataFrame:
    """Sound of each window [t0, t0 + seconds) of a unit on the window's own grid: keys, window, mel, wave, valid.

    mel frame j is centred at t0 + (j + 0.5) / PER_SECOND and valid if all its samples were in chunks and it lies before
    padding_from; others are the floor. wave is 16-bit, 0 where no chunk is. Chunks lie at their own times in the order of
    ``order`` and the earlier wins where two overlap; samples before the first chunk don't count. Units without chunks
    give windows without a valid frame, those without windows nothing. A unit's samples must fit one task.
    """
    n_mel, n_wave = round(seconds * PER_SECOND), round(seconds * RATE)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keys, window).schema]
    shown = [*keys, window, "mel", "wave", "valid"]
    asked = windows.select(*keys, window, F.col(t0).cast("double").alias("_t0"), (F.col(padding_from) if padding_from else F.lit(None)).cast("double").alias("_pad"))
    given = chunks.filter(F.col(pts).isNotNull() & (F.size(samples) > 0)).select(*keys, F.col(order).alias("_o"), F.col(pts).cast("double").alias("_t"), F.col(samples).cast("array<float>").alias("_s"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=shown)
        right = right.sort_values("_o")
        wave, covered = _lay(right["_t"].tolist(), right["_s"].tolist()) if len(right) else (np.zeros(0, np.float32), np.zeros(0, bool))
        begin = right["_t"].iloc[0] if len(right) else 0.0
        out = []
        for t, pad in zip(left["_t0"], left["_pad"], strict=True):
            at = round((t - begin) * RATE)
            sound = np.clip(np.round(_cut(wave, at, n_wave) * 32767.0), -32768, 32767).astype(np.int16)
            lead, need = at - (WIN - HOP) // 2, (n_mel - 1) * HOP + WIN
            missing = np.concatenate([[0], np.cumsum(~_cut(covered, lead, need))])
            first = HOP * np.arange(n_mel)
            valid = missing[first + WIN] == missing[first]
            if pad is not None and not math.isnan(pad):
                valid &= t + (np.arange(n_mel) + 0.5) / PER_SECOND < pad
            mel = _log_mel(_cut(wave, lead, need))
            mel[~valid] = math.log(FLOOR)
            out.append((list(mel), sound.tolist(), valid.tolist()))
        return left[[*keys, window]].reset_index(drop=True).join(pd.DataFrame(out, columns=shown[-3:]))

    return asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(run, ", ".join([*fields, "mel array<array<double>>", "wave array<smallint>", "valid array<boolean>"]))


def on_grid(df: DataFrame, grid: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """grid (keys, ``_k``, t) with the value at t, linear between a unit's samples; equal times count by their mean.

    One sort of samples and grid by unit and time. Places outside the samples take the nearest one.
    """
    source = df.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, t).agg(F.avg(value).alias("v")).select(*keys, t, F.lit(None).cast("long").alias("_k"), F.struct(F.col(t).alias("t"), "v").alias("_s"))
    both = source.unionByName(grid.select(*keys, t, "_k", F.lit(None).cast(source.schema["_s"].dataType).alias("_s")))
    w = Window.partitionBy(*keys)
    l_ = F.last("_s", ignorenulls=True).over(w.orderBy(F.col(t), F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    r_ = F.last("_s", ignorenulls=True).over(w.orderBy(F.col(t).desc(), F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"_l": l_, "_r": r_}).filter("_k IS NOT NULL").withColumns({"_l": F.coalesce("_l", "_r"), "_r": F.coalesce("_r", "_l")})
    share = F.when(F.col("_r.t") > F.col("_l.t"), (F.col(t) - F.col("_l.t")) / (F.col("_r.t") - F.col("_l.t"))).otherwise(0.0)
    return near.select(*keys, "_k", t, (F.col("_l.v") + share * (F.col("_r.v") - F.col("_l.v"))).alias(value))


def sync_curve(motion: DataFrame, energy: DataFrame, keys: list[str], t: str, value: str, step: float = 0.01, most: float = 0.5) -> DataFrame:
    """How motion and the sound's energy go together at each lag: keys, lag_sec (above 0: sound later) and r.

    Both series on a common grid of ``step`` seconds over the span they share, z-scored (population); r is the mean product,
    NaN where the grid has no more than two lags and two places. Units with one series or no common span give no rows.
    """
    reach = round(most / step)
    spans = [d.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).groupBy(*keys).agg(F.min(t).alias(f"_a{i}"), F.max(t).alias(f"_b{i}")) for i, d in enumerate((motion, energy))]
    span = spans[0].join(spans[1], keys).select(*keys, F.greatest("_a0", "_a1").alias("_a"), F.least("_b0", "_b1").alias("_b"))
    span = span.withColumn("_n", F.ceil((F.col("_b") - F.col("_a")) / step)).filter("_n > 0")
    grid = span.select(*keys, "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k")).select(*keys, "_k", (F.col("_a") + F.col("_k") * step).alias(t))
    x = on_grid(motion, grid, keys, t, value).withColumnRenamed(value, "_x").drop(t)
    both = x.join(on_grid(energy, grid, keys, t, value).withColumnRenamed(value, "_y").drop(t), [*keys, "_k"])
    all_, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_k")
    z = {f"_{c}": (F.col(c) - F.avg(c).over(all_)) / (F.stddev_pop(c).over(all_) + 1e-12) for c in ("_x", "_y")}
    scored = both.withColumns({**z, "_n": F.count("*").over(all_)})
    later = F.array(*[F.lead("__y", k).over(w) if k >= 0 else F.lag("__y", -k).over(w) for k in range(-reach, reach + 1)])
    pairs = scored.withColumn("_ys", later).select(*keys, "_n", "__x", F.posexplode("_ys").alias("_lag", "_other"))
    mean = F.avg(F.col("__x") * F.col("_other"))
    return pairs.groupBy(*keys, "_lag").agg(F.when(F.max("_n") > 2 * reach + 2, mean).otherwise(float("nan")).alias("r")).select(*keys, ((F.col("_lag") - reach) * step).alias("lag_sec"), "r")
