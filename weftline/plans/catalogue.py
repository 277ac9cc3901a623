"""The registered queries of the time-series engine and their SQL.

On the test tables events are frames (unit: user_id, order: ts and event_id, time: seconds), an error is a frame without
time, embeddings are feature vectors, and orders are clips of speakers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import levels, vectors
from weftline.operators import kernels
from weftline.operators import timeseries as ts
from weftline.sources import tables

FLAGSHIP = "resampled_window_profile"
HOUR = 3600.0
MAX_GAP = 12 * HOUR
QUERIES: dict = {}
ORACLE_SQL: dict = {}
_KEYS = ["user_id"]
_ORDER = ["ts", "event_id"]
_BLEND = levels.QUANTIZERS["blendshape"]
_SHIFT = levels.QUANTIZERS["translation"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Events with the time in seconds, and the frame's number in its unit."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", *more)
    return events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


_FRAMES = "frames AS (SELECT user_id, event_id, ts, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"


def _numbered(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    w = ts._over(_KEYS, _ORDER)
    return _frames(spark, sf_dir, *more).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


_NUMBERED = f"{_FRAMES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM frames)"


@query(f"""
WITH {_FRAMES}, p AS (SELECT *, CASE WHEN event_type <> 'error' THEN t END AS pts FROM frames),
d AS (SELECT *, pts - lag(pts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM p),
m AS (SELECT *, median(d) OVER (PARTITION BY user_id) AS m FROM d)
SELECT user_id, count(*) AS n_frames, count(*) FILTER (pts IS NULL) AS n_missing, count(*) FILTER (d < 0) AS n_backward, count(*) FILTER (d = 0) AS n_duplicate,
  count(*) FILTER (d > 1.5 * m) AS n_gaps, round(min(d), 6) AS step_min, round(max(d), 6) AS step_max, round(median(d), 6) AS step_median, round(max(pts) - min(pts), 6) AS duration,
  count(*) FILTER (d > 0) = count(*) - 1 AS strictly_monotonic
FROM m GROUP BY user_id
""")
def timeline_audit(spark, sf_dir):
    frames = _frames(spark, sf_dir, "event_type").withColumn("pts", F.when(F.col("event_type") != "error", F.col("t")))
    out = ts.audit(frames, _KEYS, _ORDER, "pts")
    return out.withColumns({c: F.round(c, 6) for c in ("step_min", "step_max", "step_median", "duration")})


@query(f"""
WITH {_NUMBERED}
SELECT event_id, CAST(idx + greatest(0, max(CAST(round_even(t * 1000, 0) AS BIGINT) - idx) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS clock_ms FROM numbered
""")
def tracker_clock(spark, sf_dir):
    return ts.increasing_clock(_frames(spark, sf_dir), _KEYS, _ORDER, "t").select("event_id", "clock_ms")


@query(f"""
WITH {_FRAMES}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM frames)
SELECT user_id, round(CASE WHEN median(d) > 0 THEN 1 / median(d) END, 12) AS rate FROM d GROUP BY user_id
""")
def effective_rate(spark, sf_dir):
    return ts.rate(_frames(spark, sf_dir), _KEYS, _ORDER, "t").withColumn("rate", F.round("rate", 12))


_SEGMENTS = f"""{_FRAMES}, valid AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {MAX_GAP} THEN 1 ELSE 0 END AS new FROM frames WHERE event_type <> 'error'),
numbered_segments AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM valid),
segments AS (SELECT * FROM numbered_segments QUALIFY count(*) OVER (PARTITION BY user_id, segment_id) >= 2)"""


def _segments(spark, sf_dir):
    return ts.segments(_frames(spark, sf_dir, "event_type"), _KEYS, _ORDER, "t", MAX_GAP, F.col("event_type") != "error")


@query(f"WITH {_SEGMENTS} SELECT user_id, segment_id, count(*) AS n, min(t) AS t_start, max(t) AS t_stop FROM segments GROUP BY 1, 2")
def gap_segments(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("user_id", "segment_id").agg(F.count("*").alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_stop"))


_GRID = f"""{_SEGMENTS}, stepped AS (SELECT user_id, segment_id, t AS st, value AS v, event_id AS s, lead(t) OVER w AS nt, lead(value) OVER w AS nv, lead(event_id) OVER w AS ns FROM segments WINDOW w AS (PARTITION BY user_id, segment_id ORDER BY t, event_id)),
sampled AS (SELECT *, median(nt - st) OVER (PARTITION BY user_id, segment_id) AS m FROM stepped),
spans AS (SELECT user_id, segment_id, min(st) AS a, max(st) AS b FROM sampled GROUP BY 1, 2),
points AS (SELECT user_id, segment_id, g AS grid_idx, a + g * {HOUR} AS t_sec FROM spans, unnest(generate_series(0, CAST(floor((b - a) / {HOUR} + 1e-9) AS BIGINT))) AS u(g)),
bracketed AS (SELECT p.user_id, p.segment_id, grid_idx, t_sec, st, v, s, nt, nv, ns, m, nt IS NOT NULL AND t_sec > st AS inside FROM points p ASOF JOIN sampled x ON p.user_id = x.user_id AND p.segment_id = x.segment_id AND p.t_sec >= x.st),
grid AS (SELECT user_id, segment_id, grid_idx, t_sec, CASE WHEN inside THEN v + (nv - v) * (t_sec - st) / (nt - st) ELSE v END AS value,
  CASE WHEN inside AND nt - t_sec < t_sec - st THEN ns ELSE s END AS source, coalesce(inside AND nt - st > 1.5 * m AND least(t_sec - st, nt - t_sec) > 0.5 * m + 1e-9, false) AS is_gap_filled FROM bracketed)"""


def _grid(spark, sf_dir):
    return ts.resample(_segments(spark, sf_dir), ["user_id", "segment_id"], "t", "value", "event_id", HOUR)


@query(f"WITH {_GRID} SELECT user_id, segment_id, grid_idx, t_sec, round(value, 6) AS value, source, is_gap_filled FROM grid")
def resample_linear(spark, sf_dir):
    return _grid(spark, sf_dir).withColumn("value", F.round("value", 6))


_WINDOWS = f"""{_GRID}, sizes AS (SELECT user_id, segment_id, max(grid_idx) + 1 AS n FROM grid GROUP BY 1, 2),
starts AS (SELECT user_id, segment_id, n, w * 12 AS window_start FROM sizes, unnest(generate_series(0, CASE WHEN n <= 24 THEN 0 ELSE CAST(ceil((n - 24) / 12.0) AS BIGINT) END)) AS u(w)),
sliced AS (SELECT s.user_id, s.segment_id, window_start, k, value, is_gap_filled, window_start + k >= n AS is_padding FROM starts s, unnest(generate_series(0, 23)) AS u(k)
  JOIN grid g ON g.user_id = s.user_id AND g.segment_id = s.segment_id AND g.grid_idx = least(window_start + k, n - 1))"""


def _windows(spark, sf_dir):
    return ts.slice_windows(_grid(spark, sf_dir), ["user_id", "segment_id"], "grid_idx", ["value", "is_gap_filled"], 24, ts.hop_of(24, 0.5))


@query(f"WITH {_WINDOWS} SELECT user_id, segment_id, window_start, k, round(value, 6) AS value, is_gap_filled, is_padding FROM sliced")
def slice_windows(spark, sf_dir):
    return _windows(spark, sf_dir).withColumn("value", F.round("value", 6))


@query(f"""WITH {_WINDOWS} SELECT user_id, segment_id, window_start, round(avg(value) FILTER (NOT is_padding), 6) AS mean_value, round(max(value) FILTER (NOT is_padding), 6) AS max_value,
  round(avg(CASE WHEN is_padding OR is_gap_filled THEN 0.0 ELSE 1.0 END), 6) AS valid_fraction FROM sliced GROUP BY 1, 2, 3""")
def resampled_window_profile(spark, sf_dir):
    real = F.when(~F.col("is_padding"), F.col("value"))
    valid = F.when(F.col("is_padding") | F.col("is_gap_filled"), 0.0).otherwise(1.0)
    return _windows(spark, sf_dir).groupBy("user_id", "segment_id", "window_start").agg(F.round(F.avg(real), 6).alias("mean_value"), F.round(F.max(real), 6).alias("max_value"), F.round(F.avg(valid), 6).alias("valid_fraction"))


@query(f"""WITH {_WINDOWS}, weighted AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * k / 23) + 1e-6 AS w FROM sliced WHERE NOT is_padding)
SELECT user_id, segment_id, window_start + k AS idx, round(sum(value * w) / sum(w), 6) AS value, count(*) AS n_windows FROM weighted GROUP BY 1, 2, 3""")
def overlap_add(spark, sf_dir):
    return ts.overlap_add(_windows(spark, sf_dir), ["user_id", "segment_id"], "value", 24).withColumn("value", F.round("value", 6))


@query(f"WITH {_GRID} SELECT user_id, segment_id, grid_idx AS idx, round(value, 6) AS value FROM grid")
def stitch_windows(spark, sf_dir):
    return ts.stitch(_windows(spark, sf_dir), ["user_id", "segment_id"], "value").withColumn("value", F.round("value", 6))


def _slope(name: str, source: str, table: str) -> str:
    return f"""{name} AS (SELECT user_id, event_id, ts, t, CASE WHEN hs IS NULL AND hd IS NULL THEN NULL WHEN hs IS NULL THEN (q - {source}) / hd WHEN hd IS NULL THEN ({source} - p) / hs
  ELSE (hs * hs * q + (hd * hd - hs * hs) * {source} - hd * hd * p) / (hs * hd * (hs + hd)) END AS {name}, value FROM (SELECT *, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag({source}) OVER w AS p, lead({source}) OVER w AS q
  FROM {table} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


@query(f"WITH {_FRAMES}, hours AS (SELECT * REPLACE (t / {HOUR} AS t) FROM frames), {_slope('velocity', 'value', 'hours')} SELECT event_id, round(velocity, 3) AS velocity FROM velocity")
def velocity(spark, sf_dir):
    hours = _frames(spark, sf_dir).withColumn("t", F.col("t") / HOUR)
    return ts.gradient(hours, _KEYS, _ORDER, "t", "value", "velocity").select("event_id", F.round("velocity", 3).alias("velocity"))


@query(f"""WITH {_FRAMES}, weighted AS (SELECT *, least(value, 100) / 100 AS w, date_trunc('month', ts) AS segment FROM frames)
SELECT event_id, round(CASE WHEN lead(segment) OVER o = segment THEN least(w, lead(w) OVER o) ELSE 0.0 END, 9) AS derivative_weight FROM weighted WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def derivative_weights(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumns({"w": F.least(F.col("value"), F.lit(100.0)) / 100, "segment": F.date_trunc("month", "ts")})
    return ts.derivative_weight(rows, _KEYS, _ORDER, "segment", "w", 2).select("event_id", F.round("derivative_weight", 9).alias("derivative_weight"))


@query("""SELECT event_id, round(CASE WHEN event_type = 'signup' THEN 0.0 WHEN event_type = 'click' THEN 0.25 WHEN event_type = 'error' THEN 0.0 ELSE greatest(0.0, least(1.0, value / 100)) END, 9) AS loss_weight FROM events""")
def loss_weight(spark, sf_dir):
    kind = F.col("event_type")
    weight = ts.loss_weight(F.col("value") / 100, kind != "error", kind == "click", kind == "signup", 0.25)
    return _table(spark, sf_dir, "events").select("event_id", F.round(weight, 9).alias("loss_weight"))


@query(f"""WITH {_NUMBERED}, good AS (SELECT *, value > 10 AS ok, max(CASE WHEN value > 10 THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS li,
  min(CASE WHEN value > 10 THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM numbered)
SELECT g.event_id, NOT g.ok AS was_low, round(CASE WHEN g.ok OR l.idx IS NULL AND r.idx IS NULL THEN g.value WHEN l.idx IS NULL THEN r.value WHEN r.idx IS NULL THEN l.value
  ELSE l.value + (r.value - l.value) * (g.idx - l.idx) / (r.idx - l.idx) END, 6) AS filled
FROM good g LEFT JOIN numbered l ON l.user_id = g.user_id AND l.idx = g.li LEFT JOIN numbered r ON r.user_id = g.user_id AND r.idx = g.ri""")
def fill_low_confidence(spark, sf_dir):
    rows = _numbered(spark, sf_dir).withColumn("q", F.col("value"))
    return ts.fill_low(rows, _KEYS, "idx", "value", "q", 10.0).select("event_id", "was_low", F.round("filled", 6).alias("filled"))


_LEVEL = "((abs(x) >= 0.1)::INT + (abs(x) >= 0.3)::INT + (abs(x) >= 0.8)::INT) * sign(x)::INT"
_LEVELS = f"""{_NUMBERED}, scaled AS (SELECT *, (value - 50) / 50 AS x FROM numbered), leveled AS (SELECT *, {_LEVEL} AS level FROM scaled)"""


def _leveled(spark, sf_dir):
    rows = _numbered(spark, sf_dir, "event_type").withColumn("x", (F.col("value") - 50) / 50)
    return rows.withColumn("level", _SHIFT.level(F.col("x")))


@query(f"""WITH {_LEVELS} SELECT event_id, level, CASE WHEN level > 0 THEN '+' WHEN level < 0 THEN '-' ELSE '' END || ['none', 'slight', 'moderate', 'strong'][abs(level) + 1] AS label,
  sign(level) * [0.0, 0.2, 0.55, 1.2][abs(level) + 1]::DOUBLE AS represented, round(abs(x - sign(level) * [0.0, 0.2, 0.55, 1.2][abs(level) + 1]::DOUBLE), 9) AS error FROM leveled""")
def quantize_levels(spark, sf_dir):
    value = _SHIFT.value(F.col("level"))
    return _leveled(spark, sf_dir).select("event_id", "level", levels.label(F.col("level")).alias("label"), value.alias("represented"), F.round(F.abs(F.col("x") - value), 9).alias("error"))


_RUNS = f"""{_LEVELS}, described AS (SELECT * FROM leveled WHERE event_type <> 'error'), marked AS (SELECT *, CASE WHEN lag(level) OVER o = level AND lag(idx) OVER o = idx - 1 THEN 0 ELSE 1 END AS new FROM described WINDOW o AS (PARTITION BY user_id ORDER BY idx)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM marked),
level_runs AS (SELECT user_id, level, min(idx) AS run_start, max(idx) + 1 AS run_stop, count(*) AS n FROM grouped GROUP BY user_id, level, g)"""


def _runs(spark, sf_dir):
    return ts.runs(_leveled(spark, sf_dir), _KEYS, "idx", "level", F.col("event_type") != "error")


@query(f"WITH {_RUNS} SELECT * FROM level_runs")
def rle_segments(spark, sf_dir):
    return _runs(spark, sf_dir)


@query("""WITH m AS (SELECT *, CASE WHEN lag(role) OVER o = role AND lag(turn) OVER o = turn - 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT conv_id, role, min(turn) AS run_start, max(turn) + 1 AS run_stop, count(*) AS n FROM g GROUP BY conv_id, role, g""")
def role_runs(spark, sf_dir):
    return ts.runs(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


@query()
def merge_short_runs(spark, sf_dir):
    return kernels.merge_short_runs(_runs(spark, sf_dir), _KEYS, 3)


@query()
def whittaker_smooth(spark, sf_dir):
    return kernels.smooth(_numbered(spark, sf_dir), _KEYS, "idx", "value").withColumn("smoothed", F.round("smoothed", 6))


@query(f"""WITH {_RUNS}, coarse AS (SELECT user_id, run_start, run_stop, level > 0 AS positive FROM level_runs), m AS (SELECT *, CASE WHEN lag(run_stop) OVER o = run_start AND lag(positive) OVER o = positive THEN 0 ELSE 1 END AS new FROM coarse WINDOW o AS (PARTITION BY user_id ORDER BY run_start)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY run_start ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, positive, min(run_start) AS run_start, max(run_stop) AS run_stop FROM g GROUP BY user_id, positive, g""")
def merge_segments(spark, sf_dir):
    coarse = _runs(spark, sf_dir).select("user_id", "run_start", "run_stop", (F.col("level") > 0).alias("positive"))
    return ts.merge_touching(coarse, _KEYS, "run_start", "run_stop", ["positive"])


@query(f"""WITH {_NUMBERED}, s AS (SELECT user_id, idx AS a, idx + 1 + CAST(floor(value / 60) AS BIGINT) AS b FROM numbered WHERE value > 60),
m AS (SELECT *, CASE WHEN a >= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS cluster_start, max(b) AS cluster_stop, count(*) AS n FROM g GROUP BY user_id, g""")
def cluster_intervals(spark, sf_dir):
    spans = _numbered(spark, sf_dir).filter("value > 60").select("user_id", F.col("idx").alias("a"), (F.col("idx") + 1 + F.floor(F.col("value") / 60)).alias("b"))
    return ts.cluster(spans, _KEYS, "a", "b")


@query(f"""WITH {_RUNS}, cuts AS (SELECT DISTINCT user_id, idx AS c FROM numbered WHERE event_type = 'signup'),
edges AS (SELECT user_id, run_start AS r, run_stop AS stop, level, run_start AS e FROM level_runs UNION ALL SELECT l.user_id, run_start, run_stop, level, c FROM level_runs l JOIN cuts ON cuts.user_id = l.user_id AND c > run_start AND c < run_stop)
SELECT user_id, level, e AS run_start, coalesce(lead(e) OVER (PARTITION BY user_id, r ORDER BY e), stop) AS run_stop FROM edges""")
def split_segments(spark, sf_dir):
    cuts = _numbered(spark, sf_dir, "event_type").filter("event_type = 'signup'").select("user_id", F.col("idx").alias("c"))
    return ts.split_at(_runs(spark, sf_dir), _KEYS, "run_start", "run_stop", cuts, "c").select("user_id", "level", "run_start", "run_stop")


@query("""SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50,
  count(*) FILTER (value <= 5) AS n_low, count(*) FILTER (value <= 5 AND event_type <> 'error') AS n_low_but_tracked, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS failure_rate,
  CASE WHEN count(*) FILTER (event_type = 'error') / count(*) <= 0.05 THEN 'usable' WHEN count(*) FILTER (event_type = 'error') / count(*) <= 0.3 THEN 'low_quality' ELSE 'reject' END AS label FROM events GROUP BY user_id""")
def confidence_stats(spark, sf_dir):
    failed = F.count_if(F.col("event_type") == "error") / F.count("*")
    p = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5)))
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(p[0], 6).alias("p05"), F.round(p[1], 6).alias("p50"),
        F.count_if(F.col("value") <= 5).alias("n_low"), F.count_if((F.col("value") <= 5) & (F.col("event_type") != "error")).alias("n_low_but_tracked"), F.round(failed, 4).alias("failure_rate"),
        F.when(failed <= 0.05, "usable").when(failed <= 0.3, "low_quality").otherwise("reject").alias("label"),
    )


@query("SELECT event_id, round(value - avg(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id), 6) AS centred FROM events")
def clip_mean_centred(spark, sf_dir):
    mean = F.avg(F.when(F.col("event_type") != "error", F.col("value"))).over(ts.Window.partitionBy("user_id"))
    return _table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") - mean, 6).alias("centred"))


_SPLIT = "CASE WHEN (o_custkey * 2654435761) % 100 < 70 THEN 'train' WHEN (o_custkey * 2654435761) % 100 < 85 THEN 'val' ELSE 'test' END"


def split_of(key: Column) -> Column:
    """Split of a speaker by a portable hash: 70 % train, 15 % val, 15 % test; all clips of a speaker fall together."""
    h = tables.spread_key(key, 100)
    return F.when(h < 70, "train").when(h < 85, "val").otherwise("test")


@query(f"SELECT {_SPLIT} AS split, count(*) AS n_clips, count(DISTINCT o_custkey) AS n_speakers FROM orders GROUP BY 1")
def split_counts(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy(split_of(F.col("o_custkey")).alias("split")).agg(F.count("*").alias("n_clips"), F.countDistinct("o_custkey").alias("n_speakers"))


def leaking(assigned: DataFrame, speaker: str, split: str) -> DataFrame:
    """Speakers whose clips an assignment puts in more than one split, with the number of splits."""
    return assigned.groupBy(speaker).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


@query(f"""WITH a AS (SELECT o_custkey, {_SPLIT} AS by_speaker, {_SPLIT.replace("o_custkey", "o_orderkey")} AS by_clip FROM orders)
SELECT 'speaker_disjoint' AS kind, count(*) AS n_leaking, coalesce(sum(n), 0)::BIGINT AS n_splits FROM (SELECT count(DISTINCT by_speaker) AS n FROM a GROUP BY o_custkey HAVING n > 1)
UNION ALL SELECT 'clip_disjoint', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(DISTINCT by_clip) AS n FROM a GROUP BY o_custkey HAVING n > 1)""")
def leakage_check(spark, sf_dir):
    """Speakers that leak where clips are assigned by speaker, and where by clip, as without known speakers."""
    orders = _table(spark, sf_dir, "orders")
    assigned = orders.select("o_custkey", split_of(F.col("o_custkey")).alias("by_speaker"), split_of(F.col("o_orderkey")).alias("by_clip"))
    found = [leaking(assigned, "o_custkey", c).agg(F.lit(kind).alias("kind"), F.count("*").alias("n_leaking"), F.coalesce(F.sum("n_splits"), F.lit(0)).alias("n_splits")) for c, kind in (("by_speaker", "speaker_disjoint"), ("by_clip", "clip_disjoint"))]
    return found[0].unionByName(found[1])


@query("""WITH d AS (SELECT unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x, label FROM embeddings) SELECT dim, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-8), 6) AS std FROM d WHERE label < 7 GROUP BY dim""")
def fit_normalization(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").filter("label < 7").select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("x"), F.lit(1e-8)), 6).alias("std"))


@query("""WITH d AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(sum(CASE WHEN dim < 52 THEN 2 * x - 1 ELSE x END), 5) AS total, round(sqrt(sum(x * x)), 5) AS norm FROM d GROUP BY vec_id""")
def symmetric_and_norm(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    both = vectors.assemble([(vectors.channel(x, 0, 52), 52), (vectors.channel(x, 52, 12), 12)])
    total = F.aggregate(vectors.symmetric(both, 52), F.lit(0.0), lambda a, v: a + v)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 5).alias("total"), F.round(vectors.norm(both), 5).alias("norm"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), n AS (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]) AS n FROM e), a AS (SELECT *, e[1]/n AS a1, e[2]/n AS a2, e[3]/n AS a3 FROM n), d AS (SELECT *, a1*e[4]+a2*e[5]+a3*e[6] AS d FROM a),
r AS (SELECT *, e[4]-d*a1 AS r1, e[5]-d*a2 AS r2, e[6]-d*a3 AS r3 FROM d), b AS (SELECT *, r1/sqrt(r1*r1+r2*r2+r3*r3) AS b1, r2/sqrt(r1*r1+r2*r2+r3*r3) AS b2, r3/sqrt(r1*r1+r2*r2+r3*r3) AS b3 FROM r)
SELECT vec_id, round(a1 + b2 + a1*b2 - a2*b1, 6) AS trace, round(acos(greatest(-1.0, least(1.0, (a1 + b2 + a1*b2 - a2*b1 - 1) / 2))), 5) AS angle FROM b""")
def rotation_angle(spark, sf_dir):
    r = vectors.rotation_columns([F.element_at("embedding", i).cast("double") for i in range(1, 7)])
    identity = [F.lit(float(i % 4 == 0)) for i in range(9)]
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(r[0] + r[4] + r[8], 6).alias("trace"), F.round(vectors.geodesic(r, identity), 5).alias("angle"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT q.vec_id AS query_id, b.vec_id AS exemplar_id, round(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS cost
  FROM q JOIN embeddings b ON b.label = q.label AND b.vec_id <> q.vec_id)
SELECT query_id, exemplar_id, cost, row_number() OVER (PARTITION BY query_id ORDER BY cost, exemplar_id) AS rank FROM c QUALIFY rank <= 5""")
def retrieve_topk(spark, sf_dir):
    bank = _table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))
    asked = bank.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    cost = F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    pairs = asked.join(bank, "label").filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("exemplar_id"), F.round(cost, 6).alias("cost"))
    w = ts.Window.partitionBy("query_id").orderBy("cost", "exemplar_id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5")


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 250000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 2654435761) % 1000003, o_orderkey) = 1""")
def sample_one_per_speaker(spark, sf_dir):
    w = ts.Window.partitionBy("o_custkey").orderBy(tables.spread_key(F.col("o_orderkey"), 1_000_003), "o_orderkey")
    rows = _table(spark, sf_dir, "orders").filter("o_totalprice BETWEEN 50000 AND 250000").withColumn("r", F.row_number().over(w))
    return rows.filter("r = 1").select("o_custkey", "o_orderkey")


@query("""SELECT p_brand, count(*) AS n_parts, count(l_partkey) AS n_lines, count(*) FILTER (l_partkey IS NULL) AS n_missing, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def metadata_left_join(spark, sf_dir):
    # Lines are summed by part before the join, so no part's lines meet in one task.
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    both = _table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return both.groupBy("p_brand").agg(F.sum(F.greatest(n, F.lit(1))).alias("n_parts"), F.sum(n).alias("n_lines"), F.count_if(F.col("l_partkey").isNull()).alias("n_missing"), F.round(F.coalesce(F.sum("q"), F.lit(0.0)), 2).alias("quantity"))
