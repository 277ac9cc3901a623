"""Registered queries of rotations over time, faces, splits by count and sound, with their SQL.

On the test tables an embedding is a rotation (its first six values) or a face's points; 40 embeddings in a row are a
clip whose sound comes in chunks of 64 samples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import geometry, timing
from weftline.operators import audio, rotations, splits
from weftline.plans.catalogue import _FRAMES, HOUR, _frames, _table, query

_TURN = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]) AS n FROM e), a AS (SELECT *, e[1]/n AS a1, e[2]/n AS a2, e[3]/n AS a3 FROM n), d AS (SELECT *, a1*e[4]+a2*e[5]+a3*e[6] AS d FROM a),
r AS (SELECT *, e[4]-d*a1 AS r1, e[5]-d*a2 AS r2, e[6]-d*a3 AS r3 FROM d), b AS (SELECT *, r1/sqrt(r1*r1+r2*r2+r3*r3) AS b1, r2/sqrt(r1*r1+r2*r2+r3*r3) AS b2, r3/sqrt(r1*r1+r2*r2+r3*r3) AS b3 FROM r),
c AS (SELECT vec_id, label, acos(greatest(-1.0, least(1.0, (a1 + b2 + a1*b2 - a2*b1 - 1) / 2))) AS angle, b3 - (a3*b1 - a1*b3) AS v1, (a2*b3 - a3*b2) - a3 AS v2, a2 - b1 AS v3 FROM b),
q AS (SELECT vec_id, label, vec_id::DOUBLE AS t, list_transform([2 * sin(angle) * cos(angle / 2) / sin(angle / 2), v1, v2, v3], lambda v: v * sin(angle / 2) / (2 * sin(angle))) AS q FROM c)"""


def _six(spark, sf_dir):
    six = F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").cast("double").alias("t"), six.alias("six"))


@query(f"""WITH {_TURN}, tg AS (SELECT label, t + 0.375 AS t FROM q), lo AS (SELECT tg.label, tg.t, q.t AS t0, q.q AS q0 FROM tg ASOF LEFT JOIN q ON tg.label = q.label AND tg.t >= q.t),
hi AS (SELECT lo.*, coalesce(q.t, t0) AS t1, coalesce(q.q, q0) AS q1 FROM lo ASOF LEFT JOIN q ON lo.label = q.label AND lo.t <= q.t),
s AS (SELECT label, t, q0, q1, CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0.0 END AS w, CASE WHEN list_dot_product(q0, q1) < 0 THEN -1.0 ELSE 1.0 END AS g FROM hi),
m AS (SELECT label, t, list_transform(range(1, 5), lambda i: (1 - w) * q0[i] + w * g * q1[i]) AS u FROM s), k AS (SELECT label, t, list_transform(u, lambda v: v / sqrt(list_dot_product(u, u))) AS k FROM m)
SELECT label, t, round(1 - 2 * (k[3] ** 2 + k[4] ** 2), 4) AS r0, round(2 * (k[2] * k[3] + k[1] * k[4]), 4) AS r1, round(2 * (k[2] * k[4] - k[1] * k[3]), 4) AS r2,
  round(2 * (k[2] * k[3] - k[1] * k[4]), 4) AS r3, round(1 - 2 * (k[2] ** 2 + k[4] ** 2), 4) AS r4, round(2 * (k[3] * k[4] + k[1] * k[2]), 4) AS r5 FROM k""")
def rotation_interpolation(spark, sf_dir):
    """Rotations of a unit between its samples."""
    source = _six(spark, sf_dir)
    found = rotations.interpolate(source, source.withColumn("t", F.col("t") + 0.375), ["label"], "t", "six")
    return found.select("label", "t", *[F.round(F.element_at("six", i + 1), 4).alias(f"r{i}") for i in range(6)])


@query(f"""WITH {_TURN}, f AS (SELECT *, first(q) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM q), g AS (SELECT label, q, CASE WHEN list_dot_product(q, f) < 0 THEN -1.0 ELSE 1.0 END AS g FROM f),
m AS (SELECT label, count(*) AS n, avg(g * q[1]) AS w, avg(g * q[2]) AS x, avg(g * q[3]) AS y, avg(g * q[4]) AS z FROM g GROUP BY 1),
v AS (SELECT label, n, abs(w) AS w, x * sign(w) AS x, y * sign(w) AS y, z * sign(w) AS z, sqrt(x * x + y * y + z * z) AS s FROM m)
SELECT label, round(degrees(2 * atan2(s, w)) * x / s, 1) AS rx, round(degrees(2 * atan2(s, w)) * y / s, 1) AS ry, round(degrees(2 * atan2(s, w)) * z / s, 1) AS rz, n FROM v""")
def mean_rotations(spark, sf_dir):
    """Mean rotation of each unit, about which its rotations are described."""
    return rotations.mean_rotation(_six(spark, sf_dir), ["label"], ["vec_id"], "six")


_POINTS = "e AS (SELECT vec_id, list_transform((embedding::DOUBLE[])[1:63], lambda v: v + 0.4) AS e FROM embeddings), p AS (SELECT vec_id, e, list_transform(range(0, 21), lambda i: e[3 * i + 1]) AS x, list_transform(range(0, 21), lambda i: e[3 * i + 2]) AS y FROM e)"
_EYES = ((0, 1, 2, 3, 4), (5, 6, 7, 8, 9))


def _points(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 63), lambda v: v.cast("double") + 0.4).alias("points"))


@query(f"""WITH {_POINTS} SELECT vec_id, round(len(list_filter(range(1, 22), lambda i: x[i] BETWEEN 0 AND 1 AND y[i] BETWEEN 0 AND 1)) / 21 * least(1.0, greatest(list_max(x) - list_min(x), list_max(y) - list_min(y)) / 0.15), 6) AS confidence FROM p""")
def landmark_confidence(spark, sf_dir):
    """How far a face's points are inside the picture and large enough."""
    return _points(spark, sf_dir).select("vec_id", F.round(geometry.landmark_confidence(F.col("points")), 6).alias("confidence"))


def _eye(k: int, o: int, i: int, u: int, l_: int, c: int) -> str:
    wide = f"sqrt(((x[{o + 1}] - x[{i + 1}]) * 640) ** 2 + ((y[{o + 1}] - y[{i + 1}]) * 360) ** 2)"
    return f"""(x[{c + 1}] - (x[{o + 1}] + x[{i + 1}]) / 2) * 640 / {wide} AS dx{k}, (y[{c + 1}] - (y[{o + 1}] + y[{i + 1}]) / 2) * 360 / {wide} AS dy{k}, sqrt(((x[{u + 1}] - x[{l_ + 1}]) * 640) ** 2 + ((y[{u + 1}] - y[{l_ + 1}]) * 360) ** 2) / {wide} AS o{k}"""


@query(f"""WITH {_POINTS}, s AS (SELECT vec_id, {", ".join(_eye(k, *e) for k, e in enumerate(_EYES))} FROM p)
SELECT vec_id, round(CASE WHEN (o0 + o1) / 2 > 0.12 THEN -1.1 * (dy0 + dy1) / 2 ELSE 'nan'::DOUBLE END, 5) AS pitch, round(CASE WHEN (o0 + o1) / 2 > 0.12 THEN 1.4 * (dx0 + dx1) / 2 ELSE 'nan'::DOUBLE END, 5) AS yaw,
  round(CASE WHEN (o0 + o1) / 2 > 0.12 THEN least(1.0, (o0 + o1) / 2 / 0.24) ELSE 0.0 END, 6) AS confidence FROM s""")
def iris_gaze(spark, sf_dir):
    """Where eyes look, by the irises' places between the corners."""
    pitch, yaw, confidence = geometry.iris_gaze(F.col("points"), F.lit(640), F.lit(360), _EYES)
    return _points(spark, sf_dir).select("vec_id", F.round(pitch, 5).alias("pitch"), F.round(yaw, 5).alias("yaw"), F.round(confidence, 6).alias("confidence"))


@query("""WITH RECURSIVE g AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT k, n, row_number() OVER (ORDER BY md5(concat_ws('/', '0', k::VARCHAR)), k) AS i FROM g), t AS (SELECT sum(n)::DOUBLE AS t FROM g),
w AS (SELECT CAST(round_even(t * 0.15, 0) AS BIGINT) AS x, CAST(t AS BIGINT) AS t FROM t),
s(i, k, n, a, b, c, split) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, t - 2 * x, x, x, '' FROM w
  UNION ALL SELECT o.i, o.k, o.n, a - CASE WHEN a >= b AND a >= c THEN o.n ELSE 0 END, b - CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN o.n ELSE 0 END, c - CASE WHEN NOT (a >= b AND a >= c) AND c > b THEN o.n ELSE 0 END,
    CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END FROM s JOIN o ON o.i = s.i + 1)
SELECT k AS o_custkey, split, 'speaker_disjoint' AS split_kind, n AS n_clips FROM s WHERE i > 0""")
def greedy_split(spark, sf_dir):
    """Clips of each speaker dealt to the split that lacks most."""
    clips = splits.greedy_split(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    return clips.groupBy("o_custkey", "split", "split_kind").agg(F.count("*").alias("n_clips"))


@query("""WITH m AS (SELECT i, 2595.0 * log10(1 + 8000 / 700.0) * i / 81 AS m FROM range(82) t(i)), e AS (SELECT i, 700.0 * (10.0 ** (m / 2595.0) - 1) AS hz FROM m),
w AS (SELECT a.i AS mel, b.i AS bin, least((b.i * 31.25 - a.hz) / (c.hz - a.hz), (d.hz - b.i * 31.25) / (d.hz - c.hz)) AS w FROM e a JOIN e c ON c.i = a.i + 1 JOIN e d ON d.i = a.i + 2 CROSS JOIN range(257) b(i))
SELECT mel, bin, round(w, 6) AS weight FROM w WHERE w > 1e-9""")
def mel_filters(spark, sf_dir):
    """Weights of 80 mel filters over 257 bins."""
    return audio.mel_filters(spark).filter("weight > 1e-9").withColumn("weight", F.round("weight", 6))


_CHUNKS = "ch AS (SELECT vec_id // 40 AS clip, vec_id, (vec_id % 40) * 0.004 + CASE WHEN vec_id % 13 = 0 THEN 0.01 ELSE 0 END AS pts, len(embedding) AS n FROM embeddings WHERE label <> 3), st AS (SELECT *, CAST(round_even((pts - first(pts) OVER w) * 16000, 0) AS BIGINT) AS p FROM ch WINDOW w AS (PARTITION BY clip ORDER BY vec_id))"


def _chunks(spark, sf_dir):
    pts = F.col("vec_id") % 40 * F.lit(0.004) + F.when(F.col("vec_id") % 13 == 0, 0.01).otherwise(0.0)
    return _table(spark, sf_dir, "embeddings").filter("label <> 3").select(F.floor(F.col("vec_id") / 40).alias("clip"), "vec_id", pts.alias("pts"), F.col("embedding").alias("samples"))


@query(f"""WITH {_CHUNKS}, d AS (SELECT *, p - lag(p + n) OVER (PARTITION BY clip ORDER BY vec_id) AS off FROM st) SELECT clip, round(pts, 6) AS at_sec, round(off / 16000, 6) AS jump_sec FROM d WHERE abs(off) > 32""")
def audio_discontinuities(spark, sf_dir):
    """Where sound breaks off between chunks."""
    return audio.discontinuities(_chunks(spark, sf_dir), ["clip"], ["vec_id"], "pts", "samples")


@query(f"""WITH {_CHUNKS}, au AS (SELECT clip, (max(p + n) - min(p)) / 16000 AS audio_sec FROM st GROUP BY 1), f AS (SELECT vec_id // 40 AS clip, vec_id, (vec_id % 40) * 0.004 AS t FROM embeddings WHERE label <> 5),
d AS (SELECT *, t - lag(t) OVER w AS d, lead(t) OVER w IS NULL AS last FROM f WINDOW w AS (PARTITION BY clip ORDER BY vec_id)),
m AS (SELECT clip, count(*) AS n, median(d) AS m, median(d) FILTER (NOT last) AS m2, max(d) FILTER (last) AS tail, max(t) - min(t) AS s FROM d GROUP BY 1),
v AS (SELECT clip, CASE WHEN n > 2 AND tail > 1.5 * m THEN s - tail + m2 WHEN n >= 2 THEN s + m END AS video_sec FROM m)
SELECT clip, round(video_sec, 6) AS video_sec, round(audio_sec, 6) AS audio_sec, CASE WHEN audio_sec IS NULL THEN 'no_audio_stream' WHEN video_sec IS NULL OR abs(round(video_sec - audio_sec, 4)) > 0.1 THEN 'av_duration_mismatch' ELSE 'ok' END AS status FROM v LEFT JOIN au USING (clip)""")
def av_durations(spark, sf_dir):
    """How long picture and sound of each clip are, and whether they end together."""
    frames = _table(spark, sf_dir, "embeddings").filter("label <> 5").select(F.floor(F.col("vec_id") / 40).alias("clip"), "vec_id", (F.col("vec_id") % 40 * F.lit(0.004)).alias("t"))
    both = audio.picture_spans(frames, ["clip"], ["vec_id"], "t").join(audio.sound_spans(_chunks(spark, sf_dir), ["clip"], ["vec_id"], "pts", "samples"), "clip", "left")
    return both.select("clip", F.round("video_sec", 6).alias("video_sec"), F.round("audio_sec", 6).alias("audio_sec"), timing.av_status(F.col("video_sec"), F.col("audio_sec")).alias("status"))


@query()
def log_mel(spark, sf_dir):
    """Mean log power of each mel frame of clips whose sound is whole vectors end to end."""
    clips = _table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 40).alias("clip")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("c"))
    frames = clips.select("clip", audio.log_mel(F.flatten("c.embedding")).alias("mel")).select("clip", F.posexplode("mel").alias("frame", "mel"))
    return frames.select("clip", "frame", F.round(F.aggregate("mel", F.lit(0.0), lambda a, v: a + v) / F.size("mel"), 6).alias("mean"))


@query()
def audio_windows(spark, sf_dir):
    """Sound of two windows of 0.1 seconds a clip, the second of which ends in padding."""
    chunks = _chunks(spark, sf_dir)
    clips = chunks.select("clip").distinct().select("clip", F.explode(F.array(F.lit(0), F.lit(1))).alias("window"))
    windows = clips.select("clip", "window", (F.col("window") * 0.08).alias("t0"), F.when(F.col("window") == 1, 0.12).alias("pad"))
    found = audio.window_audio(windows, chunks, ["clip"], "window", "t0", "vec_id", "pts", "samples", 0.1, "pad")
    return found.select("clip", "window", F.size("mel").alias("n_mel"), F.size(F.filter("valid", lambda v: v)).alias("n_valid"), F.aggregate("wave", F.lit(0).cast("long"), lambda a, v: a + F.abs(v).cast("long")).alias("loudness"))


def _side(name: str, kinds: str) -> str:
    return f"""{name}_s AS (SELECT user_id, t, avg(value) AS v FROM frames WHERE event_type {kinds} GROUP BY 1, 2), {name}_at AS (SELECT gr.user_id, gr.k, gr.t, s.t AS t0, s.v AS v0 FROM gr ASOF LEFT JOIN {name}_s s ON gr.user_id = s.user_id AND gr.t >= s.t),
{name} AS (SELECT a.user_id, a.k, CASE WHEN s.t > t0 THEN v0 + (a.t - t0) / (s.t - t0) * (s.v - v0) ELSE coalesce(v0, s.v) END AS v FROM {name}_at a ASOF LEFT JOIN {name}_s s ON a.user_id = s.user_id AND a.t <= s.t)"""


_DAY = 24 * HOUR


@query(f"""WITH {_FRAMES}, sp AS (SELECT user_id, greatest(min(t) FILTER (event_type = 'click'), min(t) FILTER (event_type <> 'click')) AS a, least(max(t) FILTER (event_type = 'click'), max(t) FILTER (event_type <> 'click')) AS b, count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type <> 'click') AS n2 FROM frames GROUP BY 1),
gr AS (SELECT user_id, k, a + k * {_DAY} AS t FROM (SELECT user_id, a, unnest(range(0, CAST(ceil((b - a) / {_DAY}) AS BIGINT))) AS k FROM sp WHERE n1 > 0 AND n2 > 0 AND b > a)),
{_side("mo", "= 'click'")}, {_side("en", "<> 'click'")}, z AS (SELECT mo.user_id, mo.k, (mo.v - avg(mo.v) OVER w) / (stddev_pop(mo.v) OVER w + 1e-12) AS x, (en.v - avg(en.v) OVER w) / (stddev_pop(en.v) OVER w + 1e-12) AS y, count(*) OVER w AS n FROM mo JOIN en ON en.user_id = mo.user_id AND en.k = mo.k WINDOW w AS (PARTITION BY mo.user_id)),
l AS (SELECT p.user_id, lag, p.n, p.x * q.y AS xy FROM (SELECT *, unnest(range(-3, 4)) AS lag FROM z) p LEFT JOIN z q ON q.user_id = p.user_id AND q.k = p.k + p.lag)
SELECT user_id, lag * {_DAY} AS lag_sec, round(CASE WHEN max(n) > 8 THEN avg(xy) ELSE 'nan'::DOUBLE END, 5) AS r FROM l GROUP BY user_id, lag""")
def sync_curve(spark, sf_dir):
    """Clicks against other events at lags of up to three days."""
    frames = _frames(spark, sf_dir, "event_type")
    motion, energy = (frames.filter(c) for c in ("event_type = 'click'", "event_type <> 'click'"))
    found = audio.sync_curve(motion, energy, ["user_id"], "t", "value", _DAY, 3 * _DAY)
    return found.withColumn("r", F.round("r", 5))
