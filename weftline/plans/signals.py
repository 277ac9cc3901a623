"""Registered queries of events, geometry, names, quality control and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import geometry, names, vectors
from weftline.operators import events
from weftline.operators import timeseries as ts
from weftline.plans.catalogue import _FRAMES, _KEYS, _LEVELS, _NUMBERED, _RUNS, _frames, _leveled, _numbered, _runs, _segments, _SEGMENTS, _SHIFT, _table, query
from weftline.sources import tables
from weftline.streaming import live

# Two channels a frame: the event's value, not covered on errors, and the number in its props.
_LONG = f"""{_NUMBERED.replace("event_type, value,", "event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,")},
long AS (SELECT user_id, idx, 'value' AS ref, value AS v, event_type <> 'error' AS covered FROM numbered UNION ALL SELECT user_id, idx, 'k', k, true FROM numbered),
rest AS (SELECT user_id, ref, round(coalesce(median(CASE WHEN covered THEN v END), 0), 4) AS rest FROM long GROUP BY 1, 2),
devs AS (SELECT l.*, v - rest AS dev FROM long l JOIN rest r ON r.user_id = l.user_id AND r.ref = l.ref)"""


def _long(spark, sf_dir):
    rows = _numbered(spark, sf_dir, "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    value = F.struct(F.lit("value").alias("ref"), F.col("value").alias("v"), (F.col("event_type") != "error").alias("covered"))
    k = F.struct(F.lit("k").alias("ref"), F.col("k").alias("v"), F.lit(True).alias("covered"))
    return rows.select("user_id", "idx", F.inline(F.array(value, k)))


@query(f"WITH {_LONG} SELECT user_id, ref, rest FROM rest")
def rest_values(spark, sf_dir):
    return events.rest_values(_long(spark, sf_dir), _KEYS)


def _found(name: str, drivers: str, members: str, n: int, low: float, high: float, least: float, most: float, signs: str) -> str:
    return f"""{name}_hot AS (SELECT user_id, ref, idx, sign, sign * dev AS up, idx - row_number() OVER (PARTITION BY user_id, ref, sign ORDER BY idx) AS g FROM devs, (VALUES {signs}) AS s(sign) WHERE covered AND ref IN ({drivers}) AND sign * dev >= {low}),
{name}_runs AS (SELECT user_id, ref, min(idx) AS s, max(idx) + 1 AS e FROM {name}_hot GROUP BY user_id, ref, sign, g HAVING max(up) >= {high}),
{name}_marked AS (SELECT *, CASE WHEN s >= max(e) OVER (PARTITION BY user_id ORDER BY s, e, ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {name}_runs),
{name}_numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e, ref ROWS UNBOUNDED PRECEDING) AS c FROM {name}_marked),
{name}_spans AS (SELECT user_id, min(s) AS start, max(e) AS stop, list_sort(list(DISTINCT ref)) AS active FROM {name}_numbered GROUP BY user_id, c),
{name}_in AS (SELECT d.*, start, stop, active FROM {name}_spans p JOIN devs d ON d.user_id = p.user_id AND d.idx >= start AND d.idx < stop AND d.ref IN ({members})),
{name}_whole AS (SELECT user_id, start, count(*) FILTER (covered) = (max(stop) - start) * {n} AS whole FROM {name}_in GROUP BY 1, 2),
{name}_top AS (SELECT * FROM (SELECT user_id, start, ref AS driver, max(abs(dev)) AS extreme FROM {name}_in WHERE list_contains(active, ref) GROUP BY user_id, start, ref) QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY extreme DESC, driver) = 1),
{name}_peak AS (SELECT i.user_id, i.start, min(idx) AS first_peak, max(idx) AS last_peak, arg_min(dev, idx) AS p, list(idx) AS at FROM {name}_in i JOIN {name}_top t ON t.user_id = i.user_id AND t.start = i.start AND i.ref = driver AND abs(dev) = extreme GROUP BY 1, 2),
{name} AS (SELECT s.user_id, s.start, s.stop, CASE WHEN s.stop - s.start < {least} - 1e-9 THEN 'too_short' WHEN s.stop - s.start > {most} + 1e-9 THEN 'too_long' WHEN NOT whole THEN 'not_fully_described' END AS reason, driver,
  CASE WHEN p > 0 THEN '+' ELSE '-' END AS direction, first_peak, last_peak, first_peak - s.start AS onset, s.stop - 1 - last_peak AS "offset",
  (SELECT round(avg(dev), 4) FROM {name}_in i WHERE i.user_id = s.user_id AND i.start = s.start AND i.ref = driver AND list_contains(k.at, i.idx)) AS driver_dev
  FROM {name}_spans s JOIN {name}_whole w USING (user_id, start) JOIN {name}_top USING (user_id, start) JOIN {name}_peak k USING (user_id, start))"""


_SURGE = _found("surge", "'value'", "'value', 'k'", 2, 20.0, 60.0, 1, 4, "(1)")
_SWING = _found("swing", "'k', 'value'", "'k', 'value'", 2, 15.0, 45.0, 2, 12, "(1), (-1)")


def _kinds(spark, sf_dir):
    devs = events.deviations(_long(spark, sf_dir), _KEYS)
    surge = events.excursions(devs, _KEYS, ["value"], ["value", "k"], 20.0, 60.0, 1, 4)
    swing = events.excursions(devs, _KEYS, ["k", "value"], ["k", "value"], 15.0, 45.0, 2, 12, signed=True)
    return surge, swing


def _shown(found):
    dev = F.round(F.element_at("channel_dev", F.col("driver")), 3)
    return found.select("user_id", "start", "stop", "reason", "driver", "direction", "first_peak", "last_peak", "onset", "offset", dev.alias("driver_dev"))


@query(f'WITH {_LONG}, {_SURGE} SELECT user_id, start, stop, reason, driver, direction, first_peak, last_peak, onset::DOUBLE AS onset, "offset"::DOUBLE AS "offset", round(driver_dev, 3) AS driver_dev FROM surge')
def excursions(spark, sf_dir):
    return _shown(_kinds(spark, sf_dir)[0])


@query(f'WITH {_LONG}, {_SWING} SELECT user_id, start, stop, reason, driver, direction, first_peak, last_peak, onset::DOUBLE AS onset, "offset"::DOUBLE AS "offset", round(driver_dev, 3) AS driver_dev FROM swing')
def signed_excursions(spark, sf_dir):
    return _shown(_kinds(spark, sf_dir)[1])


_CLAIMS = f"""{_LONG}, {_SURGE}, {_SWING}, won AS (SELECT user_id, start, stop FROM surge WHERE reason IS NULL),
claims AS (SELECT user_id, 'surge' AS kind, start, stop, NULL::VARCHAR AS reason FROM won UNION ALL
SELECT user_id, 'swing', start, stop, CASE WHEN EXISTS (SELECT 1 FROM won w WHERE w.user_id = s.user_id AND w.start < s.stop AND s.start < w.stop) THEN 'claimed_by_higher_priority' END FROM swing s WHERE s.reason IS NULL)"""


def _claims(spark, sf_dir):
    surge, swing = (f.filter("reason IS NULL") for f in _kinds(spark, sf_dir))
    return events.claim([("swing", 1, ["k", "value"], swing), ("surge", 2, ["value", "k"], surge)], _KEYS)


@query(f"WITH {_CLAIMS} SELECT * FROM claims")
def claim_events(spark, sf_dir):
    return _claims(spark, sf_dir)


@query(f"WITH {_CLAIMS}, per AS (SELECT user_id, count(*) AS frames FROM numbered GROUP BY 1), kept AS (SELECT user_id, sum(stop - start) AS n FROM claims WHERE reason IS NULL GROUP BY 1) SELECT user_id, round(coalesce(n, 0) / frames, 6) AS coverage FROM per LEFT JOIN kept USING (user_id)")
def event_coverage(spark, sf_dir):
    frames = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frames"))
    kept = _claims(spark, sf_dir).filter("reason IS NULL").groupBy("user_id").agg(F.sum(F.col("stop") - F.col("start")).alias("n"))
    return frames.join(kept, "user_id", "left").select("user_id", F.round(F.coalesce("n", F.lit(0)) / F.col("frames"), 6).alias("coverage"))


@query(f"WITH {_RUNS} SELECT user_id, level, run_start, run_stop FROM level_runs")
def exact_round_trip(spark, sf_dir):
    """Runs cut at the claimed events' ends, then joined again: the runs as they were."""
    runs = _runs(spark, sf_dir).select("user_id", "run_start", "run_stop", "level")
    cuts = _claims(spark, sf_dir).filter("reason IS NULL").select("user_id", F.explode(F.array("start", "stop")).alias("c"))
    pieces = ts.split_at(runs, _KEYS, "run_start", "run_stop", cuts, "c")
    return ts.merge_touching(pieces, _KEYS, "run_start", "run_stop", ["level"]).select("user_id", "level", "run_start", "run_stop")


@query(f"""WITH {_FRAMES}, q AS (SELECT * FROM frames WHERE event_type = 'error'), f AS (SELECT * FROM frames WHERE event_type <> 'error'),
l AS (SELECT q.user_id, q.event_id, q.t, f.t AS lt, f.event_id AS l FROM q ASOF LEFT JOIN f ON f.user_id = q.user_id AND q.t >= f.t)
SELECT l.event_id, CASE WHEN l.l IS NULL OR r.t - l.t < l.t - lt THEN r.event_id ELSE l.l END AS nearest FROM l ASOF LEFT JOIN f r ON r.user_id = l.user_id AND l.t <= r.t""")
def nearest_frame(spark, sf_dir):
    frames = _frames(spark, sf_dir, "event_type")
    asked = frames.filter("event_type = 'error'").select("user_id", "event_id", "t")
    return events.nearest(asked, frames.filter("event_type <> 'error'").select("user_id", "t", F.col("event_id").alias("s")), _KEYS, "t", "s").select("event_id", "nearest")


@query(f"""WITH {_NUMBERED.replace("event_type, value,", "event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,")},
z AS (SELECT user_id, idx, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS x, (k - avg(k) OVER w) / nullif(stddev_pop(k) OVER w, 0) AS y FROM numbered WINDOW w AS (PARTITION BY user_id))
SELECT a.user_id, g AS lag, round(avg(a.x * b.y), 6) AS r, count(*) AS n FROM z a, generate_series(-5, 5) AS u(g), z b WHERE b.user_id = a.user_id AND b.idx = a.idx + g AND a.x IS NOT NULL AND b.y IS NOT NULL GROUP BY 1, 2""")
def lag_curve(spark, sf_dir):
    rows = _numbered(spark, sf_dir, "props").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return events.lag_curve(rows, _KEYS, "idx", "value", "k", 5).select("user_id", F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"), "n")


@query(f"""WITH {_LEVELS}, e AS (SELECT *, x - sign(level) * [0.0, 0.2, 0.55, 1.2][abs(level) + 1]::DOUBLE AS d FROM leveled)
SELECT event_type, count(*) AS n, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(max(abs(d)), 6) AS worst, round(avg(d), 6) AS bias FROM e GROUP BY 1""")
def value_errors(spark, sf_dir):
    d = F.col("x") - _SHIFT.value(F.col("level"))
    return _leveled(spark, sf_dir).withColumn("d", d).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs("d")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rmse"), F.round(F.max(F.abs("d")), 6).alias("worst"), F.round(F.avg("d"), 6).alias("bias"),
    )


@query(f"WITH {_RUNS}, per AS (SELECT n.user_id, count(r.user_id) AS c FROM (SELECT DISTINCT user_id FROM numbered) n LEFT JOIN level_runs r ON r.user_id = n.user_id GROUP BY 1) SELECT sum(c)::BIGINT AS n_segments, round(avg(c), 6) AS mean_a_unit, max(c) AS max_a_unit FROM per")
def text_statistics(spark, sf_dir):
    units = _table(spark, sf_dir, "events").select("user_id").distinct()
    per = units.join(_runs(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("c")), "user_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return per.agg(F.sum("c").alias("n_segments"), F.round(F.avg("c"), 6).alias("mean_a_unit"), F.max("c").alias("max_a_unit"))


@query(f"""WITH {_SEGMENTS}, a AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS seen FROM frames GROUP BY 1), l AS (SELECT user_id, max(c) AS longest FROM (SELECT user_id, count(*) AS c FROM segments GROUP BY user_id, segment_id) GROUP BY 1)
SELECT a.user_id, CASE WHEN n < 20 THEN 'too_short' WHEN seen / n < 0.7 THEN 'low_detection_rate' WHEN longest IS NULL THEN 'no_continuous_segment' WHEN longest < 4 THEN 'segment_too_short' ELSE 'kept' END AS reason FROM a LEFT JOIN l ON l.user_id = a.user_id""")
def quality_reasons(spark, sf_dir):
    per = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("seen"))
    longest = _segments(spark, sf_dir).groupBy("user_id", "segment_id").count().groupBy("user_id").agg(F.max("count").alias("longest"))
    reason = F.when(F.col("n") < 20, "too_short").when(F.col("seen") / F.col("n") < 0.7, "low_detection_rate").when(F.col("longest").isNull(), "no_continuous_segment").when(F.col("longest") < 4, "segment_too_short").otherwise("kept")
    return per.join(longest, "user_id", "left").select("user_id", reason.alias("reason"))


_POSE = """WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), s AS (SELECT *, (sqrt(e[1]*e[1]+e[5]*e[5]+e[9]*e[9]) + sqrt(e[2]*e[2]+e[6]*e[6]+e[10]*e[10]) + sqrt(e[3]*e[3]+e[7]*e[7]+e[11]*e[11])) / 3 AS scale FROM e),
r AS (SELECT vec_id, scale, e[4] AS tx, e[1]/scale AS a, e[2]/scale AS b, e[3]/scale AS c, e[5]/scale AS d, e[6]/scale AS f, e[7]/scale AS g, e[9]/scale AS h, e[10]/scale AS i, e[11]/scale AS j FROM s),
m AS (SELECT *, a*(f*j-g*i) - b*(d*j-g*h) + c*(d*i-f*h) AS det, sqrt((a*a+d*d+h*h-1)**2 + (b*b+f*f+i*i-1)**2 + (c*c+g*g+j*j-1)**2 + 2*((a*b+d*f+h*i)**2 + (a*c+d*g+h*j)**2 + (b*c+f*g+i*j)**2)) AS res FROM r)"""


@query(_POSE + " SELECT vec_id, round(scale, 6) AS scale, round(tx, 6) AS tx, round(det, 6) AS det, round(res, 6) AS residual, round(CASE WHEN det <= 0 THEN 0.0 ELSE 1 - least(1.0, res / 0.05) END, 6) AS confidence FROM m")
def parse_pose(spark, sf_dir):
    r, t, scale = geometry.decompose([F.element_at("embedding", i).cast("double") for i in range(1, 17)])
    shown = {"scale": scale, "tx": t[0], "det": geometry.determinant(r), "residual": geometry.residual(r), "confidence": geometry.pose_confidence(r)}
    return _table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in shown.items()])


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), n AS (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]) AS n FROM e), a AS (SELECT *, e[1]/n AS a1, e[2]/n AS a2, e[3]/n AS a3 FROM n), d AS (SELECT *, a1*e[4]+a2*e[5]+a3*e[6] AS d FROM a),
r AS (SELECT *, e[4]-d*a1 AS r1, e[5]-d*a2 AS r2, e[6]-d*a3 AS r3 FROM d), b AS (SELECT *, r1/sqrt(r1*r1+r2*r2+r3*r3) AS b1, r2/sqrt(r1*r1+r2*r2+r3*r3) AS b2, r3/sqrt(r1*r1+r2*r2+r3*r3) AS b3 FROM r),
c AS (SELECT vec_id, acos(greatest(-1.0, least(1.0, (a1 + b2 + a1*b2 - a2*b1 - 1) / 2))) AS angle, b3 - (a3*b1 - a1*b3) AS v1, (a2*b3 - a3*b2) - a3 AS v2, a2 - b1 AS v3 FROM b)
SELECT vec_id, round(degrees(angle) * v1 / (2 * sin(angle)), 4) AS rx, round(degrees(angle) * v2 / (2 * sin(angle)), 4) AS ry, round(degrees(angle) * v3 / (2 * sin(angle)), 4) AS rz, 0.0 AS back FROM c""")
def rotation_vectors(spark, sf_dir):
    """Rotation vectors in degrees by quaternions; back is the error of the way back to the matrix."""
    r = vectors.rotation_columns([F.element_at("embedding", i).cast("double") for i in range(1, 7)])
    parts = _table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(f"m{i}") for i, c in enumerate(r)])
    m = [F.col(f"m{i}") for i in range(9)]
    v = parts.select("*", *[c.alias(f"v{i}") for i, c in enumerate(geometry.rotation_vector(geometry.quaternion(m)))])
    again = geometry.matrix(geometry.from_rotation_vector([F.col(f"v{i}") for i in range(3)]))
    worst = F.greatest(*[F.abs(a - b) for a, b in zip(again, m, strict=True)])
    return v.select("vec_id", *[F.round(f"v{i}", 4).alias(n) for i, n in enumerate(("rx", "ry", "rz"))], F.round(worst, 7).alias("back"))


@query("""WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:63] AS e FROM embeddings), s AS (SELECT *, sqrt((e[4]-e[25])**2 + (e[5]-e[26])**2 + (e[6]-e[27])**2) AS apart, [(e[4]+e[25])/2, (e[5]+e[26])/2, (e[6]+e[27])/2] AS mid FROM e)
SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: abs(e[i] - mid[(i - 1) % 3 + 1]) / apart)), 4) AS spread FROM s""")
def canonical_landmarks(spark, sf_dir):
    points = F.transform(F.slice("embedding", 1, 63), lambda v: v.cast("double"))
    moved = geometry.canonical(points, 1, 8)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(moved, F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("spread"))


_PARTS = r"""p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\.[^./]*$', ''), '/'), lambda x: x NOT IN ('', '.', '..')) AS p FROM pages)"""


@query(f"WITH {_PARTS} SELECT page_id, array_to_string(p, '__') AS clip_id, CASE WHEN len(p) >= 2 THEN p[1] END AS top_dir, CASE WHEN len(p) >= 2 THEN p[-2] END AS parent_dir FROM p")
def clip_names(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return _table(spark, sf_dir, "pages").select("page_id", names.clip_id(path).alias("clip_id"), names.speaker(path, "top_dir").alias("top_dir"), names.speaker(path, "parent_dir").alias("parent_dir"))


@query("""SELECT p_partkey, CASE WHEN t = '' THEN 'run' ELSE t END AS tag, (CASE WHEN t = '' THEN 'run' ELSE t END) || '__20200101T000000Z__nogit' AS run_id, CASE WHEN t = '' THEN 'run' ELSE t END AS parsed FROM (SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 48), '^[-._]+|[-._]+$', '', 'g') AS t FROM part)""")
def run_names(spark, sf_dir):
    name = F.concat_ws(" / ", "p_name", "p_type")
    made = names.run_id(name, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), F.lit("nogit"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", names.tag(name).alias("tag"), made.alias("run_id"))
    return rows.withColumn("parsed", names.parse_run_id(F.col("run_id")).tag)


@query("""SELECT ((o_orderkey * 2654435761) % 1000003) % 4 AS shard, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def shard_counts(spark, sf_dir):
    out = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    left = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(out, "o_custkey", "left_anti")
    return left.groupBy(tables.shard(F.col("o_orderkey"), 4).alias("shard")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT doc_id, 'no_label' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_report(spark, sf_dir):
    docs = tables.read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id"])
    return tables.matched(docs, tables.read_parquet(spark, f"{sf_dir}/labels.parquet", ["doc_id", "quality"]), ["doc_id"], "no_label")[1]


def _streamed(spark, sf_dir, make, name):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    timed = lambda s: make(s.withColumn("ts", F.col("ts").cast("timestamp")))
    return live.drain(spark, timed, path, schema, live.shared_folder(spark, name))


@query("""WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT event_type, epoch_us(d) // 1000000 AS start_s, n, mean FROM w, m WHERE d + INTERVAL 1 DAY <= mark""")
def stream_windows(spark, sf_dir):
    """Daily windows of a stream, those the watermark has closed."""
    rows = _streamed(spark, sf_dir, lambda s: live.windowed(s, "ts", ["event_type"], "1 day", "1 day", "1 day", [F.count("*").alias("n"), F.avg("value").alias("mean")]), "windows")
    return rows.select("event_type", F.unix_seconds("window_start").alias("start_s"), "n", F.round("mean", 6).alias("mean"))


@query("""WITH d AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM d),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, count(*) AS n FROM g GROUP BY user_id, g), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS stop_us, n FROM s, m WHERE b <= mark""")
def stream_sessions(spark, sf_dir):
    """Stretches of a stream between gaps of over 12 hours, those the watermark has closed."""
    rows = _streamed(spark, sf_dir, lambda s: live.sessions(s, "ts", ["user_id"], "1 day", "12 hours", [F.count("*").alias("n")]), "sessions")
    return rows.select("user_id", F.unix_micros("t_start").alias("start_us"), F.unix_micros("t_stop").alias("stop_us"), "n")
