"""Registered queries of timelines, dynamics, gaze, retrieval costs and roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import geometry, sql, timing, vectors
from weftline.operators import dynamics, retrieval, text
from weftline.operators import timeseries as ts
from weftline.plans import catalogue
from weftline.plans.catalogue import _FRAMES, _GRID, _KEYS, _NUMBERED, _ORDER, _RUNS, _SHIFT, HOUR, _frames, _grid, _numbered, _table, query
from weftline.sources import tables
from weftline.streaming import live

_UNIT = ["user_id", "segment_id"]


@query(f"""WITH {_NUMBERED}, p AS (SELECT *, CASE WHEN event_type <> 'error' THEN t END AS pts FROM numbered),
d AS (SELECT *, pts - lag(pts) OVER (PARTITION BY user_id ORDER BY idx) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM p),
m AS (SELECT *, median(CASE WHEN d > 0 THEN d END) OVER (PARTITION BY user_id) AS m FROM d),
f AS (SELECT user_id, count(*) AS n_frames, bool_or(pts IS NULL) AS a, coalesce(bool_or(d < 0), false) AS b, coalesce(bool_or(d = 0), false) AS c, coalesce(bool_or(d > 1.5 * m AND idx <> n - 1), false) AS e, coalesce(bool_or(d > 1.5 * m AND idx = n - 1), false) AS f,
  count(*) FILTER (d > 1.5 * m) AS n_gaps, min(idx - 1) FILTER (d > 1.5 * m) AS first_gap_after, count(*) FILTER (d > 0) = count(*) - 1 AS rising FROM m GROUP BY user_id),
r AS (SELECT *, list_filter([CASE WHEN a THEN 'timeline:missing_pts' END, CASE WHEN b THEN 'timeline:non_monotonic_pts' END, CASE WHEN c THEN 'timeline:duplicate_pts' END, CASE WHEN e THEN 'timeline:large_frame_gap' END, CASE WHEN f THEN 'timeline:tail_frame_gap' END], lambda x: x IS NOT NULL) AS r FROM f)
SELECT user_id, n_frames, n_gaps, first_gap_after, CASE WHEN rising AND len(r) = 0 THEN 'usable' ELSE 'needs_review' END AS timeline_label, CASE WHEN len(r) = 0 AND NOT rising THEN 'timeline:not_strictly_monotonic' ELSE array_to_string(r, ',') END AS reasons FROM r""")
def timeline_verdicts(spark, sf_dir):
    """What is wrong with each unit's times, and whether it may be used."""
    frames = _frames(spark, sf_dir, "event_type").withColumn("pts", F.when(F.col("event_type") != "error", F.col("t")))
    found = ts.issues(frames, _KEYS, _ORDER, "pts")
    return found.select("user_id", "n_frames", F.size("large_gaps").cast("long").alias("n_gaps"), F.try_element_at("large_gaps", F.lit(1))["after_frame"].alias("first_gap_after"), "timeline_label", F.array_join("reasons", ",").alias("reasons"))


def _slope(rows: str, out: str, value: str, name: str) -> str:
    return f"""{out}_at AS (SELECT *, {value} AS v, h - lag(h) OVER w AS hs, lead(h) OVER w - h AS hd, lag({value}) OVER w AS p, lead({value}) OVER w AS q FROM {rows} WINDOW w AS (PARTITION BY user_id, segment_id ORDER BY grid_idx)),
{out} AS (SELECT * EXCLUDE (v, hs, hd, p, q), CASE WHEN hs IS NULL AND hd IS NULL THEN NULL WHEN hs IS NULL THEN (q - v) / hd WHEN hd IS NULL THEN (v - p) / hs ELSE (hs * hs * q + (hd * hd - hs * hs) * v - hd * hd * p) / (hs * hd * (hs + hd)) END AS {name} FROM {out}_at)"""


_DERIVED = f"""{_GRID}, hours AS (SELECT user_id, segment_id, grid_idx, value, t_sec / {HOUR} AS h FROM grid),
{_slope("hours", "d1", "value", "velocity")}, {_slope("d1", "d2", "velocity", "acceleration")}, {_slope("d2", "d3", "acceleration", "jerk")}"""


def _hours(spark, sf_dir):
    return _grid(spark, sf_dir).withColumn("h", F.col("t_sec") / F.lit(HOUR))


@query(f"WITH {_DERIVED} SELECT user_id, segment_id, grid_idx, round(velocity, 4) AS velocity, round(acceleration, 4) AS acceleration, round(jerk, 4) AS jerk FROM d3")
def derivatives(spark, sf_dir):
    """Three orders of derivatives an hour of the resampled signal."""
    rows = dynamics.derivatives(_hours(spark, sf_dir), _UNIT, ["grid_idx"], "h", "value")
    return rows.select(*_UNIT, "grid_idx", *[F.round(c, 4).alias(c) for c in dynamics.ORDERS])


def _stats(name: str, k: int) -> str:
    inside = f"FILTER (grid_idx >= {k} AND grid_idx < n - {k})"
    return f"""round(avg(abs({name})), 4) AS {name}_mean, round(max(abs({name})), 4) AS {name}_max, round(avg(abs({name})) {inside}, 4) AS {name}_interior_mean, round(max(abs({name})) {inside}, 4) AS {name}_interior_max, count(*) FILTER ({name} IS NULL) AS {name}_n_missing"""


@query(f"""WITH {_DERIVED}, s AS (SELECT *, count(*) OVER (PARTITION BY user_id, segment_id) AS n, h - lag(h) OVER (PARTITION BY user_id, segment_id ORDER BY grid_idx) AS d FROM d3)
SELECT user_id, segment_id, count(*) AS n_frames, round(min(d), 4) AS step_min, round(max(d), 4) AS step_max, round(avg(d), 4) AS step_mean, max(d) - min(d) <= 1e-6 AS is_uniform, count(*) FILTER (value IS NULL) AS n_missing,
  {", ".join(_stats(n, k) for k, n in enumerate(dynamics.ORDERS, 1))} FROM s GROUP BY 1, 2""")
def dynamics_summary(spark, sf_dir):
    """Figures of the three orders, over all frames and without the ends."""
    found = dynamics.summary(_hours(spark, sf_dir), _UNIT, ["grid_idx"], "h", "value")
    kept = [*_UNIT, "n_frames", "is_uniform", "n_missing", *[c for c in found.columns if c.endswith("_n_missing")]]
    return found.select(*kept, *[F.round(c, 4).alias(c) for c in found.columns if c not in kept])


_REBUILT = _DERIVED.replace("SELECT user_id, segment_id, grid_idx, value, t_sec", "SELECT user_id, segment_id, grid_idx, round(value / 4) * 4 AS value, t_sec")


@query(f"""WITH {_DERIVED}, rebuilt AS ({"WITH " + _REBUILT + " SELECT * FROM d3"}), b AS (SELECT a.*, r.velocity AS rv, r.acceleration AS ra, r.jerk AS rj, count(*) OVER (PARTITION BY a.user_id, a.segment_id) AS n FROM d3 a JOIN rebuilt r USING (user_id, segment_id, grid_idx)),
e AS (SELECT 'velocity' AS derivative, velocity AS x, rv AS y FROM b WHERE n >= 2 UNION ALL SELECT 'acceleration', acceleration, ra FROM b WHERE n >= 2 UNION ALL SELECT 'jerk', jerk, rj FROM b WHERE n >= 2)
SELECT derivative, round(avg(abs(x)), 4) AS mean_abs_original, round(avg(abs(y)), 4) AS mean_abs_rebuilt, round(avg(abs(y - x)), 4) AS mae, round(max(abs(y - x)), 4) AS max_abs FROM e GROUP BY 1""")
def dynamics_errors(spark, sf_dir):
    """How far derivatives of a signal in steps of 4 are from those of the signal itself."""
    rows = _hours(spark, sf_dir).withColumn("rebuilt", F.round(F.col("value") / 4) * 4)
    found = dynamics.errors(rows, _UNIT, ["grid_idx"], "h", "value", "rebuilt")
    return found.select("derivative", *[F.round(c, 4).alias(c) for c in found.columns if c != "derivative"])


@query(f"""WITH c AS ({catalogue.ORACLE_SQL["confidence_stats"]})
SELECT round(avg(mean), 4) AS mean_of_clip_means, round(stddev_pop(mean), 4) AS std_of_clip_means, round(min(mean), 4) AS worst_clip_mean, round(avg(n_low_but_tracked / n_low) FILTER (n_low > 0), 4) AS low_but_tracked, count(*) AS n_clips, coalesce(array_to_string(list_sort(list(user_id) FILTER (label = 'reject')), ','), '') AS rejected FROM c""")
def quality_report(spark, sf_dir):
    """Figures of clips rolled up over all of them, and which are rejected."""
    clips = catalogue.confidence_stats(spark, sf_dir)
    return clips.agg(
        F.round(F.avg("mean"), 4).alias("mean_of_clip_means"), F.round(F.stddev_pop("mean"), 4).alias("std_of_clip_means"), F.round(F.min("mean"), 4).alias("worst_clip_mean"),
        F.round(F.avg(F.when(F.col("n_low") > 0, F.col("n_low_but_tracked") / F.col("n_low"))), 4).alias("low_but_tracked"), F.count("*").alias("n_clips"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("label") == "reject", F.col("user_id")))).cast("array<string>"), ",").alias("rejected"),
    )


@query(f"""WITH {_FRAMES}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM frames), r AS (SELECT user_id, round(CASE WHEN median(d) > 0 THEN {HOUR} / median(d) END, 9) AS rate FROM d GROUP BY user_id)
SELECT user_id, greatest(CAST(floor(round(100 * rate, 9) + 0.5) AS BIGINT), 2) AS n_frames, CASE WHEN rate > 1.5 * 0.02 THEN format('source {{:.3f}} Hz decimated to 0.020 Hz without an anti-alias filter; content above 0.010 Hz will alias', rate) END AS warning FROM r WHERE rate IS NOT NULL""")
def window_frames(spark, sf_dir):
    """Frames of 100 hours at each unit's own rate an hour, and what resampling to one in 50 hours would lose."""
    rates = ts.rate(_frames(spark, sf_dir), _KEYS, _ORDER, "t").withColumn("rate", F.round(F.col("rate") * HOUR, 9)).filter("rate IS NOT NULL")
    return rates.select("user_id", timing.frames_for_seconds(100.0, F.col("rate")).alias("n_frames"), timing.antialias_warning(F.col("rate"), 0.02).alias("warning"))


@query(f"""WITH {_FRAMES}, s AS (SELECT user_id, max(t) - min(t) AS v, max(t) FILTER (event_type <> 'error') - min(t) FILTER (event_type <> 'error') AS a FROM frames GROUP BY user_id)
SELECT user_id, CASE WHEN a IS NULL THEN 'no_audio_stream' WHEN v IS NULL OR abs(round(v - a, 4)) > 0.1 THEN 'av_duration_mismatch' ELSE 'ok' END AS status FROM s""")
def av_gate(spark, sf_dir):
    """Whether all frames and those without error last equally long."""
    own = F.when(F.col("event_type") != "error", F.col("t"))
    spans = _frames(spark, sf_dir, "event_type").groupBy("user_id").agg((F.max("t") - F.min("t")).alias("v"), (F.max(own) - F.min(own)).alias("a"))
    return spans.select("user_id", timing.av_status(F.col("v"), F.col("a")).alias("status"))


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS p, embedding[2]::DOUBLE AS y, embedding[3] > 0 AS ok FROM embeddings), m AS (SELECT *, avg(CASE WHEN ok THEN p END) OVER w AS mp, avg(CASE WHEN ok THEN y END) OVER w AS my FROM e WINDOW w AS (PARTITION BY label))
SELECT vec_id, round(CASE WHEN mp IS NULL THEN p ELSE radians(35) * tanh((p - mp) / radians(35)) END, 6) AS pitch, round(CASE WHEN my IS NULL THEN y ELSE radians(50) * tanh((y - my) / radians(50)) END, 6) AS yaw FROM m""")
def zero_mean_gaze(spark, sf_dir):
    """Gazes about each speaker's mean, bounded at an eye's limits."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    pitch, yaw = geometry.centred_gaze(at(1), at(2), at(3), Window.partitionBy("label"), squash=True)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(pitch, 6).alias("pitch"), F.round(yaw, 6).alias("yaw"))


_BANK = """bank AS (SELECT vec_id AS exemplar_id, label AS type, exp(e[1]) AS duration, e[2:5] AS cdev, abs(e[6]) AS onset, abs(e[7]) AS "offset", e[8] AS rest FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
both_times AS (SELECT type, onset AS x FROM bank UNION ALL SELECT type, "offset" FROM bank), st AS (SELECT type, greatest(stddev_pop(x), 1.0 / 30) AS sd_time FROM both_times GROUP BY 1),
sd AS (SELECT type, greatest(stddev_pop(ln(duration)), 1e-3) AS sd_duration, [greatest(stddev_pop(cdev[1]), 1e-4), greatest(stddev_pop(cdev[2]), 1e-4), greatest(stddev_pop(cdev[3]), 1e-4), greatest(stddev_pop(cdev[4]), 1e-4)] AS sd_cdev, greatest(stddev_pop(rest), 1e-4) AS sd_rest FROM bank GROUP BY 1)"""


def _bank(spark, sf_dir):
    e = lambda i: F.element_at("embedding", i).cast("double")
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("exemplar_id"), F.col("label").alias("type"), F.exp(e(1)).alias("duration"), F.slice(F.transform("embedding", lambda v: v.cast("double")), 2, 4).alias("cdev"), F.abs(e(6)).alias("onset"), F.abs(e(7)).alias("offset"), e(8).alias("rest")
    )


@query(f"WITH {_BANK} SELECT type, round(sd_duration, 6) AS sd_duration, round(sd_time, 6) AS sd_time, round(sd_rest, 6) AS sd_rest, round(list_sum(sd_cdev), 6) AS sd_cdev FROM sd JOIN st USING (type)")
def bank_spreads(spark, sf_dir):
    """Spreads of a bank of exemplars by type."""
    total = F.aggregate("sd_cdev", F.lit(0.0), lambda a, v: a + v)
    return retrieval.spreads(_bank(spark, sf_dir), 30.0).select("type", *[F.round(c, 6).alias(c) for c in ("sd_duration", "sd_time", "sd_rest")], F.round(total, 6).alias("sd_cdev"))


@query(f"""WITH {_BANK}, c AS (SELECT q.exemplar_id AS query_id, b.exemplar_id, abs(ln(q.duration / b.duration)) / sd_duration + list_sum(list_transform(range(1, 5), lambda i: abs(q.cdev[i] - b.cdev[i]) / sd_cdev[i])) / 4 + (abs(q.onset - b.onset) + abs(q."offset" - b."offset")) / sd_time + 0.5 * abs(q.rest - b.rest) / sd_rest AS cost,
  q.duration / b.duration BETWEEN 1 / 1.5 AND 1.5 AS ok FROM bank q JOIN bank b ON b.type = q.type AND b.exemplar_id <> q.exemplar_id JOIN sd ON sd.type = q.type JOIN st ON st.type = q.type WHERE q.exemplar_id % 20 = 0),
a AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS fits FROM c)
SELECT query_id, exemplar_id, round(cost, 6) AS cost, NOT fits AS relaxed, row_number() OVER (PARTITION BY query_id ORDER BY round(cost, 6), exemplar_id) AS rank FROM a WHERE ok OR NOT fits QUALIFY rank <= 5""")
def target_costs(spark, sf_dir):
    """The five cheapest exemplars for every query, whose id is divisible by 20, of all exemplars of its type."""
    bank = _bank(spark, sf_dir)
    asked = bank.filter("exemplar_id % 20 = 0").withColumnRenamed("exemplar_id", "query_id")
    return retrieval.cheapest(retrieval.costs(asked, bank, 30.0).withColumn("cost", F.round("cost", 6)), 5)


_HINTS = f"""{_RUNS}, hinted AS (SELECT l.user_id, l.idx, l.level, r.run_start, avg(l.x) OVER (PARTITION BY l.user_id, r.run_start) AS mean, [0.0, 0.1, 0.3, 0.8, 'inf'::DOUBLE] AS e FROM level_runs r JOIN leveled l ON l.user_id = r.user_id AND l.idx >= r.run_start AND l.idx < r.run_stop),
cut AS (SELECT *, round(round(CASE WHEN level > 0 THEN greatest(e[level + 1], least(e[level + 2], mean)) WHEN level < 0 THEN greatest(-e[2 - level], least(-e[1 - level], mean)) ELSE greatest(-e[2], least(e[2], mean)) END, 9)::DECIMAL(18, 9), 4)::DOUBLE AS hint FROM hinted)"""


def _documents(spark, sf_dir):
    rows = _numbered(spark, sf_dir, "event_type").withColumn("x", (F.col("value") - 50) / 50)
    return text.encode(rows, _KEYS, "idx", "x", F.col("event_type") != "error", _SHIFT, 30.0)


@query(f"""WITH {_HINTS}, s AS (SELECT user_id, run_start, min(hint) AS hint FROM cut GROUP BY 1, 2), n AS (SELECT user_id, count(*) AS n_frames FROM numbered GROUP BY 1)
SELECT n.user_id, n_frames, count(s.run_start) AS n_segments, coalesce(sum(CAST(round(hint * 10000) AS BIGINT)), 0)::BIGINT AS hints, round(min(s.run_start) / 30.0, 4) AS first FROM n LEFT JOIN s ON s.user_id = n.user_id GROUP BY n.user_id, n_frames""")
def text_documents(spark, sf_dir):
    """Every unit as a document of segments; shown by what stands in it."""
    doc = _documents(spark, sf_dir).select("user_id", F.from_json("doc", text.SCHEMA).alias("d"))
    hints = F.aggregate("d.segments", F.lit(0).cast("long"), lambda a, s: a + F.rint(s["hint"] * 10000).cast("long"))
    return doc.select("user_id", F.col("d.n_frames").alias("n_frames"), F.size("d.segments").cast("long").alias("n_segments"), hints.alias("hints"), F.try_element_at("d.segments", F.lit(1))["t0"].alias("first"))


@query(f"WITH {_HINTS} SELECT user_id, idx, level, hint AS value FROM cut")
def text_round_trip(spark, sf_dir):
    """Frames read back from documents: those that were described, with their levels and hints."""
    return text.decode(_documents(spark, sf_dir), _KEYS, _SHIFT).select("user_id", "idx", "level", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (value > 50) AS n_high FROM events GROUP BY 1")
def json_reports(spark, sf_dir):
    """A report written as JSON to the shared folder and read back by its schema."""
    made = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 50).alias("n_high"))
    path = live.shared_folder(spark, "report")
    tables.write_report(made, path)
    return tables.read_json(spark, path, "event_type string, n long, mean double, n_high long", multi_line=False)


@query("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2")
def parquet_sink(spark, sf_dir):
    """A table written to bounded files in a folder a status, and read back."""
    path = live.shared_folder(spark, "orders")
    tables.write_parquet(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), path, 50_000, ["o_orderstatus"])
    return tables.read_parquet(spark, path, ["o_orderkey", "o_orderdate", "o_orderstatus"]).groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: CASE WHEN v < -0.25 THEN NULL ELSE v END) AS e FROM embeddings),
c AS (SELECT vec_id, e, len(list_filter(e[1:6], lambda v: v IS NULL)) > 0 AS r, len(list_filter(e[7:9], lambda v: v IS NULL)) > 0 AS t, len(list_filter(e[10:64], lambda v: v IS NULL)) > 0 AS b FROM e)
SELECT vec_id, r::INT + t::INT + b::INT AS n_invalid, round(CASE WHEN r THEN 2.0 ELSE list_sum(e[1:6]) END + CASE WHEN t THEN 0.0 ELSE list_sum(e[7:9]) END + CASE WHEN b THEN 0.0 ELSE list_sum(e[10:64]) END, 5) AS total FROM c""")
def sanitized_vectors(spark, sf_dir):
    """Vectors whose channels are replaced whole by neutral ones where a value is missing."""
    x = F.transform("embedding", lambda v: F.when(v < -0.25, None).otherwise(v.cast("double")))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    neutral = {(0, 6): [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], (6, 3): [0.0] * 3, (9, 55): [0.0] * 55}
    parts = [(vectors.channel(F.col("x"), *at), values) for at, values in neutral.items()]
    whole = vectors.assemble([(vectors.sanitize(c, values), len(values)) for c, values in parts])
    invalid = sum(F.exists(c, lambda v: v.isNull()).cast("int") for c, _ in parts)
    return rows.select("vec_id", invalid.alias("n_invalid"), F.round(F.aggregate(whole, F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(f"""WITH {_NUMBERED}, m AS (SELECT user_id, idx, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS r FROM numbered WHERE event_type = 'error')
SELECT user_id, count(*) AS n_missing, array_to_string(list(idx ORDER BY idx) FILTER (r <= 50), ',') AS first_missing FROM m GROUP BY user_id""")
def missing_frames(spark, sf_dir):
    """How many frames of a unit have no time, and the numbers of the first fifty."""
    rows = _numbered(spark, sf_dir, "event_type").filter("event_type = 'error'")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("idx")))
    listed = F.sort_array(F.collect_list(F.when(F.col("r") <= 50, F.col("idx")))).cast("array<string>")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_missing"), F.array_join(listed, ",").alias("first_missing"))


@query("""WITH p AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, event_type, count(*) AS n, quantile_cont(value, 0.1) AS p10, median(value) AS median, quantile_cont(value, 0.9) AS p90, avg(value) AS mean FROM events GROUP BY 1, 2)
SELECT u.user_id, p.event_type, coalesce(n, 0) AS n, round(p10, 6) AS p10, round(median, 6) AS median, round(p90, 6) AS p90, round(mean, 6) AS mean FROM u CROSS JOIN p LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = p.event_type""")
def category_quantiles(spark, sf_dir):
    """Counts and quantiles of each kind of event by unit; a kind that a unit lacks counts 0."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    p = F.percentile("value", F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    found = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(p[0], 6).alias("p10"), F.round(p[1], 6).alias("median"), F.round(p[2], 6).alias("p90"), F.round(F.avg("value"), 6).alias("mean"))
    kinds = rows.select("event_type").distinct().agg(F.collect_list("event_type").alias("k"))  # one row of the few kinds there are
    spine = rows.select("user_id").distinct().join(F.broadcast(kinds)).select("user_id", F.explode("k").alias("event_type"))
    return spine.join(found, ["user_id", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT event_id, CASE WHEN x >= 0.8 THEN 3 WHEN x >= 0.3 THEN 2 WHEN x >= 0.1 THEN 1 ELSE 0 END * CASE WHEN v < 0 THEN -1 ELSE 1 END AS level, CASE WHEN event_type = 'error' THEN 0.0 ELSE greatest(0.0, least(1.0, x)) END AS weight FROM (SELECT event_id, event_type, (value - 50) / 50 AS v, abs((value - 50) / 50) AS x FROM events)")
def sql_functions(spark, sf_dir):
    """The engine's functions called from SQL text."""
    sql.register(spark)
    _table(spark, sf_dir, "events").createOrReplaceTempView("weftline_events")
    return spark.sql("SELECT event_id, level_of((value - 50) / 50, array(0.1D, 0.3D, 0.8D)) AS level, loss_weight(abs((value - 50) / 50), event_type <> 'error', false, false) AS weight FROM weftline_events")
