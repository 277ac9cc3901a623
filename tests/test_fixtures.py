"""Small fixed inputs with known results."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import geometry, levels, names, timing, vectors
from weftline.operators import dynamics, events, kernels, retrieval, text
from weftline.operators import timeseries as ts
from weftline.plans import catalogue
from weftline.sources import tables
from weftline.streaming import live

NAN = float("nan")


def _series(spark, times, values=None):
    values = values or [0.0] * len(times)
    return spark.createDataFrame([(0, i, t, v) for i, (t, v) in enumerate(zip(times, values, strict=True))], "u int, i int, t double, v double")


def _runs(levels):
    out, start = [], 0
    for i in range(1, len(levels) + 1):
        if i == len(levels) or levels[i] != levels[start]:
            out.append((start, i, levels[start]))
            start = i
    return out


@pytest.mark.parametrize(
    ("levels", "least", "want"),
    [
        ([0, 0, 0, 1, 0, 0, 0, 2, 2, 2, 2, 0, 0, 0], 3, [(0, 7, 0), (7, 11, 2), (11, 14, 0)]),
        ([0, 0, 0, 0, 2, 3, 3, 3, 3], 2, [(0, 4, 0), (4, 9, 3)]),
    ],
)
def test_short_runs_merge(levels, least, want):
    assert kernels.merge_short(_runs(levels), least) == want


def test_an_isolated_short_run_stays():
    assert kernels.merge_short(_runs([1, 1, 2, 3, 3, 3, 3, 3, 3]), 3)[0] == (0, 2, 1)


def test_audit_counts(spark):
    for times, backward, equal, strict in (([0, 0.08, 0.04, 0.12], 1, 0, False), ([0, 0.04, 0.04, 0.08], 0, 1, False), ([0, 0.04, 0.08, 0.12], 0, 0, True)):
        row = ts.audit(_series(spark, [float(t) for t in times]), ["u"], ["i"], "t").first()
        assert (row.n_backward, row.n_duplicate, row.strictly_monotonic) == (backward, equal, strict)


def test_clock_rises_over_missing_times(spark):
    rows = ts.increasing_clock(_series(spark, [0.0, 0.0005, 0.001, None, 0.002]), ["u"], ["i"], "t").orderBy("i").collect()
    assert [r.clock_ms for r in rows] == [0, 1, 2, 3, 4]


def test_segments_split_at_gaps(spark):
    rows = ts.segments(_series(spark, [0.0, 0.04, 0.08, 1.0, 1.04, 1.08]), ["u"], ["i"], "t", 0.2).collect()
    assert sorted(r.segment_id for r in rows) == [0, 0, 0, 1, 1, 1]


def test_slope_over_uneven_times(spark):
    t = [0.0, 0.013, 0.077, 0.078, 0.31, 0.5]
    rows = ts.gradient(_series(spark, t, [3 * x + 1 for x in t]), ["u"], ["i"], "t", "v", "d").collect()
    assert all(abs(r.d - 3) < 1e-9 for r in rows)


def _channels(spark):
    n, left, right = 120, [0.12] * 120, [0.12] * 120
    for i in range(30, 37):
        left[i] = right[i] = 0.7
    for i in range(80, 86):
        right[i] = 0.6
    for i in range(95, 120):
        left[i] = right[i] = 0.7
    rows = [(0, ref, i, v[i], not (ref == "l" and i == 84)) for ref, v in (("l", left), ("r", right)) for i in range(n)]
    return spark.createDataFrame(rows, "u int, ref string, idx int, v double, covered boolean")


def test_excursions_and_their_reasons(spark):
    devs = events.deviations(_channels(spark), ["u"])
    rows = events.excursions(devs, ["u"], ["l", "r"], ["l", "r"], 0.2, 0.3, 2 / 30, 0.5, hz=30.0).orderBy("start").collect()
    assert [(r.start, r.stop, r.active, r.reason) for r in rows] == [(30, 37, ["l", "r"], None), (80, 86, ["r"], "not_fully_described"), (95, 120, ["l", "r"], "too_long")]
    assert rows[0].driver == "l" and rows[0].channel_dev == {"l": 0.58, "r": 0.58} and rows[0].onset == 0 and rows[0].offset == 0


def test_no_frames_give_no_excursions(spark):
    devs = events.deviations(_channels(spark).filter("false"), ["u"])
    assert events.excursions(devs, ["u"], ["l"], ["l"], 0.2, 0.3, 0.1, 0.5).count() == 0


def test_claims_go_by_priority(spark):
    span = lambda *s: spark.createDataFrame([(0, a, b) for a, b in s], "u int, start int, stop int")
    out = events.claim([("low", 1, ["a", "b"], span((0, 5), (5, 9))), ("high", 2, ["b"], span((4, 5))), ("other", 0, ["c"], span((0, 9)))], ["u"])
    assert {(r.kind, r.start, r.reason) for r in out.collect()} == {("high", 4, None), ("low", 0, "claimed_by_higher_priority"), ("low", 5, None), ("other", 0, None)}


def test_nearest_takes_the_earlier_of_equally_near(spark):
    frames = spark.createDataFrame([(0, 0.0, 10), (0, 2.0, 11), (0, 5.0, 12)], "u int, t double, s int")
    asked = spark.createDataFrame([(0, 1.0, "a"), (0, 4.0, "b"), (0, -3.0, "c"), (1, 0.0, "d")], "u int, t double, name string")
    rows = events.nearest(asked, frames, ["u"], "t", "s").collect()
    assert {r.name: r.nearest for r in rows} == {"a": 10, "b": 12, "c": 10, "d": None}


def test_pose_of_a_scaled_rotation(spark):
    m = [F.lit(float(x)) for x in (0, -2, 0, 5, 2, 0, 0, 6, 0, 0, 2, 7, 0, 0, 0, 1)]
    r, t, scale = geometry.decompose(m)
    v = geometry.rotation_vector(geometry.quaternion(r))
    row = spark.range(1).select(scale.alias("s"), geometry.pose_confidence(r).alias("c"), t[2].alias("t"), v[2].alias("z"), v[0].alias("x")).first()
    assert row.s == 2 and row.c == pytest.approx(1) and row.t == 7 and row.z == pytest.approx(90) and row.x == pytest.approx(0)


def test_landmarks_without_extent_are_nan(spark):
    both = spark.range(1).select(geometry.canonical(F.array(*[F.lit(1.0)] * 6), 0, 1).alias("p"), geometry.canonical(F.array(*[F.lit(float(x)) for x in (0, 0, 0, 2, 0, 0)]), 0, 1).alias("q")).first()
    assert all(math.isnan(x) for x in both.p) and both.q == [-0.5, 0, 0, 0.5, 0, 0]


def test_names(spark):
    path = F.lit("s01/take2.mp4")
    row = spark.range(1).select(names.clip_id(path).alias("c"), names.speaker(path, "parent_dir").alias("s"), names.speaker(F.lit("a.mp4"), "top_dir").alias("none"), names.tag(F.lit(" my set! ")).alias("t"), names.tag(F.lit("--")).alias("r")).first()
    assert (row.c, row.s, row.none, row.t, row.r) == ("s01__take2", "s01", None, "my-set", "run")
    with pytest.raises(Exception, match="no run id"):
        spark.range(1).select(names.parse_run_id(F.lit("x")).alias("r")).collect()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: a, b"):
        tables.require(spark.range(1), ["id", "a", "b"])


def _issues(spark, times):
    return ts.issues(_series(spark, times), ["u"], ["i"], "t").first()


def test_missing_times_are_counted_at_their_place(spark):
    found = _issues(spark, [0.0, 0.04, NAN, 0.12, 0.16])
    assert (found.n_frames, found.codes, found.strictly_monotonic, found.timeline_label, found.reasons) == (5, ["missing_pts"], False, "needs_review", ["timeline:missing_pts"])
    audit = ts.audit(_series(spark, [0.0, NAN, 0.08]), ["u"], ["i"], "t").first()
    assert (audit.n_missing, audit.strictly_monotonic, audit.step_max) == (1, False, None)


@pytest.mark.parametrize(
    ("times", "codes", "gaps"),
    [
        ([0.0, 0.08, 0.04, 0.12], ["non_monotonic_pts"], None),
        ([0.0, 0.04, 0.04, 0.08], ["duplicate_pts"], []),
        ([0.0, 0.04, 0.08, 0.12], [], []),
        ([0.0, 0.04, 0.08, 0.12, 0.24], ["tail_frame_gap"], [(3, 0.12)]),
        ([0.0, 0.04, 0.30, 0.34, 0.50], ["large_frame_gap", "tail_frame_gap"], None),
        ([0.0, 0.04, 0.08, 0.60, 0.64], ["large_frame_gap"], [(2, 0.52)]),
    ],
)
def test_issues_and_places_of_gaps(spark, times, codes, gaps):
    found = _issues(spark, times)
    if gaps is not None:
        assert [(g.after_frame, round(g.gap_sec, 9)) for g in found.large_gaps] == gaps
    assert found.timeline_label == ("needs_review" if codes else "usable")
    assert found.codes == codes


def test_rotation_of_degenerate_columns(spark):
    six = [(0.0,) * 6, (0.0, 0.0, 2.0, 0.0, 0.0, 5.0), (3.0, 0.0, 0.0, 1.0, 0.0, 0.0), (NAN, 0.0, 0.0, 0.0, 1.0, 0.0)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(six)], "i int, " + ", ".join(f"x{k} double" for k in range(6)))
    got = [list(r)[1:] for r in rows.select("i", *vectors.rotation_columns([F.col(f"x{k}") for k in range(6)])).orderBy("i").collect()]
    identity = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert got[0] == identity and got[3] == identity
    assert got[1] == [0, 1, 0, 0, 0, 1, 1, 0, 0]  # x aside, and their cross product
    assert got[2] == [1, 0, 0, 0, 1, 0, 0, 0, 1]  # y aside


def test_hash_of_large_keys_does_not_overflow(spark):
    keys = spark.createDataFrame([(6_000_000_000,), (-(2**63),), (7,)], "k long")
    got = [r[0] for r in keys.select(tables.spread_key(F.col("k"), 100)).collect()]
    assert got == [k * 2654435761 % 100 for k in (6_000_000_000, -(2**63), 7)]


def test_leaking_speakers(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "train"), (2, "train"), (2, "test")], "s long, split string")
    assert [tuple(r) for r in catalogue.leaking(rows, "s", "split").collect()] == [(2, 2)]


def test_falling_times_are_refused(spark):
    with pytest.raises(Exception, match="rise strictly"):
        ts.gradient(_series(spark, [0.0, 2.0, 1.0], [1.0, 2.0, 3.0]), ["u"], ["i"], "t", "v", "d").collect()


def test_derivatives_of_a_cube_and_their_errors(spark):
    t = [0.1 * i for i in range(12)]
    rows = _series(spark, t, [x**3 for x in t])
    found = dynamics.summary(rows, ["u"], ["i"], "t", "v").first()
    assert found.is_uniform and found.n_frames == 12 and found.jerk_n_missing == 0
    assert abs(found.jerk_interior_max - 6) < 1e-6 and abs(found.acceleration_interior_max - 6 * t[-3]) < 1e-6
    same = dynamics.errors(rows, ["u"], ["i"], "t", "v", "v").collect()
    assert sorted((r.derivative, r.mae, r.max_abs) for r in same) == [(n, 0.0, 0.0) for n in sorted(dynamics.ORDERS)]
    assert dynamics.summary(_series(spark, [0.0], [1.0]), ["u"], ["i"], "t", "v").first().velocity_mean is None


def test_frames_of_seconds_at_noisy_rates(spark):
    rates = spark.createDataFrame([(25.0,), (24.999999999999979,), (27.0,), (1.0,)], "r double")
    assert [r[0] for r in rates.select(timing.frames_for_seconds(0.5, F.col("r"))).collect()] == [13, 13, 14, 2]
    assert [r[0] is None for r in rates.select(timing.antialias_warning(F.col("r") * 2, 30.0)).collect()] == [False, False, False, True]


def test_costs_relax_where_no_exemplar_fits(spark):
    schema = "exemplar_id long, type string, duration double, cdev array<double>, onset double, offset double, rest double"
    bank = spark.createDataFrame([(1, "a", 1.0, [0.0, 1.0], 0.1, 0.2, 0.0), (2, "a", 1.2, [0.5, 1.0], 0.1, 0.1, 0.3), (3, "a", 9.0, [0.0, 2.0], 0.3, 0.2, 0.1)], schema)
    got = {(r.query_id, r.exemplar_id): r for r in retrieval.costs(bank.withColumnRenamed("exemplar_id", "query_id"), bank, 30.0).collect()}
    assert set(got) == {(1, 2), (2, 1), (3, 1), (3, 2)}
    assert got[3, 1].relaxed and not got[1, 2].relaxed and got[1, 2].cost == got[2, 1].cost > 0


def test_gaze_without_usable_frames_stays(spark):
    rows = spark.createDataFrame([(0, 0.3, 0.1, 0.0), (0, 0.5, NAN, 1.0), (1, 0.2, 0.4, 1.0), (1, 0.4, 0.0, 1.0)], "u int, p double, y double, c double")
    pitch, yaw = geometry.centred_gaze(F.col("p"), F.col("y"), F.col("c"), Window.partitionBy("u"))
    got = sorted((r[0], round(r[1], 9)) for r in rows.select("u", pitch).collect())
    assert got == [(0, 0.3), (0, 0.5), (1, -0.1), (1, 0.1)]
    with pytest.raises(ValueError):
        geometry.centred_gaze(F.col("p"), F.col("y"), F.col("c"), Window.partitionBy("u"), squash=True, unit="ratio")


def test_text_documents_are_checked(spark):
    rows = spark.createDataFrame([(0, i, v, c) for i, (v, c) in enumerate([(0.0, True), (-0.05, True), (0.5, True), (0.9, False), (0.4, True)])] + [(1, 0, 0.3, False)], "u int, i long, v double, c boolean")
    quantizer = levels.QUANTIZERS["translation"]
    docs = text.encode(rows, ["u"], "i", "v", F.col("c"), quantizer, 25.0)
    back = sorted(tuple(r) for r in text.decode(docs, ["u"], quantizer).collect())
    assert back == [(0, 0, 0, -0.025), (0, 1, 0, -0.025), (0, 2, 2, 0.5), (0, 4, 2, 0.4)]
    good = docs.filter("u = 0").first().doc
    for old, new in [('"version":1', '"version":2'), ('"t0":0.08', '"t0":0.05'), ('"t0":0.08', '"t0":0.04'), ("+moderate", "+huge"), ('"t1":0.2', '"t1":0.4'), ("{", "[")]:
        assert old in good
        with pytest.raises(Exception):
            text.decode(spark.createDataFrame([(0, good.replace(old, new, 1))], "u int, doc string"), ["u"], quantizer).collect()
    edited = good.replace("+moderate", "+strong", 1)
    assert [r.value for r in text.decode(spark.createDataFrame([(0, edited)], "u int, doc string"), ["u"], quantizer).collect() if r.level == 3] == [1.2]


def test_late_rows_are_listed(spark, tmp_path):
    import time

    schema = "i long, t timestamp"
    batches = [[(1, 0.0), (2, 10.0)], [(3, 5.0), (4, 8.5), (5, None)], [(6, 20.0)], [(7, 11.0), (8, 19.5)]]
    for k, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "i long, h double").select("i", F.timestamp_seconds(F.col("h") * 3600).alias("t"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    found = live.late_rows(spark, str(tmp_path / "in"), schema, "t", "1 hour", F.window("t", "2 hours")["end"], str(tmp_path / "out"), files=1)
    assert sorted((r.i, r.batch) for r in found.collect()) == [(3, 1), (7, 3)]
    again = live.late_rows(spark, str(tmp_path / "in"), schema, "t", "1 hour", F.window("t", "2 hours")["end"], str(tmp_path / "out"), files=1)
    assert again.count() == 2
