"""Rotations over time, faces, splits by count and sound on small fixed inputs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry, vectors
from weftline.operators import audio, rotations, splits

NAN = float("nan")


def _turn(degrees):
    """Six values of a turn about z."""
    a = math.radians(degrees)
    return [math.cos(a), math.sin(a), 0.0, -math.sin(a), math.cos(a), 0.0]


def test_rotation_is_that_of_columns(spark):
    rows = [[1.0, 2.0, 3.0, -1.0, 0.5, 2.0], [0.0] * 6, [0.0, 2.0, 0.0, 0.0, 4.0, 0.0], [3.0, 0.0, 0.0, 1.0, 0.0, 0.0], [NAN, 1.0, 0.0, 0.0, 1.0, 0.0]]
    df = spark.createDataFrame([(r,) for r in rows], "six array<double>")
    old = F.array(*vectors.rotation_columns([F.element_at("six", i) for i in range(1, 7)]))
    for a, b in df.select(vectors.rotation(F.col("six")), old).collect():
        assert a == pytest.approx(b)


def test_rotations_between_samples(spark):
    source = spark.createDataFrame([(1, 0.0, _turn(170)), (1, 1.0, _turn(-170)), (1, 2.0, [NAN] * 6), (2, 0.0, [None] * 6)], "u int, t double, six array<double>")
    asked = spark.createDataFrame([(1, -1.0), (1, 0.5), (1, 0.5), (1, 1.7), (2, 5.0), (3, 0.0)], "u int, t double")
    got = [(r.u, r.t, r.six) for r in rotations.interpolate(source, asked, ["u"], "t", "six").orderBy("u", "t").collect()]
    want = [(1, -1.0, _turn(170)), (1, 0.5, _turn(180)), (1, 0.5, _turn(180)), (1, 1.7, _turn(-170)), (2, 5.0, _turn(0))]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == pytest.approx(w[2], abs=1e-9)
    assert rotations.interpolate(source.limit(0), asked, ["u"], "t", "six").count() == 0


def test_mean_rotation(spark):
    df = spark.createDataFrame([(1, 0, _turn(170)), (1, 1, _turn(-150)), (1, 2, [NAN] * 6), (2, 0, [None] * 6)], "u int, i int, six array<double>")
    assert [(r.u, r.rx, r.ry, r.rz, r.n) for r in rotations.mean_rotation(df, ["u"], ["i"], "six").collect()] in ([(1, 0.0, 0.0, -170.0, 2)], [(1, -0.0, -0.0, -170.0, 2)])


def _face(opening, iris):
    points = np.full((10, 3), 0.5)
    for eye, x in ((0, 0.2), (5, 0.6)):
        points[eye], points[eye + 1] = (x, 0.5, 0), (x + 0.2, 0.5, 0)
        points[eye + 2], points[eye + 3] = (x + 0.1, 0.5 - opening / 2, 0), (x + 0.1, 0.5 + opening / 2, 0)
        points[eye + 4] = (x + 0.1 + iris[0], 0.5 + iris[1], 0)
    return points.ravel().tolist()


def test_gaze_of_irises_and_confidence(spark):
    eyes = ((0, 1, 2, 3, 4), (5, 6, 7, 8, 9))
    rows = [_face(0.024, (0.02, -0.01)), _face(0.1, (0.0, 0.0)), _face(0.0, (0.0, 0.0)), [NAN] * 30, None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<double>")
    pitch, yaw, confidence = geometry.iris_gaze(F.col("p"), F.lit(100), F.lit(200), eyes)
    got = [list(r) for r in df.orderBy("i").select(pitch, yaw, confidence, geometry.landmark_confidence(F.col("p"))).collect()]
    assert got[0][:3] == pytest.approx([1.1 * 0.1, 1.4 * 0.1, 1.0])
    assert got[1][:3] == pytest.approx([0.0, 0.0, 1.0], abs=1e-12)
    assert all(math.isnan(r[0]) and math.isnan(r[1]) and r[2] == 0 for r in got[2:])
    assert [r[3] for r in got] == pytest.approx([1.0, 1.0, 1.0, 0.0, 0.0])
    small = spark.createDataFrame([([0.5, 0.5, 0.0, 0.53, 1.2, 0.0, 0.5, 0.5, 0.0],), ([0.5, 0.5, 0.0, 0.53, 0.5, 0.0],), ([],)], "p array<double>")
    assert [r[0] for r in small.select(geometry.landmark_confidence(F.col("p"))).collect()] == pytest.approx([2 / 3, 0.2, 0.0])


def test_greedy_split(spark):
    clips = [(i, i // 10 if i < 60 else i) for i in range(100)]
    df = spark.createDataFrame(clips, "c int, s int")
    got = splits.greedy_split(df, "c", "s", seed=3).collect()
    assert len(got) == 100 and {r.split_kind for r in got} == {splits.SPEAKERS}
    assert len({(r.s, r.split) for r in got}) == 46
    left, want = {"train": 70, "val": 15, "test": 15}, {}
    for s in sorted({s for _, s in clips}, key=lambda s: hashlib.md5(f"3/{s}".encode()).hexdigest()):
        want[s] = max(left, key=left.get)  # the first of equal lacks
        left[want[s]] -= sum(o == s for _, o in clips)
    assert {r.s: r.split for r in got} == want
    again = splits.greedy_split(df.orderBy(F.desc("c")), "c", "s", seed=3).collect()
    assert {(r.c, r.split) for r in got} == {(r.c, r.split) for r in again}
    unknown = splits.greedy_split(df.withColumn("s", F.when(F.col("c") > 0, F.col("s"))), "c", "s").collect()
    assert {r.split_kind for r in unknown} == {splits.CLIPS} and len(unknown) == 100
    assert splits.greedy_split(df.limit(0), "c", "s").count() == 0


def _mel(wave):
    """Log mel frames term by term."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(8000) * k / 81 / 2595) - 1) for k in range(82)]
    out = []
    for start in range(0, len(wave) - 399, 160):
        x = [wave[start + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / 400)) for i in range(400)]
        power = np.abs(np.fft.fft(x, 512)[:257]) ** 2
        out.append([math.log(max(1e-10, sum(p * max(0.0, min((b * 31.25 - lo) / (c - lo), (hi - b * 31.25) / (hi - c))) for b, p in enumerate(power)))) for lo, c, hi in zip(edges, edges[1:], edges[2:], strict=False)])
    return out


def test_log_mel(spark):
    wave = [math.sin(0.05 * i) * 0.3 + 0.1 * math.cos(0.9 * i) for i in range(900)]
    df = spark.createDataFrame([(0, wave), (1, wave[:399]), (2, None)], "i int, w array<double>")
    got = [r[0] for r in df.orderBy("i").select(audio.log_mel(F.col("w"))).collect()]
    assert np.allclose(got[0], _mel(wave)) and len(got[0]) == 4
    assert got[1:] == [[], []]
    rows = audio.mel_filters(spark).collect()
    dense = np.zeros((257, 80))
    for r in rows:
        dense[r.bin, r.mel] = r.weight
    assert np.allclose(dense, audio._filters())


def test_chunks_break_off_and_overlap(spark):
    data = [(1, 0, 1.0, [0.5] * 1600), (1, 1, 1.1, [0.25] * 1600), (1, 2, 1.15, [1.0] * 1600), (1, 3, 1.3, [0.75] * 160), (1, 4, None, [9.0]), (1, 5, 1.4, []), (2, 0, 0.0, None)]
    chunks = spark.createDataFrame(data, "u int, i int, t double, s array<float>")
    found = audio.discontinuities(chunks, ["u"], ["i"], "t", "s").orderBy("at_sec").collect()
    assert [(r.u, r.at_sec, r.jump_sec) for r in found] == [(1, 1.15, -0.05), (1, 1.3, 0.05)]
    assert [(r.u, r.audio_start_sec, r.audio_sec) for r in audio.sound_spans(chunks, ["u"], ["i"], "t", "s").collect()] == [(1, 1.0, pytest.approx(0.31))]
    windows = spark.createDataFrame([(1, 0, 1.05, None), (1, 1, 1.2, 1.24), (2, 0, 0.0, None)], "u int, w int, t0 double, pad double")
    got = {(r.u, r.w): r for r in audio.window_audio(windows, chunks, ["u"], "w", "t0", "i", "t", "s", 0.1, "pad").collect()}
    assert got[1, 0].wave == [round(0.5 * 32767)] * 800 + [round(0.25 * 32767)] * 800
    assert all(got[1, 0].valid) and len(got[1, 0].mel) == 10
    # samples end at 1.25 and go on at 1.3: a frame is valid if its 400 samples, from 120 before its start, are there and it is before the padding
    assert got[1, 1].wave[799:801] == [32767, 0]
    assert got[1, 1].valid == [True] * 4 + [False] * 6
    assert got[1, 1].mel[5] == [math.log(1e-10)] * 80
    assert not any(got[2, 0].valid) and set(got[2, 0].wave) == {0}


def test_span_of_pictures_without_gap_at_the_end(spark):
    data = [(1, i, t) for i, t in enumerate([0.0, 0.04, 0.08, 0.5])] + [(2, i, t) for i, t in enumerate([0.0, 0.04, None, 0.08])] + [(3, 0, 1.0)]
    got = audio.picture_spans(spark.createDataFrame(data, "u int, i int, t double"), ["u"], ["i"], "t").orderBy("u").collect()
    assert [r.video_sec for r in got] == [pytest.approx(0.12), pytest.approx(0.12), None]


def test_sound_that_follows_motion(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    motion = spark.createDataFrame([(1, 0.01 * i, float(v)) for i, v in enumerate(x)], "u int, t double, v double")
    energy = spark.createDataFrame([(1, 0.01 * (i + 7), float(v)) for i, v in enumerate(x)] + [(2, 0.0, 1.0)], "u int, t double, v double")
    got = audio.sync_curve(motion, energy, ["u"], "t", "v", most=0.1).collect()
    best = max(got, key=lambda r: r.r)
    assert len(got) == 21 and best.lag_sec == pytest.approx(0.07) and best.r > 0.95
    short = audio.sync_curve(motion.filter("t < 0.15"), energy, ["u"], "t", "v", most=0.1).collect()
    assert all(math.isnan(r.r) for r in short)
