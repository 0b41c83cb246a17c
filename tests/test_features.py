"""Voice features against double loops, planted tones and direct convolution; clustering against a plain version."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.operators import features

RATE = 16_000


def plain_cepstra(x, rate, count=13):
    size, step, points = int(rate * 0.025), int(rate * 0.010), 512
    n = 1 + math.ceil((len(x) - size) / step)
    x = list(x) + [0.0] * ((n - 1) * step + size - len(x))
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = [math.floor((points + 1) * 700 * (10 ** (top * i / 27 / 2595) - 1) / rate) for i in range(28)]
    out = []
    for f in range(n):
        frame = [x[f * step + i] * (0.54 - 0.46 * math.cos(2 * math.pi * i / (size - 1))) for i in range(size)]
        power = []
        for k in range(points // 2 + 1):
            re = sum(v * math.cos(2 * math.pi * k * i / points) for i, v in enumerate(frame[:points]))
            im = sum(v * math.sin(2 * math.pi * k * i / points) for i, v in enumerate(frame[:points]))
            power.append((re * re + im * im) / points)
        levels = []
        for m in range(1, 27):
            a, b, c = edges[m - 1 : m + 2]
            e = sum(power[k] * (k - a) / (b - a) for k in range(a, b)) + sum(power[k] * (c - k) / (c - b) for k in range(b, c))
            levels.append(20 * math.log10(e or np.finfo(float).eps))
        out.append([sum(v * math.cos(math.pi * k * (2 * i + 1) / 52) for i, v in enumerate(levels)) for k in range(1, count + 1)])
    slopes = [[0.0] * count] * n if n <= 2 else [[(out[min(i + 1, n - 1)][k] - out[max(i - 1, 0)][k]) / (min(i + 1, n - 1) - max(i - 1, 0)) for k in range(count)] for i in range(n)]
    return np.array([a + b for a, b in zip(out, slopes)])


@pytest.mark.parametrize("rate,n", [(8_000, 500), (8_000, 200), (16_000, 900), (1_000, 64)])
def test_cepstra_against_loops(rate, n):
    x = np.random.default_rng(n).normal(size=n)
    got = features.cepstra(x, rate)
    assert got.shape == plain_cepstra(x, rate).shape and np.allclose(got, plain_cepstra(x, rate), atol=1e-6)


def test_short_and_silent_signals_have_defined_features():
    assert features.cepstra(np.ones(10), RATE).tolist() == [[0.0] * 26]
    assert np.isfinite(features.cepstra(np.zeros(1000), RATE)).all()


@pytest.mark.parametrize("hertz", [110.0, 160.0, 220.0, 320.0])
def test_planted_pitches(hertz):
    t = np.arange(RATE // 5) / RATE
    x = np.sin(2 * np.pi * hertz * t) + 0.3 * np.sin(4 * np.pi * hertz * t)
    pitch, centroid = features.pitch_and_centroid(x, RATE)
    lag = RATE / hertz
    assert abs(RATE / pitch - lag) <= 1
    plain = np.correlate(x, x, "full")[len(x) - 1 :]
    first, last = int(RATE / 350), int(RATE / 100)
    assert pitch == RATE / (first + int(np.argmax(plain[first:last])))
    size = np.abs(np.fft.rfft(x * np.hamming(len(x))))
    assert math.isclose(centroid, (np.fft.rfftfreq(len(x), 1 / RATE) * size).sum() / size.sum(), rel_tol=1e-6)


def test_silence_has_no_pitch(spark):
    rows = [(1, [0.0] * 400), (2, None), (3, []), (4, [1e-5] * 400), (5, [float("nan")] * 400), (6, [0.5, -0.5]), (7, [math.sin(i) for i in range(400)])]
    df = spark.createDataFrame([(i, x, 9.0) for i, x in rows], "vec_id long, samples array<double>, pitch double")
    got = {r.vec_id: (r.pitch, r.centroid is None) for r in features.pitch(df, RATE).collect()}
    assert got[1] == (None, True) and got[4] == (None, True) and got[6] == (0.0, False) and set(got) == {1, 4, 6, 7}
    frames = features.frame_features(df, RATE).collect()
    assert {r.vec_id for r in frames} == {1, 4, 6, 7} and all(len(r.features) == 26 for r in frames)
    assert features.frame_features(df.limit(0), RATE).count() == 0 and features.pitch(df.limit(0), RATE).count() == 0


def direct(x, rate, to, half=16):
    """Each output sample by its own sum over all input samples."""
    cut = min(1.0, to / rate)
    reach = math.ceil(half / cut)
    out = []
    for i in range(-(-len(x) * to // rate)):
        at = i * rate / to
        weights = {j: cut * np.sinc(cut * (j - at)) * (0.5 + 0.5 * math.cos(math.pi * (j - at) / reach)) for j in range(math.floor(at) - reach + 1, math.floor(at) + reach + 1) if abs(j - at) < reach}
        out.append(sum(w * x[j] for j, w in weights.items() if 0 <= j < len(x)) / sum(weights.values()))
    return np.array(out)


@pytest.mark.parametrize("rate,to", [(32_000, 16_000), (44_100, 16_000), (8_000, 16_000), (3, 2), (5, 7), (4, 4)])
def test_filter_bank_against_direct_sums(rate, to):
    x = np.random.default_rng(1).normal(size=300)
    got = features.resampled(x, rate, to)
    assert np.allclose(got, direct(x, rate, to) if rate != to else x, atol=1e-9)


def test_resampling_keeps_tones_and_drops_what_the_new_rate_cannot_hold(spark):
    t = np.arange(4800) / 48_000
    low, high = np.sin(2 * np.pi * 1_000 * t), np.sin(2 * np.pi * 15_000 * t)
    df = spark.createDataFrame([(0, low.tolist()), (1, high.tolist())], "vec_id long, samples array<double>")
    got = {r.vec_id: np.array(r.samples) for r in features.resample(df, 48_000, 16_000).collect()}
    assert len(got[0]) == 1600
    assert np.abs(got[0][100:-100] - np.sin(2 * np.pi * 1_000 * np.arange(1600) / 16_000)[100:-100]).max() < 1e-3
    assert np.abs(got[1][100:-100]).max() < 1e-3


def plain_clusters(v):
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
    a = np.linalg.svd(u - u.mean(0), full_matrices=False)[2][0]
    a = a if a[np.abs(a) > 1e-9][0] > 0 else -a
    w = u @ a
    start = (w > np.median(w) + 1e-12).astype(int)
    labels, unit = start, lambda x: x / (np.linalg.norm(x) + 1e-8)
    if len(set(start)) < 2:
        return start
    for _ in range(50):
        m = [unit(u[labels == k].sum(0)) for k in (0, 1)]
        new = (u @ m[1] > u @ m[0]).astype(int)
        if len(set(new)) < 2:
            return start
        if (new == labels).all():
            break
        labels = new
    return labels


def test_two_speakers_against_a_plain_version(spark):
    rng = np.random.default_rng(7)
    groups = {
        0: np.concatenate([rng.normal(size=(20, 6)) * 0.2 + [3, 0, 0, 1, 0, 0], rng.normal(size=(9, 6)) * 0.2 + [0, 3, 0, 0, 1, 0]]),
        1: rng.normal(size=(40, 6)),
        2: rng.normal(size=(1, 6)),
        3: np.tile(rng.normal(size=6), (5, 1)),
        4: rng.normal(size=(2, 6)),
    }
    rows = [(k, i, v.tolist(), "x") for k, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (0, 99, None, "x")], "rec long, idx long, v array<double>, label string").repartition(5)
    got = {(r.rec, r.idx): r.label for r in features.two_speakers(df, "rec").collect()}
    assert len(got) == len(rows)
    for k, x in groups.items():
        assert [got[k, i] for i in range(len(x))] == plain_clusters(x).tolist(), k
    assert len({got[0, i] for i in range(20)}) == 1 and {got[0, i] for i in range(20, 29)} == {1 - got[0, 0]}
    assert features.two_speakers(df.limit(0), "rec").count() == 0


def test_queries_have_rows_for_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert features.q_cepstra(spark, sf).select("vec_id").distinct().count() == n
    assert features.q_two_speakers(spark, sf).where(F.col("label").isin(0, 1)).count() == n
