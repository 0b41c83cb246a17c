"""Operators without SQL against brute force, and readers on files written here."""

from __future__ import annotations

import io
import itertools
import tracemalloc
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechlake.functions import text
from speechlake.operators import evaluation, speakers
from speechlake.sources import annotations, recordings


def segments(spark, rows):
    return spark.createDataFrame(rows, "record_id long, seg_idx long, speaker_id string, start_us long, end_us long")


def test_best_mapping_is_the_best_permutation(spark):
    rng = np.random.default_rng(3)
    tables = {r: rng.integers(0, 50, (a, b)) for r, (a, b) in enumerate([(1, 1), (3, 3), (2, 4), (4, 2), (5, 5), (6, 4)])}
    rows = [(r, f"r{i}", f"h{j}", int(v)) for r, t in tables.items() for (i, j), v in np.ndenumerate(t)]
    got = {x.record_id: x.matched_us for x in evaluation.best_mapping(spark.createDataFrame(rows, "record_id long, ref string, hyp string, us long")).collect()}
    for r, t in tables.items():
        t = t if t.shape[0] <= t.shape[1] else t.T
        assert got[r] == max(sum(int(t[i, c]) for i, c in enumerate(p)) for p in itertools.permutations(range(t.shape[1]), t.shape[0]))


def test_diarization_error_counts_every_instant(spark):
    rng = np.random.default_rng(5)
    make = lambda names: [(1, k, str(rng.choice(names)), int(s), int(s + rng.integers(1, 12))) for k, s in enumerate(rng.integers(0, 60, 12))]
    ref, hyp = make(["a", "b", "c"]), make(["x", "y", "z"])
    at = lambda rows, t: {r[2] for r in rows if r[3] <= t < r[4]}
    line = [(at(ref, t), at(hyp, t)) for t in range(100)]
    matched = max(sum(len({m[s] for s in r} & h) for r, h in line) for p in itertools.permutations("xyz") for m in [dict(zip("abc", p))])
    got = evaluation.diarization_error(segments(spark, ref), segments(spark, hyp)).first()
    assert got.total_us == sum(len(r) for r, _ in line)
    assert got.missed_us == sum(max(0, len(r) - len(h)) for r, h in line)
    assert got.false_us == sum(max(0, len(h) - len(r)) for r, h in line)
    assert got.confused_us == sum(min(len(r), len(h)) for r, h in line) - matched


def test_average_linkage_merges_the_closest_means():
    d = speakers.cosine_distances(np.random.default_rng(7).normal(size=(14, 5)))
    found = speakers.average_linkage(d, 1)
    groups = [{i} for i in range(14)]
    while len(groups) > 1:
        a, b = min(itertools.combinations(groups, 2), key=lambda p: np.mean([d[i, j] for i in p[0] for j in p[1]]))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
        labels = found[len(groups)]
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == {frozenset(g) for g in groups}


def test_speaker_count_of_planted_voices():
    rng = np.random.default_rng(11)
    voices = np.repeat(np.eye(8)[:3], 6, axis=0) + rng.normal(scale=0.05, size=(18, 8))
    assert speakers.count_speakers(voices) == (3, "silhouette_max")
    assert speakers.count_speakers(voices[:6])[0] == 1
    assert speakers.count_speakers(voices[:1]) == (1, "insufficient_segments")


CASES = [("a b a b a b c", "a b c"), ("A b a B a b", "A b"), ("a b a b c d", "a b a b c d"), ("x x x", "x x x"), ("", ""), (None, None)]


def test_phrases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    assert [r.o for r in df.select("i", text.collapse_phrases(F.col("t")).alias("o")).orderBy("i").collect()] == [w for _, w in CASES]


ERRORS = [("ValueError", "x", True), ("OSError", "No such file: a", True), ("TransientJobError", "corrupt", False), ("OSError", "timeout", False), (None, None, False)]


def test_permanent_errors(spark):
    df = spark.createDataFrame([(i, k, m) for i, (k, m, _) in enumerate(ERRORS)], "i int, k string, m string")
    got = df.select("i", text.is_permanent(F.col("k"), F.col("m")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [p for _, _, p in ERRORS]


def test_rttm_and_labels(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("# head\n\nSPEAKER rec 1 0.500 1.250 <NA> <NA> S0 <NA> <NA>\nSPEAKER rec 1 x\nLEXEME rec 1 0 1 a b c\n")
    assert [tuple(r) for r in annotations.read_rttm(spark, str(tmp_path / "a.rttm")).collect()] == [("rec", "S0", 500_000, 1_750_000)]
    (tmp_path / "b.txt").write_text("0.5\t1.5\tS0\n2.0\tS1\nbad\n")
    assert sorted(tuple(r) for r in annotations.read_labels(spark, str(tmp_path / "b.txt")).collect()) == [("b", "S0", 500_000, 1_500_000), ("b", "S1", 2_000_000, 2_500_000)]


def test_recordings(spark, tmp_path):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(32_000)
        f.writeframes(np.repeat(np.arange(3200, dtype="<i2"), 2).tobytes())
    (tmp_path / "a.wav").write_bytes(raw.getvalue())
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    (tmp_path / "c.wav").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"x")
    files = recordings.scan(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in recordings.decode(files).collect()}
    assert sorted(rows) == ["a.wav", "b.wav"] and rows["b.wav"].samples is None
    assert (rows["a.wav"].rate, rows["a.wav"].channels, len(rows["a.wav"].samples)) == (32_000, 2, 1600)
    assert rows["a.wav"].samples[5] == pytest.approx(10 / 32768)
    assert {r.k for r in files.select(recordings.kind(F.col("content")).alias("k")).collect()} == {"wav", None}


def test_speaker_map(spark):
    answers = {
        '[{"idx": 1, "speaker": " A "}, {"idx": "2", "speaker": "B"}]': {1: "A", 2: "B"},
        'Sure:\n```json\n[{"idx": 0, "speaker": "A"},\n {"idx": 0, "speaker": "C"}]\n```\n[1]': {0: "C"},
        '```\n[{"idx": 5, "speaker": 7}, 3, {"idx": 6}]': {5: "7"},
        '[{"idx": "x", "speaker": "A"}, {"idx": 1, "speaker": "B"}]': {},
        '[{"idx": 1, "speaker": ': {},
        "no list": {},
        "[]": {},
        "": {},
        None: {},
    }
    df = spark.createDataFrame(list(enumerate(answers)), "n int, answer string")
    got = {r.n: r.m for r in df.select("n", text.speaker_map(F.col("answer")).alias("m")).collect()}
    assert [got[n] for n in range(len(answers))] == list(answers.values())


def test_linkage_keeps_nearest_others():
    rng = np.random.default_rng(5)
    for n, x in ((40, rng.standard_normal((40, 5))), (30, rng.integers(-1, 2, (30, 2)).astype(float))):
        d = speakers.cosine_distances(x)
        near, sizes, labels = d.copy(), np.ones(n), np.arange(n)
        np.fill_diagonal(near, np.inf)
        found = speakers.average_linkage(d, 2)
        for k in range(n - 1, 1, -1):
            i, j = sorted(divmod(int(np.argmin(near)), n))
            near[i] = near[:, i] = (sizes[i] * near[i] + sizes[j] * near[j]) / (sizes[i] + sizes[j])
            near[i, i] = near[j] = near[:, j] = np.inf
            sizes[i] += sizes[j]
            labels[labels == j] = i
            assert (found[k] == np.unique(labels, return_inverse=True)[1]).all()
        assert list(speakers.average_linkage(d, 2, most=3)) == [3, 2]


def test_blockwise_eigengaps_are_those_of_the_whole_matrix():
    rng = np.random.default_rng(5)
    copies = rng.standard_normal((1100, 16))
    copies[:500], copies[500:530], copies[530] = copies[0], 0, np.nan
    for x in (rng.standard_normal((1200, 16)), copies, np.eye(16)[rng.integers(0, 16, 1100)], np.ones((1100, 4)), rng.standard_normal((40, 8))):
        most = min(10, len(x))
        assert np.abs(speakers.blockwise_eigengaps(x, most) - speakers.eigengaps(speakers.cosine_distances(x), most)).max() < 1e-9


def test_blockwise_eigengaps_hold_no_square():
    x = np.random.default_rng(6).standard_normal((4000, 16))
    tracemalloc.start()
    speakers.blockwise_eigengaps(x, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 4000 * 8


def test_blockwise_linkage_is_that_of_the_whole_matrix():
    rng = np.random.default_rng(9)
    n = 1100
    copies, empty, first, broken = (rng.standard_normal((n, 16)) for _ in range(4))
    copies[rng.permutation(n)[:500]] = copies[0]
    empty[rng.permutation(n)[:40]], first[rng.permutation(n)[:40]], first[0] = 0, 0, 0
    broken[5, 2], broken[9] = np.inf, np.nan
    axes = np.eye(16)[rng.integers(0, 16, n)]
    axes[rng.permutation(n)[:40]] = 0
    with np.errstate(invalid="ignore"):
        for x in (rng.standard_normal((n, 16)), rng.standard_normal((n, 1)), copies, empty, first, broken, axes, np.zeros((n, 4)), np.ones((n, 4)), rng.standard_normal((40, 8))):
            d = speakers.cosine_distances(x)
            for cut in ({"most": 30}, {"least": 3, "limit": 0.6}, {"limit": 1.05, "most": 30}, {"least": 2, "limit": 0.5, "most": 6}):
                want, got = speakers.average_linkage(d, **cut), speakers.blockwise_linkage(x, **cut)
                assert list(got) == list(want)
                assert all((got[k] == want[k]).all() for k in want)


def test_blockwise_linkage_holds_no_square():
    x = np.random.default_rng(6).standard_normal((4000, 16))
    tracemalloc.start()
    speakers.blockwise_linkage(x, 3, most=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 4000 * 8


def test_clusters_of_a_large_record(spark, tmp_path):
    x = np.random.default_rng(8).standard_normal((2400, 8)).astype("f4")
    pd.DataFrame({"vec_id": np.arange(2400) * 20, "embedding": list(x), "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    got = speakers.agglomerative(spark, str(tmp_path)).orderBy("vec_id").toPandas()["cluster"]
    assert (got == speakers.average_linkage(speakers.cosine_distances(x.astype(float)), 3, most=3)[3]).all()


def test_blockwise_silhouettes_are_those_of_the_whole_matrix():
    rng = np.random.default_rng(10)
    voices = np.repeat(np.eye(8)[:3], 400, axis=0) + rng.normal(scale=0.05, size=(1200, 8))
    empty = voices.copy()
    empty[rng.permutation(1200)[:40]] = 0
    for x in (voices, empty, np.repeat(np.eye(4), 300, axis=0), rng.standard_normal((1200, 8)), rng.standard_normal((40, 8))):
        cuts = list(speakers.blockwise_linkage(x, 2, most=6).values()) + [rng.integers(0, 4, len(x))]
        d = speakers.cosine_distances(x)
        assert np.allclose(speakers.blockwise_silhouettes(x, cuts), [speakers.silhouette(d, c) for c in cuts], rtol=0, atol=1e-9)
    assert speakers.count_speakers(voices) == speakers.count_speakers(voices, method="eigengap")[:1] + ("silhouette_max",) == (3, "silhouette_max")
    assert speakers.count_speakers(voices[:400])[0] == 1
    voices[5, 2] = np.inf
    with np.errstate(invalid="ignore"), pytest.raises(np.linalg.LinAlgError):
        speakers.blockwise_eigengaps(voices, 6)


def test_speaker_count_holds_no_square():
    x = np.repeat(np.eye(16)[:4], 1000, axis=0) + np.random.default_rng(6).normal(scale=0.05, size=(4000, 16))
    tracemalloc.start()
    assert speakers.count_speakers(x) == (4, "silhouette_max")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 4000 * 8


def test_records_are_dealt_to_more_tasks_than_their_bytes_ask_for(spark):
    voices = spark.range(200).selectExpr("id % 20 AS record_id", "id AS vec_id", "array(1.0, double(id)) AS embedding")
    found = speakers.per_record(voices, "record_id long, n int", lambda r, ids, x: {"record_id": [r], "n": [len(x)]})
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.record_id, r.n) for r in rows) == [(r, 10) for r in range(20)]
    assert len({r.task for r in rows}) > 10
