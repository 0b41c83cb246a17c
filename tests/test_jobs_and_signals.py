"""Job updates, merging of speakers and signal operators against plain versions of their rules."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.operators import jobs, merging, signals

NOW = datetime.datetime(2024, 1, 1)


def as_of(**more):
    return F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_interval(**{k: F.lit(v) for k, v in (more or {"secs": 0}).items()})


JOBS = "job_id long, status string, attempts int, updated_at timestamp_ntz, token string, ok int"


def one_after_another(names, taken):
    used, out = set(taken), {}
    for stem, order in sorted(names, key=lambda x: x[1]):
        target, n = stem, 1
        while target in used:
            target, n = f"{stem}_{n}", n + 1
        used.add(target)
        out[order] = target
    return out


CASES = [
    (["a", "a", "a_1"], []),
    (["a_1", "a", "a"], []),
    (["a", "a", "a"], ["a", "a_2"]),
    (["a", "b", "a_1", "a_1", "a"], ["a", "a_1_1"]),
    (["x"] * 30, [f"x_{i}" for i in range(0, 60, 2)]),
    (["a_01", "a", "_1", "", ""], ["a", "_1", None]),
]


@pytest.mark.parametrize("stems,taken", CASES)
def test_promoted_names_never_collide(spark, stems, taken):
    names = [(s, i) for i, s in enumerate(stems)]
    df = spark.createDataFrame(names, "stem string, order int")
    got = {r.order: r.target for r in jobs.promoted(df, spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    assert got == one_after_another(names, taken)


def test_promoted_names_of_many_stems(spark):
    rng = random.Random(1)
    names = [(rng.choice(["a", "b", "a_1", "a_2", "b_1_1"]), i) for i in range(60)]
    taken = ["a_3", "b", "a_1_1"]
    got = jobs.promoted(spark.createDataFrame(names, "stem string, order int"), spark.createDataFrame([(t,) for t in taken], "name string")).collect()
    targets = [r.target for r in got]
    assert len(set(targets)) == len(names) and not set(targets) & set(taken)
    assert all(r.target == r.stem or r.target.startswith(r.stem + "_") for r in got)


def test_results_settle_jobs(spark):
    rows = [
        (1, "PROCESSING", None, NOW, "t", 7), (2, "PROCESSING", 2, NOW, "t", 7), (3, "PROCESSING", 0, NOW, "t", 7), (4, "PROCESSING", 0, NOW, "other", 7),
        (5, "COMPLETED", 0, NOW, "t", 7), (6, "PROCESSING", 0, NOW, None, 7), (7, "PROCESSING", None, NOW, "t", 7),
    ]
    told = [(1, "t", False, False), (2, "t", False, False), (3, "t", False, True), (4, "t", True, False), (5, "t", False, False), (6, "t", True, None)]
    out = jobs.settle(spark.createDataFrame(rows, JOBS), spark.createDataFrame(told, "job_id long, result_token string, ok boolean, permanent boolean"), as_of(secs=1))
    got = {r.job_id: (r.status, r.attempts, r.updated_at > NOW, r.ok) for r in out.collect()}
    assert got == {
        1: ("PENDING", 1, True, 7), 2: ("FAILED", 3, True, 7), 3: ("FAILED", 1, True, 7), 4: ("PROCESSING", 0, False, 7),
        5: ("COMPLETED", 0, False, 7), 6: ("COMPLETED", 0, True, 7), 7: ("PROCESSING", None, False, 7),
    }


def test_null_attempts_end_after_the_last(spark):
    df = spark.createDataFrame([(1, "PROCESSING", None, NOW, "t", 7)], JOBS)
    told = spark.createDataFrame([(1, "t", False, False)], "job_id long, result_token string, ok boolean, permanent boolean")
    for _ in range(jobs.MAX_ATTEMPTS):
        df = jobs.settle(df.withColumn("status", F.lit("PROCESSING")), told, as_of())
    assert [(r.status, r.attempts) for r in df.collect()] == [("FAILED", 3)]


def test_deliveries_keep_their_time_at_the_end(spark):
    rows = [(1, "PENDING", 0, NOW, 1), (2, "PENDING", 4, NOW, 1), (3, "PENDING", 1, NOW, 1), (4, "PENDING", 1, NOW, 1), (5, "PENDING", 0, None, 1)]
    df = spark.createDataFrame(rows, "delivery_id long, status string, attempts int, next_at timestamp_ntz, ok int")
    told = spark.createDataFrame([(1, True), (2, False), (3, False), (5, True)], "delivery_id long, ok boolean")
    got = {r.delivery_id: (r.status, r.attempts, r.next_at and (r.next_at - NOW).seconds) for r in jobs.deliver(df, told, as_of()).collect()}
    assert got == {1: ("SUCCESS", 1, 0), 2: ("DEAD", 5, 0), 3: ("PENDING", 2, 10), 4: ("PENDING", 1, 0), 5: ("SUCCESS", 1, None)}


def test_children_by_place(spark):
    df = spark.createDataFrame([(1, 10, "a", "x"), (1, 20, "b", "y"), (2, 5, "c", "z")], "parent long, at long, new string, nth string")
    changes = spark.createDataFrame([(1, 1, None), (2, 0, "C"), (2, 9, "no")], "parent long, nth int, new string")
    got = sorted(map(tuple, jobs.update_nth(df, "parent", ["at"], changes, "new").collect()))
    assert got == [(1, 10, "a", "x"), (1, 20, None, "y"), (2, 5, "C", "z")]
    gone = spark.createDataFrame([(1, 0)], "parent long, nth int")
    assert sorted(r.at for r in jobs.delete_nth(df, "parent", ["at"], gone).collect()) == [5, 20]
    fresh = spark.createDataFrame([(1, 7, "n", "m")], df.schema)
    assert sorted(r.at for r in jobs.replace_children(df, fresh, "parent").collect()) == [5, 7]


def test_logs_and_stores(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("m", 1, "d")], "key string, seq int, v string")
    assert {r.key: r.v for r in jobs.latest(log, "key", ["seq"]).collect()} == {"k": "c", "m": "d"}
    store = spark.createDataFrame([("k", 9, "kept")], log.schema)
    got = jobs.upsert_missing(store, log, "key").collect()
    assert sorted((r.key, r.seq) for r in got if r.key == "k") == [("k", 9)] and sum(r.key == "m" for r in got) == 1
    assert sorted(r.seq for r in jobs.newest(log.where("key = 'k'"), F.col("seq"), 2).collect()) == [2, 3]
    ids = spark.createDataFrame([("1700000000123-4",), (None,)], "id string")
    assert [r.ms for r in ids.select(jobs.stream_ms(F.col("id")).alias("ms")).collect()] == [1700000000123, None]
    assert ids.limit(1).select(jobs.key_digest(F.lit("secret")).alias("d")).first().d == hashlib.sha256(b"secret").hexdigest()[:16]


def test_retention_takes_children_along(spark):
    rows = [(1, "COMPLETED", NOW - datetime.timedelta(days=9)), (2, "PENDING", NOW - datetime.timedelta(days=9)), (3, "FAILED", NOW), (4, None, None)]
    df = spark.createDataFrame(rows, "job_id long, status string, created_at timestamp_ntz")
    children = spark.createDataFrame([(i,) for i in (1, 1, 2, 3)], "job_id long")
    kept, left = jobs.retain(df, children, as_of(days=-3))
    assert sorted(r.job_id for r in kept.collect()) == [2, 3, 4] and sorted(r.job_id for r in left.collect()) == [2, 3]


@pytest.mark.parametrize("secret", ["key", "k" * 64, "long " * 40, "ß"])
def test_signature_is_hmac(spark, secret):
    got = spark.range(1).select(jobs.signature(secret, F.lit(17), F.lit('{"a":"ü"}')).alias("s")).first().s
    assert got == "sha256=" + hmac.new(secret.encode(), '17.{"a":"ü"}'.encode(), hashlib.sha256).hexdigest()


def test_payloads(spark):
    df = spark.createDataFrame([(1, "f", "COMPLETED", 0, None), (2, "g", "FAILED", 3, "bad"), (3, "h", "PENDING", 0, None), (4, "i", "COMPLETED", 0, None)], "job_id long, file_name string, status string, attempts int, error_message string")
    turns = spark.createDataFrame([(1, 2.0, 3.0, "B", "two"), (1, 0.0, 1.0, "A", "one")], "job_id long, start_time double, end_time double, speaker_id string, text string")
    got = {r.job_id: json.loads(r.payload) for r in jobs.payload(df, turns).collect()}
    assert [u["text"] for u in got[1]["utterances"]] == ["one", "two"] and got[4]["utterances"] == []
    assert got[2] == {"job_id": "2", "file_name": "g", "status": "FAILED", "attempts": 3, "error_message": "bad"} and 3 not in got


# Merging of speakers.

SEGMENTS = "record_id long, speaker_id string, seg_idx long, start_us long, end_us long"


def merge(spark, rows, voices=None, **given):
    df = spark.createDataFrame([(1, s, i, int(a * 1e6), int(b * 1e6)) for i, (s, a, b) in enumerate(rows)], SEGMENTS)
    heard = spark.createDataFrame([(1, s, v) for s, v in (voices or {}).items()], "record_id long, speaker_id string, voice array<double>")
    out = merging.merge_speakers(df, heard, **{"least_us": 3_000_000, "share": 0.05} | given).collect()
    return sorted(((r.speaker_id, r.start_us / 1e6, r.end_us / 1e6) for r in out), key=lambda r: r[1])


def test_a_small_speaker_goes_to_its_neighbour(spark):
    rows = [("S0", 0.0, 10.0), ("S1", 10.5, 20.5), ("S2", 20.5, 21.3), ("S0", 22.0, 32.0)]
    assert merge(spark, rows) == [("S0", 0.0, 10.0), ("S1", 10.5, 21.3), ("S0", 22.0, 32.0)]


def test_what_needs_no_merging_comes_back_as_it_was(spark):
    one = [("S0", 0.0, 5.0), ("S0", 5.0, 9.0)]
    assert merge(spark, one) == one
    few = [("S0", 0.0, 20.0), ("S1", 21.0, 22.0), ("S1", 22.0, 23.0)]
    assert merge(spark, few, asked=2) == few
    large = [("S0", 0.0, 20.0), ("S1", 20.0, 30.0), ("S1", 30.0, 40.0)]
    assert merge(spark, large) == large


def test_voices_decide(spark):
    rows = [("S0", 0.0, 10.0), ("S1", 10.0, 20.0), ("S2", 20.0, 21.0)]
    assert merge(spark, rows, {"S0": [1.0, 0.0], "S1": [0.0, 1.0], "S2": [0.98, 0.02]})[-1] == ("S0", 20.0, 21.0)
    apart = {"S0": [1.0, 0.0, 0.0], "S1": [0.0, 1.0, 0.0], "S2": [0.0, 0.0, 1.0]}
    assert {s for s, *_ in merge(spark, rows, apart)} == {"S0", "S1", "S2"}
    assert {s for s, *_ in merge(spark, rows, apart, asked=2)} == {"S0", "S1"}


def test_no_fewer_speakers_than_asked(spark):
    rows = [("S0", 0.0, 20.0), ("S1", 21.0, 23.0), ("S2", 24.0, 25.0)]
    assert {s for s, *_ in merge(spark, rows, asked=2)} == {"S0", "S1"}


def test_the_most_alike_merge_down_to_a_count(spark):
    rows = [("S0", 0.0, 20.0), ("S1", 20.0, 40.0), ("S2", 40.0, 55.0)]
    assert {s for s, *_ in merge(spark, rows, {"S0": [1.0, 0.0], "S1": [0.0, 1.0], "S2": [0.95, 0.05]}, asked=2)} == {"S0", "S1"}
    # Without voices each in turn goes to the longest of the others: S0 to S1, then S1 to the one that is left.
    assert {s for s, *_ in merge(spark, rows, asked=1)} == {"S2"}


def test_chains_and_escalation(spark):
    found = spark.createDataFrame([(1, "first", 0), (1, "second", 4), (2, "first", 2), (2, "second", 5), (3, "third", 1), (4, "first", 0)], "k long, engine string, n int")
    chosen, fallen = merging.first_usable(found, "k", ["first", "second", "third"])
    assert {r.k: r.engine for r in chosen.collect()} == {1: "second", 2: "first", 3: "third"}
    assert {(r["from"], r.to): r["count"] for r in fallen.collect()} == {("first", "second"): 1, ("first", "third"): 1}
    df = spark.createDataFrame([(1, 2), (2, None), (3, 0)], "k long, c int")
    assert [r.engine for r in merging.escalate(df, "c", "fast", "strong").orderBy("k").collect()] == ["fast", "strong", "strong"]


def test_rescued_words(spark):
    gaps = spark.createDataFrame([(1, 10_000_000, 15_000_000, 20_000_000), (1, 100_000, 200_000, 20_000_000), (1, 19_600_000, 19_990_000, 20_000_000), (1, 1_000_000, 2_000_000, 0)], "record_id long, start_us long, end_us long, duration_us long")
    got = sorted((r.from_us, r.to_us) for r in merging.rescue_slices(gaps).collect())
    assert got == [(500_000, 2_500_000), (9_500_000, 15_500_000)]
    words = spark.createDataFrame([(0, 1, "a", 0, 1), (1, 1, "b", 20_000_000, 20_000_001)], "w_idx long, record_id long, word string, start_us long, end_us long")
    heard = spark.createDataFrame([(1, "in", 1_000_000, 2_000_000, 9_500_000, 15_500_000), (1, "out", 6_000_000, 7_000_000, 9_500_000, 15_500_000)], "record_id long, word string, start_us long, end_us long, from_us long, to_us long")
    assert [(r.w_idx, r.word, r.start_us) for r in merging.rescued(words, heard).orderBy("w_idx").collect()] == [(0, "a", 0), (1, "in", 10_500_000), (2, "b", 20_000_000)]


# Signals.


def test_labels_locked_against_a_loop(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for key in range(6):
        labels = [rng.choice("AB") if rng.random() < 0.4 else "A" for _ in range(rng.choice([1, 3, 40]))]
        energies = [rng.random() for _ in labels]
        at = labels[0]
        for i, (own, e) in enumerate(zip(labels, energies)):
            window = slice(i, i + 4)
            if e < 0.3 or all(x == own for x in labels[window]) and any(x < 0.3 for x in energies[window]):
                at = own
            want[key, i] = at if i else labels[0]
            rows.append((key, i, own, e))
    got = signals.locked_labels(spark.createDataFrame(rows, "k int, i int, label string, energy double"), ["k"], "i", "label", "energy", F.lit(0.3))
    assert {(r.k, r.i): r.label for r in got.collect()} == want


def test_vanished_labels_come_back(spark):
    raw, final = "AABBBACCAC", "AAAAAAAAAA"
    df = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(raw, final))], "k int, i int, raw string, final string")
    got = "".join(r.final for r in signals.restore_vanished(df, ["k"], "i", "raw", "final").orderBy("i").collect())
    assert got == "AABBBACCAA"


@pytest.mark.parametrize("size", [1, 3, 5, 7])
def test_medians(spark, size):
    rng = random.Random(size)
    x = [rng.random() for _ in range(20)]
    padded = [0.0] * (size // 2) + x + [0.0] * (size // 2)
    got = signals.median_of(spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "k int, i int, v double"), ["k"], "i", "v", size).orderBy("i").collect()
    assert [r.v for r in got] == [statistics.median(padded[i : i + size]) for i in range(20)]


def test_windows_scores_and_gates(spark):
    x = [float(i) for i in range(10)]
    df = spark.createDataFrame([(0, x)], "k int, x array<double>")
    assert df.select(signals.windows(F.col("x"), 4, 3).alias("w")).first().w == [x[0:4], x[3:7], x[6:10]]
    assert df.select(signals.windows(F.col("x"), 11, 3).alias("w")).first().w == []
    rows = spark.createDataFrame([(k, float(v)) for k in (0, 1) for v in (1, 2, 6)] + [(2, 5.0)], "k int, v double")
    got = sorted((r.k, r.v) for r in signals.z_scores(rows, ["k"], ["v"]).collect())
    dev = np.std([1, 2, 6]) + 1e-6
    assert np.allclose([v for _, v in got], [(v - 3) / dev for v in (1, 2, 6)] * 2 + [0.0])
    loud = spark.createDataFrame([(0, i, float(i)) for i in range(100)] + [(1, 0, 1e-6)], "vec_id int, frame int, rms double")
    assert {r.frame for r in signals.loud_windows(loud).where("vec_id = 0").collect()} == set(range(5, 100)) and signals.loud_windows(loud).where("vec_id = 1").count() == 0


@pytest.mark.parametrize("rate,to", [(32_000, 16_000), (8_000, 16_000), (3, 7)])
def test_linear_resampling(spark, rate, to):
    x = [float(v) for v in np.random.default_rng(1).random(24)]
    got = spark.createDataFrame([(x,)], "x array<double>").select(signals.resampled(F.col("x"), rate, to).alias("y")).first().y
    n = len(x) * to // rate
    assert len(got) == n and np.allclose(got, np.interp(np.arange(n) * rate / to, np.arange(len(x)), x))


def test_tones(spark):
    y = spark.range(1).select(signals.tone(0.01, 440.0).alias("y")).first().y
    assert len(y) == 160 and np.allclose(y, 0.5 * np.sin(2 * np.pi * 440 / 16_000 * np.arange(160)))
