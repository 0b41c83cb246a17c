"""Interval joins on cells, differences, neighbours in time and error rates with a collar, against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from speechlake.operators import cells, coverage, evaluation, intervals, turns
from speechlake.operators.cells import Grid
from speechlake.sources import fixtures

SEGMENTS = "record_id long, speaker_id string, seg_idx long, start_us long, end_us long"


def spans(rng, n, records=3, wide=200, empty=0.1):
    out = []
    for i in range(n):
        lo = rng.randrange(-wide, wide)
        size = 0 if rng.random() < empty else rng.choice([1, 3, 10, 80, 400])
        out.append((rng.randrange(records), i, lo, lo + size))
    return out


@pytest.mark.parametrize("grain,levels", [(1, 9), (8, 3), (16, 0), (1000, 2)])
def test_covers_are_disjoint_whole_and_small(spark, grain, levels):
    rng = random.Random(grain)
    rows = spans(rng, 60)
    df = spark.createDataFrame(rows, "r long, i long, lo long, hi long")
    grid = Grid(grain, levels)
    covers = {}
    for c in cells.in_cells(df, "lo", "hi", grid, None).collect():
        covers.setdefault(c.i, []).append((c._level, c._cell))
    for _, i, lo, hi in rows:
        got = sorted(g for level, cell in covers[i] for g in range(cell << level, (cell + 1) << level))
        assert got == list(range(lo // grain, hi // grain + 1))
        n = len(got)
        if n < 1 << levels:
            assert len(covers[i]) <= 2 * n.bit_length()


@pytest.mark.parametrize("grids", [(None, None), (Grid(1, 10), Grid(1, 10)), (Grid(4, 2), Grid(64, 3)), (Grid(32, 0), Grid(8, 6))])
def test_every_meeting_pair_once(spark, grids):
    rng = random.Random(2)
    left, right = spans(rng, 70), spans(rng, 60)
    backwards = [(0, 900, 50, 10), (0, 901, None, 5), (0, 902, 5, None)]
    a = spark.createDataFrame([*left, *backwards], "r long, i long, a0 long, a1 long")
    b = spark.createDataFrame([*right, (0, 950, 30, -30)], "r long, j long, b0 long, b1 long")
    want = sorted((x[1], y[1]) for x, y in itertools.product(left, right) if x[0] == y[0] and max(x[2], y[2]) <= min(x[3], y[3]))
    got = cells.meet(a, b, ["r"], ("a0", "a1"), ("b0", "b1"), *grids)
    assert sorted((p.i, p.j) for p in got.collect()) == want and want
    outer = cells.meet(a, b, ["r"], ("a0", "a1"), ("b0", "b1"), *grids, how="left").collect()
    assert sorted((p.i, p.j) for p in outer if p.j is not None) == want
    assert sorted(p.i for p in outer if p.j is None) == sorted(x[1] for x in [*left, *backwards])
    assert cells.meet(a.limit(0), b, ["r"], ("a0", "a1"), ("b0", "b1")).count() == 0


def test_overlap_pairs_on_uneven_lengths(spark):
    rng = random.Random(3)
    rows = [(r, f"s{i % 4}", i, lo, hi) for r, i, lo, hi in spans(rng, 150)] + [(0, "s9", 999, -10_000, 10_000), (0, "s8", 998, -10_000, 10_000)]
    got = intervals.overlap_pairs(spark.createDataFrame(rows, SEGMENTS), least_us=2).collect()
    want = set()
    for x, y in itertools.combinations(rows, 2):
        x, y = sorted((x, y), key=lambda s: (s[3], s[2]))
        if x[0] == y[0] and x[1] != y[1] and min(x[4], y[4]) - max(x[3], y[3]) > 2:
            want.add((x[0], x[2], y[2], max(x[3], y[3]), min(x[4], y[4])))
    assert {(p.record_id, p.seg_a, p.seg_b, p.start_us, p.end_us) for p in got} == want and len(got) == len(want)


def test_differences_by_single_steps(spark):
    rng = random.Random(4)
    rows, holes = spans(rng, 40), spans(rng, 50)
    holes += [(0, i, -250, 300 + i) for i in range(12)] + [(0, 0, -200, 0)]
    a = spark.createDataFrame([(r, i, lo, hi) for r, i, lo, hi in rows], "record_id long, island long, start_us long, end_us long")
    b = spark.createDataFrame([(r, lo, hi) for r, _, lo, hi in holes], "record_id long, start_us long, end_us long")
    for grids in ((None, None), (Grid(2, 4), Grid(2, 4))):
        left = {}
        for p in intervals.difference(a, b, *grids).collect():
            assert p.end_us > p.start_us
            left.setdefault(p.island, []).extend(range(p.start_us, p.end_us))
        for r, i, lo, hi in rows:
            want = [t for t in range(lo, hi) if not any(h[0] == r and h[2] <= t < h[3] for h in holes)]
            assert sorted(left.get(i, [])) == want
    whole = intervals.difference(a, b.limit(0), Grid(2, 4), Grid(2, 4)).collect()
    assert sorted((p.island, p.start_us, p.end_us) for p in whole) == sorted((i, lo, hi) for _, i, lo, hi in rows if hi > lo)


@pytest.mark.parametrize("block", [1, 37, 1 << 40])
def test_nearest_on_both_sides(spark, block):
    rng = random.Random(block)
    rows = [(r, i, lo, hi, rng.random() < 0.3) for r, i, lo, hi in spans(rng, 120, records=4, wide=900)]
    rows += [(9, 500, 0, 5, True), (8, 501, 0, 5, False), (7, 502, 10, 20, True), (7, 503, 20, 30, False), (7, 504, 0, 10, False), (7, 505, 0, 10, False)]
    df = spark.createDataFrame(rows, "r long, idx long, lo long, hi long, small boolean")
    got = {p.idx: (p.near, p.distance_us) for p in cells.nearest(df, F.col("small"), ["r"], block_us=block).collect()}
    for r, i, lo, hi, small in rows:
        others = [o for o in rows if small and o[0] == r and not o[4]]
        ranked = [((False, 0, o[1]) if o[2] < hi and lo < o[3] else (True, max(0, lo - o[3], o[2] - hi), o[1])) for o in others]
        best = min(ranked, default=None)
        assert got.get(i) == ((best[2], best[1]) if best else None), i


def test_nearest_major_of_intervals_without_length(spark):
    # A point overlaps nothing: 1 overlaps 11 though 10 comes first, 2 lies within 21 and touches 20.
    rows = [(1, "s", 1, 0, 10), (1, "m", 10, 5, 5), (1, "m", 11, 8, 900), (2, "s", 2, 50, 50), (2, "m", 20, 40, 50), (2, "m", 21, 30, 900)]
    segments = spark.createDataFrame(rows, "record_id long, speaker_id string, seg_idx long, start_us long, end_us long")
    speakers = spark.createDataFrame([(r, s, s == "s") for r in (1, 2) for s in "sm"], "record_id long, speaker_id string, small boolean")
    got = {r.seg_idx: (r.near_idx, r.distance_us) for r in coverage.nearest_major(segments, speakers).collect()}
    assert got == {1: (11, 0), 2: (20, 0)}


def test_words_of_odd_times_keep_their_rows(spark):
    words = spark.createDataFrame([(1, 0, 5, 9), (1, 1, 20, 20), (1, 2, None, 9), (1, 3, 90, 95), (2, 0, 5, 9), (1, 4, 9, 5)], "record_id long, w_idx long, start_us long, end_us long")
    segments = spark.createDataFrame([(1, "A", 0, 0, 8), (1, "B", 1, 7, 20), (1, "C", 2, 20, 20)], SEGMENTS)
    got = {(r.record_id, r.w_idx): r.speaker_id for r in turns.attribute(words, segments).collect()}
    assert got == {(1, 0): "A", (1, 1): "B", (1, 2): turns.UNKNOWN, (1, 3): turns.UNKNOWN, (2, 0): turns.UNKNOWN, (1, 4): turns.UNKNOWN}


def exchanges(df):
    """How often the plan exchanges rows by key, as planned before anything is measured."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("block", [1, 7, 1 << 25])
def test_words_meet_intervals_in_blocks(spark, block):
    rng = random.Random(block)
    words = [(r, i, lo, hi) for r, i, lo, hi in spans(rng, 80, records=3, wide=300)]
    parts = [(r, rng.choice("AB"), i, lo, hi) for r, i, lo, hi in spans(rng, 40, records=3, wide=300)]
    frame = spark.createDataFrame(words, "record_id long, w_idx long, start_us long, end_us long")
    for by_record in (False, True):
        got = {r.w_idx: r.speaker_id for r in turns.attribute(frame, spark.createDataFrame(parts, SEGMENTS), by_record, block).collect()}
        for r, i, lo, hi in words:
            ranked = []
            for q, name, seg, s0, s1 in parts:
                holds, shared = 2 * s0 <= lo + hi <= 2 * s1, min(hi, s1) - max(lo, s0)
                if q == r and lo <= hi and (holds or shared > 0):
                    ranked.append((not holds, 0 if holds else -shared, seg, name))
            assert got[i] == (min(ranked)[3] if ranked else turns.UNKNOWN), i
    # One row of a word goes to the join, not one a level and another for what meets nothing.
    assert turns.attribute(frame, spark.createDataFrame(parts, SEGMENTS))._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2


def test_turns_are_numbered_before_words(spark, tmp_path):
    rows = [(1, 0, "user", "a b"), (1, 1, "user", "c d e"), (1, 1, "agent", " f "), (1, 2, "user", None), (1, 3, "agent", "  "), (1, 4, "agent", "g"), (2, 0, "user", "h")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    words = fixtures.words_cv(spark, str(tmp_path))
    assert exchanges(words) == 1
    got = {(r.record_id, r.w_idx): r.word for r in words.collect()}
    assert "".join(got[1, i] for i in (0, 1)) == "ab" and {got[1, 2], got[1, 3]} == set("cf") and "".join(got[1, i] for i in (4, 5, 6)) == "deg" and got[2, 0] == "h" and len(got) == 8
    told = fixtures.segments_cv(spark, str(tmp_path))
    assert "Generate explode" not in told._jdf.queryExecution().optimizedPlan().toString() and "posexplode" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in told.collect()) == [(1, 0, "user", -600_000, 100_000), (1, 1, "agent", 500_000, 2_000_000), (1, 4, "agent", 3_000_000, 3_300_000), (2, 0, "user", -600_000, -300_000)]


@pytest.mark.parametrize("block", [5, 1 << 32])
def test_speech_filter_joins_no_words(spark, block):
    rng = random.Random(block)
    words = [*spans(rng, 90, records=5, wide=400), (3, 900, None, 5), (None, 901, 1, 2), (77, 902, None, 5)]
    speech = [s for s in spans(rng, 12, records=3, wide=400)] + [(4, 99, 50, 20)]
    out = coverage.vad_filter(spark.createDataFrame(words, "record_id long, w_idx long, start_us long, end_us long"), spark.createDataFrame([(r, lo, hi) for r, _, lo, hi in speech], "record_id long, start_us long, end_us long"), 3, block)
    want = set()
    for r, i, lo, hi in words:
        own = [s for s in speech if s[0] == r]
        if not own or any(lo is not None and 2 * (s - 3) <= lo + hi <= 2 * (e + 3) for _, _, s, e in own):
            want.add(i)
    assert {r.w_idx for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def plain_error(ref, hyp, collar):
    """Millisecond by millisecond, all one-to-one mappings."""
    edges = [t for _, s, e in ref if e > s for t in (s, e)]
    line = [t for t in range(-2000, 4000) if not any(b - collar // 2 <= t < b + collar - collar // 2 for b in edges)]
    open_ = lambda side, t: {s for s, a, b in side if a <= t < b}
    total = missed = false = both = 0
    shared = {}
    for t in line:
        r, h = open_(ref, t), open_(hyp, t)
        total, missed, false, both = total + len(r), missed + max(0, len(r) - len(h)), false + max(0, len(h) - len(r)), both + min(len(r), len(h))
        for p in itertools.product(r, h):
            shared[p] = shared.get(p, 0) + 1
    rs, hs = sorted({s for s, *_ in ref}), sorted({s for s, *_ in hyp})
    hs += [None] * len(rs)
    matched = max((sum(shared.get(p, 0) for p in zip(rs, perm)) for perm in itertools.permutations(hs, len(rs))), default=0)
    return total, missed, false, both - matched


@pytest.mark.parametrize("collar", [0, 40, 251])
def test_error_rate_with_a_collar(spark, collar):
    rng = random.Random(collar)
    ref, hyp = [], []
    for _ in range(9):
        s = rng.randrange(0, 1500)
        ref.append((f"r{rng.randrange(3)}", s, s + rng.choice([0, 30, 200, 600])))
        s = rng.randrange(0, 1500)
        hyp.append((f"h{rng.randrange(3)}", s, s + rng.choice([20, 200, 700])))
    frame = lambda side: spark.createDataFrame([(1, s, i, a * 1000, b * 1000) for i, (s, a, b) in enumerate(side)], SEGMENTS)
    got = evaluation.diarization_error(frame(ref), frame(hyp), collar * 1000).first()
    if collar % 2:
        ref, hyp = [(s, 2 * a, 2 * b) for s, a, b in ref], [(s, 2 * a, 2 * b) for s, a, b in hyp]
        want = [x * 500 for x in plain_error(ref, hyp, 2 * collar)]
    else:
        want = [x * 1000 for x in plain_error(ref, hyp, collar)]
    assert [got.total_us, got.missed_us, got.false_us, got.confused_us] == want


def test_error_rate_where_a_collar_leaves_nothing(spark):
    ref = spark.createDataFrame([(1, "a", 0, 0, 10), (2, "a", 0, 0, 10)], SEGMENTS)
    hyp = spark.createDataFrame([(2, "b", 0, 100, 200)], SEGMENTS)
    assert evaluation.diarization_error(ref, hyp.limit(0), 100).count() == 0
    got = evaluation.diarization_error(ref, hyp, 100).collect()
    assert [(r.record_id, r.total_us, r.false_us, r.der_pct) for r in got] == [(2, 0, 100, 0.0)]
