"""The signed-rank p-value against counting all sign patterns, and the measures' odd cases."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from speechlake.operators import evaluation, exports, turns, vectors


def p_of(spark, diffs):
    return evaluation.rank_p_value(spark.createDataFrame([(d,) for d in diffs], "d double"), "d").first()


def test_p_value_counts_sign_patterns(spark):
    diffs = [1.0, -2.0, 3.0, 4.0, 5.5, -6.0, 7.0, 8.0]
    w = min(sum(i for i, d in enumerate(diffs, 1) if d > 0), sum(i for i, d in enumerate(diffs, 1) if d < 0))
    patterns = [sum(i for i, s in enumerate(signs, 1) if s) for signs in itertools.product([0, 1], repeat=len(diffs))]
    got = p_of(spark, diffs)
    assert (got.w, got.n) == (w, len(diffs))
    assert got.p_value == pytest.approx(2 * sum(x <= w for x in patterns) / len(patterns))


def test_p_value_with_ties_is_the_normal_approximation(spark):
    # Ranks 1.5, 1.5, 3, 4.5, 4.5; the negative ones add up to 1.5.
    spread = math.sqrt((5 * 6 * 11 - 2 * (2**3 - 2) / 2) / 24)
    assert p_of(spark, [1.0, -1.0, 2.0, 3.0, 3.0, None, math.nan]).p_value == pytest.approx(math.erfc(6 / spread / math.sqrt(2)))


def test_p_value_of_nothing_is_one(spark):
    assert [p_of(spark, d).p_value for d in ([], [0.0, 0.0], [None])] == [1.0, 1.0, 1.0]


def test_count_summary_leaves_out_unknown_counts(spark):
    rows = [(2, 2, 1.0, 10.0), (3, 2, 1.0, 0.0), (None, 2, 3.0, 10.0), (2, None, None, None)]
    got = evaluation.speaker_count_summary(spark.createDataFrame(rows, "expected int, found int, seconds double, duration_s double")).first()
    assert tuple(got) == (2, 50.0, 0.5, 0.2)


def test_text_report_without_a_recording(spark):
    turns = spark.createDataFrame([(1, 0, "A", 0, 59_999_000, None), (1, 1, "B", 60_000_000, 61_005_000, "hi")], "record_id long, u_idx int, speaker_id string, start_us long, end_us long, text string")
    none = spark.createDataFrame([], "record_id long, name string, lang string, duration_s double")
    report = exports.text_reports(turns, none).first().report
    assert report.endswith("[00:00.00 - 00:60.00] A:\n  \n\n[01:00.00 - 01:01.01] B:\n  hi\n\n")
    assert report.startswith("Dosya: \nTespit Edilen Dil: \nKonuşmacı Sayısı: 2 (A, B)\nToplam Süre: 0.00 saniye\n====")


def test_words_of_records_are_dealt_to_many_tasks(spark):
    words = spark.range(4000).selectExpr("id DIV 10 AS record_id", "id % 10 AS w_idx", "'w' AS word", "id % 10 * 400000 AS start_us", "id % 10 * 400000 + 300000 AS end_us")
    segments = spark.range(400).selectExpr("id AS record_id", "0L AS seg_idx", "'A' AS speaker_id", "0L AS start_us", "9000000L AS end_us")
    per_task = turns.utterances(turns.attribute(words, segments, by_record=True)).groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in per_task.collect()]
    # Records are few and small, and still not merged into a task or two a core.
    assert sum(sizes) == 400 and max(sizes) < 30


def test_alike_pairs_across_blocks(spark):
    rng = random.Random(3)
    rows = [(i % 2, i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(90)]
    rows += [(0, 90, [0.0] * 3), (0, 91, None), (0, 92, [1.0, None, 0.0]), (1, 93, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "record_id long, vec_id long, embedding array<float>")
    b = df.select("record_id", F.col("vec_id").alias("vec_b"), F.col("embedding").alias("eb"))
    plain = df.join(b, "record_id").where("vec_id < vec_b").withColumn("cos", vectors.cosine("embedding", "eb")).where("cos >= 0.3")
    want = sorted((r.record_id, r.vec_id, r.vec_b, r.cos) for r in plain.collect())
    for block in (7, 1000):
        found = vectors.alike_pairs(df, 0.3, block)
        assert sorted(tuple(r) for r in found.collect()) == want
    # Vectors meet in cells of two blocks, not in a join of a record with itself.
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
