"""Confidence, decisions, distributions, comparisons, files: against the rules written out."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from speechlake.functions import text
from speechlake.operators import evaluation, reports


def test_confidence_of_utterances(spark):
    words = [
        (1, 0, "Hi ", "A", 0, 1, 0.2, -0.1), (1, 1, " ", "A", 1, 2, None, None), (1, 2, "you", "A", 2, 3, 0.6, -0.2),
        (1, 3, "no", "B", 3, 4, 0.59, -1.0), (1, 4, " ", "C", 5, 6, 0.9, -1.0), (2, 0, "x", "A", 0, 1, None, None),
    ]
    df = spark.createDataFrame(words, "record_id long, w_idx long, word string, speaker_id string, start_us long, end_us long, temperature double, logprob double")
    got = {(r.record_id, r.speaker_id): (r.text, r.low_confidence, r.temperature, r.avg_logprob, r.end_us) for r in reports.confident_utterances(df).collect()}
    assert got == {(1, "A"): ("Hi you", True, 0.6, -0.1, 3), (1, "B"): ("no", False, 0.59, -1.0, 4), (2, "A"): ("x", False, 0.0, 0.0, 1)}
    counts = {r.record_id: (r.uncertain_words, r.uncertain_utterances) for r in reports.confidence_counts(df, reports.confident_utterances(df)).collect()}
    assert counts == {1: (2, 1), 2: (0, 0)}


def test_distributions(spark):
    rng = random.Random(3)
    groups = {k: [rng.random() * 100 for _ in range(n)] for k, n in enumerate((1, 2, 37))}
    rows = [(k, v) for k, x in groups.items() for v in x] + [(0, None), (3, None), (1, float("nan"))]
    got = {r.k: r for r in reports.distribution(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for k, x in groups.items():
        assert got[k].n == len(x) and np.allclose([got[k]["mean"], got[k]["std"], got[k]["median"], got[k]["p95"], got[k]["max"]], [np.mean(x), np.std(x), np.median(x), np.percentile(x, 95), max(x)])
    assert got[3].n == 0 and got[3].p95 is None


def test_before_and_after(spark):
    df = spark.createDataFrame([("a", "old", 1.0, 10.0), ("a", "new", 3.0, 8.0), ("a", "new", 5.0, 8.0), ("b", "old", 2.0, 1.0), ("c", "other", 9.0, 9.0)], "file string, setting string, gap double, words double")
    got = {r.file: tuple(r)[1:] for r in reports.before_after(df, "file", "setting", ["old", "new"], ["gap", "words"]).collect()}
    assert got == {"a": (1.0, 4.0, 3.0, 10.0, 8.0, -2.0), "b": (2.0, None, None, 1.0, None, None), "c": (None,) * 6}
    one = reports.before_after(df, "file", "setting", ["old", "new"], ["gap"])
    assert one.columns == ["file", "gap_before", "gap_after", "gap_change"] and one.where("file = 'a'").first().gap_change == 3.0


def test_stages_and_cores(spark):
    stages = spark.createDataFrame([("m", 1, "stt", 2.0), ("m", 2, "stt", 3.0), ("m", 1, "vad", 1.0), ("m", 1, "else", 4.0), ("z", 1, "stt", 1.0)], "model string, file int, stage string, seconds double")
    audio = spark.createDataFrame([("m", 1, 15.0), ("m", 2, 5.0), ("z", 1, 0.0)], "model string, file int, audio_s double")
    rows = reports.stage_table(stages, audio, ["model"], ["stt", "vad", "refine"], threads=4).collect()
    assert [(r.model, r.audio_s, r.stt, r.vad, r.refine, r.total_s, r.rtf, r.k) for r in rows] == [("m", 20.0, 5.0, 1.0, 0.0, 10.0, 0.5, 2.0)]
    assert spark.range(1).select(reports.cores_needed(F.lit(3600.0), F.lit(2.0), F.lit(1800.0)).alias("c"), reports.cores_needed(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("n")).first()[:] == (4.0, None)


def test_decisions(spark):
    df = spark.createDataFrame([(1, 10.0, 90.0, 2), (2, 20.0, 90.0, 1), (3, None, 30.0, None), (4, 15.0, 60.0, 0), (5, 1.0, None, 2)], "record_id long, snr double, duration_s double, n_speakers int")
    quick = {r.record_id: (r.denoise, r.diarize) for r in reports.stages_due(df, "feedback", 15.0, 60.0).collect()}
    assert quick == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, True), 5: (True, False)}
    full = {r.record_id: (r.denoise, r.diarize) for r in reports.stages_due(df, "full", 15.0, 60.0).collect()}
    assert full == {1: (True, True), 2: (True, False), 3: (True, True), 4: (True, True), 5: (True, True)}
    assert reports.stages_due(df, "full", 15.0, 60.0, denoiser=False).where("denoise").count() == 0
    rows = {1: [("A", 87.0), ("B", 1.2)], 2: [("A", 90.0), ("B", 10.0)], 3: [("A", 900.0), ("B", 40.0)], 4: [("A", 5.0)], 5: [("A", 95.0), ("B", 2.9)], 6: [("A", 0.0), ("B", 0.0)], 7: [("A", 50.0), ("B", 49.0), ("C", 1.0)]}
    segments = spark.createDataFrame([(k, s, 0, int(d * 1e6)) for k, x in rows.items() for s, d in x], "record_id long, speaker_id string, start_us long, end_us long")
    assert {r.record_id for r in reports.collapsed(segments).where("collapsed").collect()} == {1, 3, 5}
    assert {r.record_id for r in reports.collapsed(segments).collect()} == set(rows)


def test_single_speakers(spark):
    df = spark.createDataFrame([(1, 12.5), (2, 0.0), (3, None)], "record_id long, duration_s double")
    assert [(r.speaker_id, r.start_us, r.end_us) for r in reports.single_speaker(df).orderBy("record_id").collect()] == [("SPEAKER_00", 0, 12_500_000), ("SPEAKER_00", 0, 10**9), ("SPEAKER_00", 0, 10**9)]


def test_files(spark):
    files = spark.createDataFrame([(p,) for p in ("d/a.wav", "d/a.rttm", "e/a.wav", "d/b.WAV", "d/b.rttm", "d/c.x.wav", "d/c.x.rttm", "wav", "d/.wav", "d/a.txt", None)], "path string")
    got = sorted((r.stem, r.wav, r.rttm) for r in reports.paired_files(files).collect())
    assert got == [("a", "d/a.wav", "d/a.rttm"), ("b", "d/b.WAV", "d/b.rttm"), ("c.x", "d/c.x.wav", "d/c.x.rttm")]
    wanted = spark.createDataFrame([("a.wav",), ("none.wav",), ("b.WAV",)], "name string")
    found = {r.name: r.path for r in reports.first_found(wanted, files, ["x", "e", "d"]).collect()}
    assert found == {"a.wav": "e/a.wav", "none.wav": None, "b.WAV": "d/b.WAV"}
    assert sorted(r.path for r in reports.resumed(files.where("path IS NOT NULL"), files.where("path LIKE 'd/%'"), "path").collect()) == ["e/a.wav", "wav"]
    names = {"eval_sample_07_2spk": "tuning", "eval_sample_12_3spk": "test", "3_eval_sample_8": "test", "rec5b2": "tuning", "none": "test"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", reports.split_of(F.col("n")).alias("s")).collect()} == names
    sets = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "c"]), ([], [])], "have array<string>, need array<string>")
    assert [r.x for r in sets.select(reports.has_all(F.col("have"), F.col("need")).alias("x")).collect()] == [True, False, True]


def test_batch_summaries(spark):
    df = spark.createDataFrame([("b.wav", 10.004, ["S1", "S0"], 4, 2.5, "tr"), ("a.wav", 0.0, [], 0, 1.0, None)], "name string, duration_s double, speakers array<string>, n_utterances int, seconds double, language string")
    row = reports.batch_summary(df).first()
    lines = [json.loads(x) for x in row.results]
    assert row.total_files == 2 and [x["file_name"] for x in lines] == ["a.wav", "b.wav"]
    assert lines[1] == {"file_name": "b.wav", "duration_sec": 10.0, "speaker_count": 2, "speakers": ["S0", "S1"], "utterance_count": 4, "execution_time_sec": 2.5, "rtf": 0.25, "language": "tr"}
    assert lines[0]["rtf"] == 0.0
    assert reports.batch_summary(df.limit(0)).first().total_files == 0


RUN = "file string, der double, missed double, false_alarm double, confusion double, expected int, found int, seconds double, rss_mb double, load_s double"


def test_comparison_of_two_runs(spark):
    rng = random.Random(5)
    rows = lambda shift: [(f"f{i}", 30 + rng.random() * 20 + shift, rng.random(), rng.random(), rng.random(), 2, rng.choice([2, 3]), rng.random() * 9, 500.0 + i, 1.5) for i in range(12)]
    old, new = rows(0), rows(-15) + [("more", 1.0, 1.0, 1.0, 1.0, 2, 2, 1.0, 1.0, 2.25)]
    got = [r.line for r in evaluation.comparison_lines(spark.createDataFrame(old, RUN), spark.createDataFrame(new, RUN), "first", "second").orderBy("n").collect()]
    assert got[0] == "| Metrik / Performans Göstergesi | FIRST (Eski) | SECOND (Yeni) | Fark / Değişim |" and got[1].count(":---:") == 3 and len(got) == 12
    assert got[2] == "| **Model Yükleme Süresi (`load_time_sec`)** | `1.500s` | `2.250s` | `+0.750s` |"
    a, b = np.array([r[1] for r in old]), np.array([r[1] for r in new])
    assert got[3] == f"| **Ortalama DER ± Std** | `%{a.mean():.2f} ± %{a.std():.2f}` | `%{b.mean():.2f} ± %{b.std():.2f}` | `%{b.mean() - a.mean():+.2f}` |"
    match = lambda x: np.mean([100.0 * (r[5] == r[6]) for r in x])
    assert got[7] == f"| **Konuşmacı Sayısı Eşleşme Oranı** | `%{match(old):.2f}` | `%{match(new):.2f}` | `%{match(new) - match(old):+.2f}` |"
    p95 = lambda x: np.percentile([r[7] for r in x], 95)
    assert got[9] == f"| **P95 İşlem Süresi (P95)** | `{p95(old):.3f}s` | `{p95(new):.3f}s` | `{p95(new) - p95(old):+.3f}s` |"
    assert got[11].startswith("| **Wilcoxon p-değeri** | - | `p = 0.00") and got[11].endswith("Fark Var (p < 0.05) |")
    same = [r.line for r in evaluation.comparison_lines(spark.createDataFrame(old, RUN), spark.createDataFrame(old, RUN), "a", "b").orderBy("n").collect()]
    assert same[11] == "| **Wilcoxon p-değeri** | - | `p = 1.0000` | İstatistiksel Olarak Anlamlı Fark Yok (p >= 0.05) |"


def test_paired_differences_have_a_band(spark):
    frame = lambda x: spark.createDataFrame(list(x.items()), "file string, der double")
    old, new = {"a": 1.0, "b": 2.0, "c": 3.0, "d": None, "x": 1.0}, {"a": 1.0005, "b": 1.5, "c": 3.5, "d": 1.0, "y": 1.0}
    row = evaluation.paired_summary(evaluation.paired_differences(frame(old), frame(new), "file", "der")).first()
    assert (row.n, row.improved, row.degraded, row.unchanged) == (3, 1, 1, 1)


def test_names_and_messages(spark):
    names = {None: "upload.bin", "": "upload.bin", "..": "upload.bin", "a/b\\c.wav": "c.wav", " x.wav\t": "x.wav", "d/": "upload.bin", "d/ . ": "upload.bin", "n" * 300: "n" * 255, "a\n/b": "b"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", text.safe_file_name(F.col("n")).alias("s")).collect()} == names
    told = spark.createDataFrame([("OSError", "no /var/lib/x.wav here"), ("ValueError", "C:\\Users\\me: bad"), ("E", None)], "k string, m string")
    assert [r.s for r in told.select(text.error_message(F.col("k"), F.col("m")).alias("s")).collect()] == ["OSError: no [FILE_PATH] here", "ValueError: [FILE_PATH]: bad", "E: "]
