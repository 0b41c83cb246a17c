"""Made-up dialogues by their own measure of overlap; WAV files as a data source, by what is read of them."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.operators import coverage
from speechlake.sources import dialogues, wav


@pytest.mark.parametrize("target", [0.0, 0.08, 0.15])
def test_overlap_of_dialogues_is_the_target(spark, target):
    df = spark.range(1, 301).withColumnRenamed("id", "record_id")
    made = dialogues.dialogues(df, overlap=target).persist()
    length = made.groupBy("record_id").agg(F.max("end_us").alias("us"))
    shared = coverage.overlap_sweep(made).join(length, "record_id").collect()
    assert abs(sum(r.overlap_us for r in shared) / sum(r.us for r in shared) - target) <= 0.01 * max(target, 0.01)
    rows = sorted(made.collect(), key=lambda r: (r.record_id, r.seg_idx))
    for a, b in zip(rows, rows[1:]):
        if a.record_id == b.record_id:
            assert a.speaker_id != b.speaker_id and a.start_us < b.start_us and b.seg_idx == a.seg_idx + 1
    voices = {}
    for r in rows:
        voices.setdefault(r.record_id, set()).add(r.speaker_id)
    assert len(voices) == 300 and all(v <= {"SPEAKER_00", "SPEAKER_01", *(["SPEAKER_02"] if k % 3 == 0 else [])} for k, v in voices.items())
    assert any(len(v) == 3 for v in voices.values())


def test_dialogues_that_the_first_turns_do_not_fill(spark, monkeypatch):
    df = spark.range(60).withColumnRenamed("id", "record_id")
    whole = {tuple(r) for r in dialogues.dialogues(df).collect()}
    monkeypatch.setattr(dialogues, "FIRST", 3)
    assert {tuple(r) for r in dialogues.dialogues(df).collect()} == whole and max(r[1] for r in whole) > 3


def test_dialogues_do_not_depend_on_partitions_or_neighbours(spark):
    df = spark.range(1, 40).withColumnRenamed("id", "record_id")
    whole = {tuple(r) for r in dialogues.dialogues(df.repartition(7)).collect()}
    assert whole == {tuple(r) for r in dialogues.dialogues(df.coalesce(1)).collect()}
    part = {tuple(r) for r in dialogues.dialogues(df.where("record_id < 5").unionByName(df.where("record_id < 5")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("record_id")))).collect()}
    assert part == {r for r in whole if r[0] < 5}
    assert {tuple(r) for r in dialogues.dialogues(df, seed=1).collect()} != whole
    assert dialogues.dialogues(df.limit(0)).count() == 0


def pcm(x, bits, channels=1, rate=8_000):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(bits // 8), f.setframerate(rate)
        f.writeframes(b"".join(int(v).to_bytes(bits // 8, "little", signed=bits > 8) for v in x))
    return raw.getvalue()


def chunked(fmt, data, before=b""):
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    put("a.wav", pcm([0, 255, 128], 8))
    put("b.wav", pcm([100, -100, 32_767, -32_768], 16, channels=2, rate=16_000))
    put("deep/c.wav", pcm([1 << 22, -(1 << 23)], 24))
    put("d.wav", pcm([1 << 30], 32))
    floats = np.array([0.25, -0.5], "<f4").tobytes()
    put("e.wav", chunked(struct.pack("<HHIIHH", 3, 1, 8_000, 32_000, 4, 32), floats, before=b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    put("f.wav", chunked(struct.pack("<HHIIHHHHIH14x", 0xFFFE, 1, 8_000, 16_000, 2, 16, 22, 16, 4, 1), struct.pack("<h", 16_384)))
    put("g.wav", b"RIFF")
    put("h.wav", b"")
    put("i.wav", pcm([5] * 10, 16)[:-8])
    put("j.wav", chunked(struct.pack("<HHIIHH", 6, 1, 8_000, 8_000, 1, 8), b"\0\0"))
    put("k.wav", pcm([0] * 500_000, 16))
    put("l.txt", b"x")
    return tmp_path


def test_headers_without_samples(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in wav.read(spark, str(folder)).collect()}
    assert sorted(rows) == [f"{c}.wav" for c in "abcdefghijk"]
    assert (rows["b.wav"].rate, rows["b.wav"].channels, rows["b.wav"].bits, rows["b.wav"].frames) == (16_000, 2, 16, 2)
    assert rows["k.wav"].duration_s == 62.5 and rows["k.wav"].bytes > 1_000_000 and rows["k.wav"].bytes_read < 100
    assert rows["g.wav"].rate is None and rows["h.wav"].rate is None and rows["i.wav"].frames == 6 and rows["e.wav"].frames == 2
    assert wav.read(spark, f"file://{folder}/a.wav", "rate").columns == ["rate"]


def test_samples_where_asked_for(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in wav.read(spark, str(folder), "path", "samples", "bytes_read").collect()}
    want = {"a": [-1.0, 127 / 128, 0.0], "b": [0.0, -1 / 65_536], "c": [0.5, -1.0], "d": [0.5], "e": [0.25, -0.5], "f": [0.5], "i": [5 / 32_768] * 6}
    for name, x in want.items():
        assert got[f"{name}.wav"].samples == pytest.approx(x), name
    assert all(got[f"{n}.wav"].samples is None for n in "ghj") and len(got["k.wav"].samples) == 500_000 and got["k.wav"].bytes_read > 1_000_000
    assert wav.read(spark, str(folder), "samples").rdd.getNumPartitions() >= 1
    few = spark.read.format("wav").schema("path string").option("split", 2).load(str(folder))
    assert few.rdd.getNumPartitions() == 6 and few.count() == 11
