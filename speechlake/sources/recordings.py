"""Recordings as binary files: scan, type check, decoding of WAV to 16 kHz mono."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workers

MOST_BYTES, RATE = 100 * 1024 * 1024, 16_000
SAMPLES = "path string, rate int, channels int, duration_s double, samples array<float>"


def scan(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """binaryFile rows of audio files that are neither empty nor above the limit; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,mp3,flac,m4a,ogg}").option("recursiveFileLookup", "true").load(folder)
    return files.where((F.col("length") > 0) & (F.col("length") <= most_bytes))


def kind(content: Column) -> Column:
    """wav, mp3, flac, ogg or m4a by the first bytes; null for anything else."""
    at = lambda start, n: F.hex(F.substring(content, start, n))
    sync = at(1, 2)
    return (
        F.when((at(1, 4) == "52494646") & (at(9, 4) == "57415645"), "wav")
        .when((at(1, 3) == "494433") | sync.isin("FFFB", "FFF3", "FFF2", "FFFA"), "mp3")
        .when(at(1, 4) == "664C6143", "flac")
        .when(at(1, 4) == "4F676753", "ogg")
        .when(at(5, 4) == "66747970", "m4a")
    )


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation at the new rate's instants."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    n = int(round(len(x) * to / rate))
    return np.interp(np.arange(n) * (rate / to), np.arange(len(x)), x).astype(np.float32)


def decode_wav(content: bytes) -> tuple[int, int, float, np.ndarray]:
    """(rate, channels, seconds, mono samples from -1 to 1) of 8, 16 and 32-bit PCM."""
    with wave.open(io.BytesIO(content)) as f:
        rate, channels, width, raw = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
    if width not in (1, 2, 4):
        raise ValueError(f"unsupported sample width {width}")
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = ((x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)).reshape(-1, channels).mean(1)
    return rate, channels, len(x) / rate, x


def decode(files: DataFrame, rate: int = RATE) -> DataFrame:
    """SAMPLES of WAV files at `rate`; one that cannot be decoded keeps its path, with nulls."""
    workers.ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    own, channels, seconds, x = decode_wav(content)
                    row = (path, own, channels, seconds, resample(x, own, rate))
                except (wave.Error, EOFError, ValueError):
                    row = (path, None, None, None, None)
                yield pd.DataFrame([row], columns=["path", "rate", "channels", "duration_s", "samples"])

    return files.select("path", "content").mapInPandas(run, SAMPLES)
