"""Readers of speaker annotations: RTTM lines, label tracks, counts and benchmark files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    stem = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^.*/", ""), r"\.[^.]*$", "")
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("line"), "value", stem.alias("stem"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(uri, speaker_id, start_us, end_us) of SPEAKER lines with eight fields and more; blank, # and malformed lines are left out."""
    f = F.split("line", r"\s+")
    rows = _lines(spark, path).where("line <> '' AND NOT startswith(line, '#')").select(f.alias("f")).where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    start, size = F.col("f")[3].try_cast("double"), F.col("f")[4].try_cast("double")
    us = lambda x: F.round(x * 1e6).cast("long")
    return rows.where(start.isNotNull() & size.isNotNull()).select(F.col("f")[1].alias("uri"), F.col("f")[7].alias("speaker_id"), us(start).alias("start_us"), us(start + size).alias("end_us"))


def read_labels(spark: SparkSession, path: str, point_us: int = 500_000) -> DataFrame:
    """(uri, speaker_id, start_us, end_us) of tab-separated tracks: start, end, label, or start, label for a point."""
    rows = _lines(spark, path).select("stem", F.split(F.trim("value"), "\t").alias("f")).where("size(f) IN (2, 3)")
    start = F.col("f")[0].try_cast("double")
    end = F.when(F.size("f") == 3, F.col("f")[1].try_cast("double")).otherwise(start + point_us / 1e6)
    us = lambda x: F.round(x * 1e6).cast("long")
    return rows.where(start.isNotNull() & end.isNotNull()).select(F.col("stem").alias("uri"), F.element_at("f", -1).alias("speaker_id"), us(start).alias("start_us"), us(end).alias("end_us"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
