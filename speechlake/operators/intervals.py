"""Interval operators on (record_id, speaker_id, seg_idx, start_us, end_us)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import Grid, meet, stab

MIN_OVERLAP_US = 50_000


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows in which `new` (of the row, given what stands before) is not true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def running_end(keys: list[str], order: list[str]) -> Column:
    """Largest end of the rows before."""
    return F.max("end_us").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def overlap_pairs(segments: DataFrame, least_us: int = MIN_OVERLAP_US, grid: Grid | None = None) -> DataFrame:
    """Pairs of intervals of different speakers in one record that share more than `least_us`.

    The later start of a pair lies in the earlier interval, so one look-up of starts in the cells
    of the intervals meets every pair once, and pairs that never meet are not compared.
    """
    a = segments.select("record_id", *(F.col(c).alias(n) for c, n in (("seg_idx", "seg_a"), ("speaker_id", "speaker_a"), ("start_us", "a0"), ("end_us", "a1"))))
    b = segments.select("record_id", *(F.col(c).alias(n) for c, n in (("seg_idx", "seg_b"), ("speaker_id", "speaker_b"), ("start_us", "b0"), ("end_us", "b1"))))
    # What is shorter than the least overlap can have none.
    a, b = a.where(F.col("a1") - F.col("a0") > least_us), b.where(F.col("b1") - F.col("b0") > least_us)
    met = stab(a, b, ["record_id"], "a0", "a1", "b0", grid)
    ordered = (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("seg_a") < F.col("seg_b")))
    end = F.least("a1", "b1")
    found = met.where(ordered & (F.col("speaker_a") != F.col("speaker_b")) & (end - F.col("b0") > least_us))
    return found.select("record_id", "seg_a", "seg_b", "speaker_a", "speaker_b", F.col("b0").alias("start_us"), end.alias("end_us"))


def speech_islands(segments: DataFrame) -> DataFrame:
    """(record_id, island, start_us, end_us): touching or overlapping intervals of a record merged."""
    keys, order = ["record_id"], ["start_us", "end_us", "seg_idx"]
    rows = segments.where("end_us > start_us").withColumn("before", running_end(keys, order))
    numbered = islands(rows, keys, order, F.col("start_us") > F.col("before"))
    return numbered.groupBy("record_id", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def difference(rows: DataFrame, holes: DataFrame, grid: Grid | None = None, hole_grid: Grid | None = None) -> DataFrame:
    """(record_id, island, start_us, end_us): what is left of intervals (record_id, island, start_us, end_us) outside all holes of their record.

    (record_id, island) names an interval; holes (record_id, start_us, end_us) may overlap, and empty ones take
    nothing away. What is left before a hole starts where the holes before it have ended; what is left at the end, where all have.
    """
    a = rows.select("record_id", "island", F.col("start_us").alias("s0"), F.col("end_us").alias("s1")).where("s1 > s0")
    b = holes.select("record_id", F.col("start_us").alias("h0"), F.col("end_us").alias("h1")).where("h1 > h0")
    met = meet(a, b, ["record_id"], ("s0", "s1"), ("h0", "h1"), grid, hole_grid, "left")
    shares = (F.col("h1") > F.col("s0")) & (F.col("h0") < F.col("s1"))
    # An interval's row without a hole is one hole more, at its end: it has what is left there before it.
    cuts = met.where(F.col("h0").isNull() | shares).select("record_id", "island", "s0", *(F.coalesce(c, "s1").alias(c) for c in ("h0", "h1")))
    before = Window.partitionBy("record_id", "island").orderBy("h0", "h1").rowsBetween(Window.unboundedPreceding, -1)
    left = cuts.withColumn("from", F.greatest(F.max("h1").over(before), F.col("s0")))
    return left.where("h0 > `from`").select("record_id", "island", F.col("from").alias("start_us"), F.col("h0").alias("end_us"))
