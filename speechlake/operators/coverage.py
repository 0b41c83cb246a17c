"""What speech the words cover, which speakers are small, how far intervals lie apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import fixtures
from . import intervals
from .cells import TURNS, WORDS, Grid, latest, nearest

GAP_US, PAD_US = 2_000_000, 600_000


def untranscribed_gaps(islands: DataFrame, words: DataFrame) -> DataFrame:
    """(record_id, start_us, end_us): parts of speech islands before, between and after their words; an island without words is one."""
    return intervals.difference(islands, words, TURNS, WORDS).select("record_id", "start_us", "end_us")


def coverage(islands: DataFrame, gaps: DataFrame, least_us: int = GAP_US) -> DataFrame:
    """Speech, gaps and the covered share of each record, not below 0; gaps of `least_us` and more are counted apart."""
    speech = islands.groupBy("record_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"))
    size = F.col("end_us") - F.col("start_us")
    lost = gaps.groupBy("record_id").agg(F.sum(size).alias("gap_us"), F.count_if(size >= least_us).alias("n_long"), F.coalesce(F.sum(F.when(size >= least_us, size)), F.lit(0)).alias("long_us"))
    full = speech.join(lost, "record_id", "left").na.fill(0, ["gap_us", "n_long", "long_us"])
    share = F.greatest(F.lit(0.0), F.try_divide((F.col("speech_us") - F.col("gap_us")) * F.lit(100.0), F.col("speech_us")))
    return full.select("record_id", "speech_us", "gap_us", "n_long", "long_us", F.round(share, 2).alias("covered_pct"))


def overlap_sweep(segments: DataFrame) -> DataFrame:
    """(record_id, overlap_us): time in which two intervals and more are open, counted once."""
    ends = segments.where("end_us > start_us").select("record_id", F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("record_id", F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("record_id").orderBy("t")
    open_ = steps.withColumn("open", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("t").over(w))
    return open_.groupBy("record_id").agg(F.sum(F.when(F.col("open") > 1, F.col("until") - F.col("t")).otherwise(0)).alias("overlap_us"))


def vad_filter(words: DataFrame, speech: DataFrame, pad_us: int = PAD_US, block_us: int = 1 << 32) -> DataFrame:
    """Words whose middle lies in a padded speech interval; records without any interval keep all words.

    Doubled times keep the middle whole. A word lies in an interval if the latest end of those that have begun
    is not before it: one running maximum over the words and the starts, with a mark before all times in records
    that have intervals. Nothing is joined but the blocks' maxima.
    """
    never = F.lit(-(2**63))
    lo, hi = 2 * (F.col("start_us") - pad_us), 2 * (F.col("end_us") + pad_us)
    begins = F.struct(F.coalesce(lo, never).alias("at"), F.coalesce(hi, never).alias("until"))
    marks = F.array(F.struct(never.alias("at"), never.alias("until")), F.when(lo <= hi, begins))
    spoken = speech.where("record_id IS NOT NULL").select("record_id", F.inline(F.array_compact(marks)))
    twice = F.col("start_us") + F.col("end_us")
    asked = words.withColumns({"_at": F.coalesce(twice, never), "_until": F.lit(None).cast("long")})
    rows = asked.unionByName(spoken.select("record_id", F.col("at").alias("_at"), F.col("until").alias("_until")), allowMissingColumns=True)
    found = latest(rows.where("record_id IS NOT NULL"), ["record_id"], "_at", "_until", block_us, "_last").where("_until IS NULL")
    kept = found.where(F.col("_last").isNull() | ((F.col("_at") > never) & (F.col("_last") >= F.col("_at")))).select(words.columns)
    return kept.unionByName(words.where("record_id IS NULL"))


def small_speakers(segments: DataFrame, least_us: int = 0, share: float = 0.15) -> DataFrame:
    """(record_id, speaker_id, us, small): below `least_us` or `share` of the record's speech; where all are, the longest is not."""
    by = segments.groupBy("record_id", "speaker_id").agg(F.sum(F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))).alias("us"))
    rec = Window.partitionBy("record_id")
    below = (F.col("us") < least_us) | (F.coalesce(F.try_divide(F.col("us"), F.sum("us").over(rec)), F.lit(0.0)) < share)
    ranked = by.withColumn("below", below).withColumn("rank", F.row_number().over(rec.orderBy(F.desc("us"), "speaker_id")))
    kept = ranked.withColumn("all", F.min(F.col("below").cast("int")).over(rec) == 1)
    return kept.select("record_id", "speaker_id", "us", (F.col("below") & ~(F.col("all") & (F.col("rank") == 1))).alias("small"))


def nearest_major(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(record_id, seg_idx, near_idx, distance_us): for intervals of small speakers the nearest one of another.

    One that overlaps comes before one that touches or that lies around or within as a mere point; of several
    alike the first in order of seg_idx.
    """
    told = segments.join(speakers.select("record_id", "speaker_id", "small"), ["record_id", "speaker_id"]).select("record_id", F.col("seg_idx").alias("idx"), F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), "small")
    found = nearest(told, F.col("small"), ["record_id"], Grid.of(segments, "start_us", "end_us"), empty_shares=False)
    return found.select("record_id", F.col("idx").alias("seg_idx"), F.col("near").alias("near_idx"), "distance_us")


def keep_speakers(segments: DataFrame, least_us: int) -> DataFrame:
    """Intervals of `least_us` and more; a speaker that would vanish keeps its longest."""
    size = F.col("end_us") - F.col("start_us")
    own = Window.partitionBy("record_id", "speaker_id")
    told = segments.withColumn("any", F.max((size >= least_us).cast("int")).over(own)).withColumn("rank", F.row_number().over(own.orderBy(size.desc(), "start_us", "seg_idx")))
    return told.where((size >= least_us) | ((F.col("any") == 0) & (F.col("rank") == 1))).drop("any", "rank")


def _cv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Speech islands of the turns, stretched by 3 s after their end, and the first three of every nine words: the derived inputs of FIXTURES.md."""
    s = fixtures.segments_cv(spark, sf_dir).withColumn("end_us", F.col("end_us") + 3_000_000)
    return intervals.speech_islands(s), fixtures.words_cv(spark, sf_dir).where("w_idx % 9 < 3")


def q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return untranscribed_gaps(*_cv(spark, sf_dir)).where(F.col("end_us") - F.col("start_us") >= GAP_US)


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech, words = _cv(spark, sf_dir)
    return coverage(speech, untranscribed_gaps(speech, words))


def q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_sweep(fixtures.segments_ev(spark, sf_dir))


def q_vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.segments_cv(spark, sf_dir).where("seg_idx % 3 = 1 AND record_id % 5 <> 0")
    return vad_filter(fixtures.words_cv(spark, sf_dir), s).select("record_id", "w_idx")


def q_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_speakers(fixtures.segments_ev(spark, sf_dir))


def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.segments_ev(spark, sf_dir)
    return nearest_major(s, small_speakers(s))


def q_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_speakers(fixtures.segments_ev(spark, sf_dir), 20_000_000_000).select("record_id", "seg_idx")


QUERIES = {"untranscribed_gaps": q_gaps, "speech_coverage": q_coverage, "overlap_sweep_exact": q_sweep, "vad_filter": q_vad, "small_speakers": q_small, "nearest_major": q_nearest, "min_duration_keep": q_keep}
