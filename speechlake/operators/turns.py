"""From words and speaker intervals to utterances: attribution, grouping, smoothing, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_punctuated, only_punctuation
from .intervals import islands

UNKNOWN = "SPEAKER_UNKNOWN"
#: Least number of parts that records are dealt to.
PARTS = 96
SILENCE_US, SHORT_US, BIND_GAP_US, SANDWICH_US = 1_500_000, 1_000_000, 300_000, 800_000


def attribute(words: DataFrame, segments: DataFrame, by_record: bool = False, block_us: int = 1 << 25) -> DataFrame:
    """Adds speaker_id to words: the first interval that holds the word's middle, else the one it shares most with, else unknown.

    Both sides are filed in the blocks of time they touch, mostly one a word, and a pair is met in the first
    block of both. by_record brings a record's words together at once, for windows over the record.
    """
    blocks = lambda lo, hi: F.sequence(F.floor(F.col(lo) / block_us), F.floor(F.col(hi) / block_us))
    s = segments.where("start_us <= end_us").select("record_id", "seg_idx", F.col("speaker_id").alias("found"), F.col("start_us").alias("s0"), F.col("end_us").alias("s1"))
    s = s.select(F.col("record_id").alias("_record"), "seg_idx", "found", "s0", "s1", F.explode(blocks("s0", "s1")).alias("_filed"))
    nowhere = F.array(F.lit(0).cast("long"))
    asked = words.withColumn("_block", F.explode(F.when(F.col("start_us") <= F.col("end_us"), blocks("start_us", "end_us")).otherwise(nowhere)))
    shared = F.least("end_us", "s1") - F.greatest("start_us", "s0")
    middle = F.col("start_us") + F.col("end_us")
    holds = (F.col("s0") * 2 <= middle) & (middle <= F.col("s1") * 2)
    meets = (F.col("start_us") <= F.col("end_us")) & ((shared > 0) | holds) & (F.col("_block") == F.floor(F.greatest("start_us", "s0") / block_us))
    met = asked.join(s, (F.col("record_id") == F.col("_record")) & (F.col("_block") == F.col("_filed")) & meets, "left")
    if by_record:
        # A given number is not merged to a task or two a core, so that a task's words grow with the table by the share of one of many.
        met = met.repartition(max(PARTS, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "record_id")
    best = F.min_by("found", F.when(F.col("s0").isNotNull(), F.struct(~holds, F.when(holds, 0).otherwise(-shared), "seg_idx")))
    others = [F.first(c).alias(c) for c in words.columns if c not in ("record_id", "w_idx")]
    told = met.groupBy("record_id", "w_idx").agg(*others, best.alias("found"))
    return told.select(*words.columns, F.coalesce("found", F.lit(UNKNOWN)).alias("speaker_id"))


def utterances(words: DataFrame, silence_us: int = SILENCE_US, more: list[Column] = ()) -> DataFrame:
    """Groups attributed words: a new utterance where the speaker changes or more than `silence_us` pass; `more` are further aggregates."""
    w = Window.partitionBy("record_id").orderBy("w_idx")
    new = (F.col("speaker_id") != F.lag("speaker_id").over(w)) | (F.col("start_us") - F.lag("end_us").over(w) > silence_us)
    grouped = islands(words.withColumn("new", new), ["record_id"], ["w_idx"], F.col("new"), "u_idx").groupBy("record_id", "u_idx", "speaker_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_idx", "word"))), lambda x: x.word), " ")
    return grouped.agg(F.min("start_us").alias("start_us"), F.max_by("end_us", "w_idx").alias("end_us"), F.count("*").alias("n_words"), text.alias("text"), *more)


def bind_short(turns: DataFrame) -> DataFrame:
    """Short turns after an unpunctuated one, with little gap, go to the speaker before; this cascades."""
    w = Window.partitionBy("record_id").orderBy("u_idx")
    bound = (F.col("end_us") - F.col("start_us") < SHORT_US) & (F.col("start_us") - F.lag("end_us").over(w) < BIND_GAP_US) & ~F.lag(ends_punctuated(F.col("text"))).over(w)
    own = turns.withColumn("bound", F.coalesce(bound, F.lit(False)))
    return own.withColumn("speaker_id", F.last(F.when(~F.col("bound"), F.col("speaker_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("bound")


def relabel(turns: DataFrame) -> DataFrame:
    """Speakers are named by first appearance, SPEAKER_00 on; the unknown one keeps its name."""
    first = Window.partitionBy("record_id", "speaker_id")
    rank = Window.partitionBy("record_id").orderBy("known", "first")
    named = turns.withColumn("first", F.min("u_idx").over(first)).withColumn("known", F.when(F.col("speaker_id") == UNKNOWN, 1).otherwise(0))
    label = F.format_string("SPEAKER_%02d", F.dense_rank().over(rank) - 1)
    return named.withColumn("label", F.when(F.col("known") == 1, F.col("speaker_id")).otherwise(label)).drop("first", "known")


def sandwich(segments: DataFrame) -> DataFrame:
    """A-B-A where B is short: B becomes A, judged on the original labels."""
    w = Window.partitionBy("record_id").orderBy("start_us", "seg_idx")
    before, after = F.lag("speaker_id").over(w), F.lead("speaker_id").over(w)
    absorbed = (before == after) & (before != F.col("speaker_id")) & (F.col("end_us") - F.col("start_us") < SANDWICH_US)
    return segments.withColumn("smoothed", F.when(absorbed, before).otherwise(F.col("speaker_id")))


def merge_adjacent(segments: DataFrame, tolerance_us: int = 50_000) -> DataFrame:
    """Runs of one speaker with gaps of at most `tolerance_us` become one interval that ends at the latest end."""
    order = ["start_us", "seg_idx"]
    w = Window.partitionBy("record_id").orderBy(*order)
    runs = islands(segments.withColumn("new", F.col("speaker_id") != F.lag("speaker_id").over(w)), ["record_id"], order, F.col("new"), "run")
    end = F.max("end_us").over(Window.partitionBy("record_id", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    cut = islands(runs.withColumn("before", end), ["record_id", "run"], order, F.col("start_us") > F.col("before") + tolerance_us)
    return cut.groupBy("record_id", "run", "island", "speaker_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_merged")).drop("run", "island")


def smooth_words(words: DataFrame) -> DataFrame:
    """A single word between two of one other speaker goes to that speaker, judged on the original labels."""
    w = Window.partitionBy("record_id").orderBy("w_idx")
    before, after = F.lag("speaker_id").over(w), F.lead("speaker_id").over(w)
    return words.withColumn("speaker_id", F.when((before == after) & (before != F.col("speaker_id")), before).otherwise(F.col("speaker_id")))


def absorb_punctuation(turns: DataFrame) -> DataFrame:
    """A turn of punctuation alone goes to the speaker before, else to the one after."""
    w = Window.partitionBy("record_id").orderBy("u_idx")
    return turns.withColumn("speaker_id", F.when(only_punctuation(F.col("text")), F.coalesce(F.lag("speaker_id").over(w), F.lead("speaker_id").over(w), "speaker_id")).otherwise(F.col("speaker_id")))


def merge_turns(turns: DataFrame, silence_us: int = SILENCE_US, clause_us: int = SILENCE_US) -> DataFrame:
    """Neighbouring turns of one speaker with text become one: after at most `silence_us`, or at most `clause_us` where the first has no closing punctuation."""
    w = Window.partitionBy("record_id").orderBy("u_idx")
    gap, said = F.col("start_us") - F.lag("end_us").over(w), F.trim("text") != ""
    joins = (F.col("speaker_id") == F.lag("speaker_id").over(w)) & said & F.lag(said).over(w)
    joins &= (gap <= silence_us) | ((gap <= clause_us) & ~F.lag(ends_punctuated(F.col("text"))).over(w))
    runs = islands(turns.withColumn("new", ~F.coalesce(joins, F.lit(False))), ["record_id"], ["u_idx"], F.col("new"), "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u_idx", "text"))), lambda x: F.trim(x.text)), " ")
    return runs.groupBy("record_id", "run", "speaker_id").agg(F.min("start_us").alias("start_us"), F.max_by("end_us", "u_idx").alias("end_us"), F.sum("n_words").alias("n_words"), text.alias("text"))
