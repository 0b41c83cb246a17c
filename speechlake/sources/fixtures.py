"""Derived inputs: the driver's tables seen as recordings, words, segments, jobs and signals.

Times are BIGINT microseconds, so that interval arithmetic is exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables of the folder as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def segments_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker intervals: a record per user, a speaker per event type."""
    view(spark, sf_dir, "events")
    return spark.sql("""
        SELECT user_id AS record_id, event_type AS speaker_id, event_id AS seg_idx,
               unix_micros(CAST(ts AS TIMESTAMP)) AS start_us,
               unix_micros(CAST(ts AS TIMESTAMP)) + CAST(round(value * 600e6) AS BIGINT) AS end_us
        FROM events""")


#: Least number of parts that records are dealt to; a given number is not merged to a task or two a core.
PARTS = 96
#: Words of a turn's text, and how many.
WORDS = "filter(split({text}, '[ \\\\t\\\\r\\\\n]+'), w -> w <> '')"
START_US = "400000L * {at} + 2000000L * ({at} DIV 37)"


def turns_cv(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(record_id, turn, said, base): the rows of a turn, with role, n (words) and `columns`, and how many words the turns before have.

    Turns are exchanged once, by record, and words are numbered by their turns' counts.
    """
    view(spark, sf_dir, "conversations")
    kept = "".join(f", {c}" for c in columns)
    dealt = spark.sql(f"SELECT conv_id AS record_id, turn, role, coalesce(size({WORDS.format(text='text')}), 0) AS n{kept} FROM conversations").repartition(max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))), "record_id")
    dealt.createOrReplaceTempView("dealt_cv")
    return spark.sql(f"""
        SELECT record_id, turn, said, CAST(sum(n) OVER (PARTITION BY record_id ORDER BY turn) - n AS BIGINT) AS base
        FROM (SELECT record_id, turn, collect_list(struct(role, n{kept})) AS said, sum(n) AS n FROM dealt_cv GROUP BY record_id, turn) x""")


def words_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words: a record per conversation, a word every 0.4 s and a pause after each 37."""
    turns_cv(spark, sf_dir, "text").createOrReplaceTempView("turns_cv")
    # Rows of one turn take turns, word by word.
    return spark.sql(f"""
        WITH rows AS (
            SELECT record_id, turn, base, transform(said, s -> s.n) AS ns, row, one.role, one.text FROM turns_cv LATERAL VIEW posexplode(said) r AS row, one
        ), numbered AS (
            SELECT record_id, turn, role, word, base + CASE WHEN size(ns) = 1 THEN pos ELSE
                   aggregate(ns, 0, (s, n) -> s + least(n, pos)) + size(filter(slice(ns, 1, row), n -> n > pos)) END AS w_idx
            FROM rows LATERAL VIEW posexplode({WORDS.format(text='text')}) t AS pos, word
        )
        SELECT record_id, w_idx, turn, role, word, {START_US.format(at='w_idx')} AS start_us, {START_US.format(at='w_idx')} + 300000L AS end_us
        FROM numbered""")


def segments_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speaker interval per turn that has words, shifted against them: from its first word's start to its last one's end."""
    turns_cv(spark, sf_dir).createOrReplaceTempView("turns_cv")
    return spark.sql(f"""
        SELECT record_id, turn AS seg_idx, array_min(transform(filter(said, s -> s.n > 0), s -> s.role)) AS speaker_id,
               {START_US.format(at='base')} + 300000L * (turn % 5 - 2) AS start_us, {START_US.format(at='last')} + 300000L + 300000L * (turn % 5 - 2) AS end_us
        FROM (SELECT *, base + aggregate(said, 0, (s, x) -> s + x.n) - 1 AS last FROM turns_cv) x WHERE last >= base""")
