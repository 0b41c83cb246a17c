"""Confidence of words and utterances, decisions before costly stages, distributions, comparisons and tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures
from . import turns

#: Temperature from which a word is uncertain; the share of the largest speaker, and the seconds
#: or share of the smallest, at which a clustering has collapsed; seconds of a recording whose length is not known.
WARM, DOMINANT, LEAST_S, LEAST_SHARE, UNKNOWN_S = 0.6, 0.90, 3.0, 0.05, 1000.0
SINGLE = "SPEAKER_00"


def is_uncertain(temperature: Column) -> Column:
    """Recognised at a temperature of 0.6 or more; unknown temperatures are 0."""
    return F.coalesce(temperature, F.lit(0.0)) >= WARM


def _grouped(words: DataFrame, silence_us: int) -> DataFrame:
    """Utterances of words without blanks, with what their temperatures and logprobs say."""
    rows = words.withColumns({"temperature": F.coalesce("temperature", F.lit(0.0)), "logprob": F.coalesce("logprob", F.lit(0.0))})
    warm = is_uncertain(F.col("temperature"))
    more = [F.bool_or(warm).alias("low_confidence"), F.max("temperature").alias("temperature"), F.round(F.avg("logprob"), 2).alias("avg_logprob"), F.count_if(warm).alias("n_uncertain"), F.count("word").alias("n_said")]
    return turns.utterances(rows.withColumn("word", F.nullif(F.trim("word"), F.lit(""))), silence_us, more)


def confident_utterances(words: DataFrame, silence_us: int = turns.SILENCE_US) -> DataFrame:
    """Utterances (`turns.utterances`) of attributed words (word, temperature, logprob besides), with low_confidence if any word is uncertain,
    the highest temperature and the mean logprob to two places. Words are trimmed, blank ones say nothing, and an utterance without text is none.
    """
    return _grouped(words, silence_us).where("n_said > 0").drop("n_uncertain", "n_said")


def confidence_counts(words: DataFrame, utterances: DataFrame) -> DataFrame:
    """(record_id, uncertain_words, uncertain_utterances): of words (temperature) and utterances (low_confidence)."""
    a = words.groupBy("record_id").agg(F.count_if(is_uncertain(F.col("temperature"))).alias("uncertain_words"))
    b = utterances.groupBy("record_id").agg(F.count_if("low_confidence").alias("uncertain_utterances"))
    return a.join(b, "record_id", "full").na.fill(0, ["uncertain_words", "uncertain_utterances"])


def counted_at_once(words: DataFrame, silence_us: int = turns.SILENCE_US) -> DataFrame:
    """confidence_counts of attributed words and their own confident_utterances, in one pass over the words."""
    own = _grouped(words, silence_us).groupBy("record_id")
    return own.agg(F.sum("n_uncertain").alias("uncertain_words"), F.count_if(F.col("low_confidence") & (F.col("n_said") > 0)).alias("uncertain_utterances"))


def distribution(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, n, mean, std, median, p95, max) of a column's known values: population deviation, percentiles by linear interpolation.

    Exact percentiles hold a group's distinct values.
    """
    x = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.median(x).alias("median"), F.percentile(x, 0.95).alias("p95"), F.max(x).alias("max"))


def before_after(runs: DataFrame, key: str, setting: str, values: list[str], measures: list[str]) -> DataFrame:
    """A row a key with each measure under the two settings (measure_before, measure_after) and its change; a key seen under one setting alone has nulls.

    Of several runs under one setting the measures are averaged.
    """
    before, after = values
    wide = runs.groupBy(key).pivot(setting, values).agg(*(F.avg(m).alias(m) for m in measures))
    name = (lambda v, m: f"{v}_{m}") if len(measures) > 1 else (lambda v, m: v)
    out = [F.col(key)]
    for m in measures:
        b, a = F.col(f"`{name(before, m)}`"), F.col(f"`{name(after, m)}`")
        out += [b.alias(f"{m}_before"), a.alias(f"{m}_after"), (a - b).alias(f"{m}_change")]
    return wide.select(*out)


def stage_table(stages: DataFrame, recordings: DataFrame, keys: list[str], names: list[str], threads: int) -> DataFrame:
    """(keys, audio_s, a column a stage, total_s, rtf, k) of stages (keys, file, stage, seconds) and recordings (keys, file, audio_s).

    k is the core-seconds spent on a second of audio. Runs without audio are left out; stages not named count in the total alone.
    """
    audio = recordings.groupBy(*keys).agg(F.sum("audio_s").alias("audio_s")).where("audio_s > 0")
    each = [F.coalesce(F.sum(F.when(F.col("stage") == n, F.col("seconds"))), F.lit(0.0)).alias(n) for n in names]
    took = stages.groupBy(*keys).agg(*each, F.sum("seconds").alias("total_s"))
    return audio.join(took, keys).withColumn("rtf", F.col("total_s") / F.col("audio_s")).withColumn("k", F.col("total_s") * threads / F.col("audio_s"))


def cores_needed(audio_s: Column, k: Column, target_s: Column) -> Column:
    """Cores that bring so much audio through in the target time; null where that is 0."""
    return F.try_divide(audio_s * k, target_s)


def stages_due(recordings: DataFrame, profile: str, least_db: float, least_s: float, denoiser: bool = True) -> DataFrame:
    """Adds denoise and diarize to recordings (snr, duration_s, n_speakers): which stages run.

    Where only feedback is wanted, noise is removed below `least_db` (or where it isn't known), and recordings
    below `least_s` aren't diarized; those of one speaker never are.
    """
    quick = profile == "feedback"
    noisy = F.coalesce(F.col("snr") < least_db, F.lit(True)) if quick else F.lit(True)
    single = F.coalesce(F.col("n_speakers") == 1, F.lit(False))
    short = F.coalesce(F.col("duration_s"), F.lit(0.0)) < least_s if quick else F.lit(False)
    return recordings.withColumns({"denoise": noisy & F.lit(denoiser), "diarize": ~single & ~short})


def collapsed(segments: DataFrame) -> DataFrame:
    """(record_id, n_speakers, dominant, collapsed): one speaker of several has 90 % of the time while another has below 3 s or 5 %."""
    by = segments.groupBy("record_id", "speaker_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    own = by.groupBy("record_id").agg(F.count("*").alias("n_speakers"), F.max("us").alias("most"), F.min("us").alias("least"), F.sum("us").alias("total"))
    dominant = F.when(F.col("total") > 0, F.col("most") / F.col("total")).otherwise(0.0)
    tiny = (F.col("least") < LEAST_S * 1e6) | (F.col("least") / F.col("total") < LEAST_SHARE)
    return own.select("record_id", "n_speakers", dominant.alias("dominant"), F.coalesce((F.col("n_speakers") > 1) & (dominant >= DOMINANT) & tiny, F.lit(False)).alias("collapsed"))


def single_speaker(recordings: DataFrame) -> DataFrame:
    """(record_id, speaker_id, start_us, end_us): recordings (record_id, duration_s) as one interval each; of unknown length, as 1000 s."""
    length = F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(UNKNOWN_S)
    return recordings.select("record_id", F.lit(SINGLE).alias("speaker_id"), F.lit(0).cast("long").alias("start_us"), F.round(length * 1e6).cast("long").alias("end_us"))


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def paired_files(files: DataFrame, first: str = "wav", second: str = "rttm") -> DataFrame:
    """(folder, stem, first, second) of files (path): those of one folder and name with both extensions."""
    told = files.select("path", F.regexp_extract("path", r"^(.*?)[^/\\]*$", 1).alias("folder"), stem(F.col("path")).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1)).alias("kind"))
    by = told.where(F.col("kind").isin(first, second)).groupBy("folder", "stem").agg(F.min(F.when(F.col("kind") == first, F.col("path"))).alias(first), F.min(F.when(F.col("kind") == second, F.col("path"))).alias(second))
    return by.where(F.col(first).isNotNull() & F.col(second).isNotNull())


def first_found(wanted: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """wanted (name) with path: the file (path) of that name in the first of the folders that has one, else null."""
    rank = F.array_position(F.array(*map(F.lit, folders)), F.regexp_replace(F.regexp_extract("path", r"^(.*?)[^/\\]*$", 1), r"[/\\]+$", ""))
    there = files.select(F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), "path", rank.alias("rank")).where("rank > 0")
    best = there.groupBy("name").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(best, "name", "left")


def has_all(have: Column, needed: Column) -> Column:
    """Whether an array holds every value of another."""
    return F.size(F.array_except(needed, have)) == 0


def split_of(name: Column) -> Column:
    """tuning for odd, test for even numbers: the number behind eval_sample_ in a file's stem, else its first number, else 0."""
    marked = F.regexp_extract(name, r"eval_sample_([0-9]+)", 1)
    digits = F.when(marked != "", marked).otherwise(F.regexp_extract(name, r"([0-9]+)", 1))
    return F.when(F.substring(digits, -1, 1).isin("1", "3", "5", "7", "9"), "tuning").otherwise("test")


def resumed(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """files whose key is not yet among the done ones."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def batch_summary(done: DataFrame) -> DataFrame:
    """One row over finished files (name, duration_s, speakers, n_utterances, seconds, language): their number, and results as JSON lines in order of name.

    The lines are a file's summary each, so the row grows with the batch: for batches of files, not for tables of them.
    """
    line = F.struct(
        F.col("name").alias("file_name"), F.round("duration_s", 2).alias("duration_sec"), F.size("speakers").alias("speaker_count"), F.sort_array("speakers").alias("speakers"), F.col("n_utterances").alias("utterance_count"),
        F.round("seconds", 2).alias("execution_time_sec"), F.round(F.coalesce(F.try_divide("seconds", "duration_s"), F.lit(0.0)), 2).alias("rtf"), "language",
    )
    return done.agg(F.count("*").alias("total_files"), F.transform(F.array_sort(F.collect_list(F.struct("name", F.to_json(line).alias("line")))), lambda s: s.line).alias("results"))


# Queries over the derived words and intervals.


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' words with a temperature and a log-probability each from their places: the derived input of FIXTURES.md."""
    w = turns.attribute(fixtures.words_cv(spark, sf_dir), fixtures.segments_cv(spark, sf_dir), by_record=True)
    return w.withColumns({"temperature": F.pmod(F.col("w_idx") * 7 + F.col("record_id"), F.lit(97)) / 100.0, "logprob": -F.pmod(F.col("w_idx") * 3, F.lit(64)) / 64.0})


def q_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confident_utterances(_words(spark, sf_dir)).select("record_id", "u_idx", "speaker_id", "n_words", "low_confidence", "temperature", "avg_logprob", F.md5("text").alias("text_md5"))


def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_at_once(_words(spark, sf_dir))


def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distribution(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "median", "p95", "max")))


def q_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as settings, parts as files; whole numbers, so that sums are exact in any order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag IN ('A', 'R')")
    li = li.select("l_partkey", "l_returnflag", F.col("l_quantity").cast("long").alias("l_quantity"), F.round(F.col("l_discount") * 100).cast("long").alias("l_discount"))
    out = before_after(li, "l_partkey", "l_returnflag", ["A", "R"], ["l_quantity", "l_discount"])
    return out.select("l_partkey", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def q_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship months as stages of an order's run, statuses as settings."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    runs = li.select("l_linestatus", F.col("l_orderkey").alias("file"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("stage"), F.col("l_quantity").alias("seconds"))
    audio = li.groupBy("l_linestatus", F.col("l_orderkey").alias("file")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double").alias("audio_s"))
    out = stage_table(runs, audio, ["l_linestatus"], ["s1", "s2", "s3"], threads=4)
    return out.select("l_linestatus", "audio_s", "s1", "s2", "s3", "total_s", F.round("rtf", 10).alias("rtf"), F.round("k", 10).alias("k"), F.round(cores_needed(F.col("audio_s"), F.col("k"), F.lit(3600.0)), 4).alias("cores"))


def q_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.segments_cv(spark, sf_dir)
    return collapsed(s).select("record_id", "n_speakers", F.round("dominant", 6).alias("dominant"), "collapsed")


def q_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are the conversations: seconds and speakers from their turns, noise from their first word."""
    s = fixtures.segments_cv(spark, sf_dir).groupBy("record_id").agg(((F.max("end_us") - F.min("start_us")) / 1e6).alias("duration_s"), F.count_distinct("speaker_id").alias("n_speakers"))
    return stages_due(s.withColumn("snr", F.when(F.col("record_id") % 7 != 0, (F.col("record_id") % 30).cast("double"))), "feedback", 15.0, 60.0).select("record_id", "denoise", "diarize")


QUERIES = {"confident_utterances": q_confident, "confidence_counts": q_counts, "price_distribution": q_distribution, "before_after": q_before_after, "stage_table": q_stages, "collapsed_speakers": q_collapsed, "stages_due": q_due}
#: Behind the words and intervals of the conversations.
WORD_BODY = {
    "confident_utterances": """, warm AS (SELECT *, (w_idx * 7 + record_id) % 97 / 100.0::DOUBLE AS temp, -((w_idx * 3) % 64) / 64.0::DOUBLE AS lp FROM flagged),
        u AS (SELECT record_id, u_idx, speaker_id, count(*) AS n_words, bool_or(temp >= 0.6) AS low_confidence, max(temp) AS temperature, round(avg(lp), 2) AS avg_logprob, md5(string_agg(word, ' ' ORDER BY w_idx)) AS text_md5
              FROM (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY w_idx) AS u_idx FROM warm) x GROUP BY record_id, u_idx, speaker_id)
        SELECT * FROM u""",
    "confidence_counts": """, warm AS (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY w_idx) AS u_idx, (w_idx * 7 + record_id) % 97 >= 60 AS low FROM flagged)
        SELECT record_id, count(*) FILTER (low) AS uncertain_words, count(DISTINCT CASE WHEN low THEN u_idx END) AS uncertain_utterances FROM warm GROUP BY record_id""",
    "collapsed_speakers": """, own AS (SELECT record_id, speaker_id, sum(end_us - start_us) AS us FROM segments_cv GROUP BY record_id, speaker_id),
        r AS (SELECT record_id, count(*) AS n_speakers, max(us) / sum(us) AS d, min(us) AS l, sum(us) AS t FROM own GROUP BY record_id)
        SELECT record_id, n_speakers, round(d, 6) AS dominant, n_speakers > 1 AND d >= 0.9 AND (l < 3000000 OR l < 0.05 * t) AS collapsed FROM r""",
    "stages_due": """SELECT record_id, record_id % 7 = 0 OR record_id % 30 < 15 AS denoise, count(DISTINCT speaker_id) > 1 AND max(end_us) - min(start_us) >= 60000000 AS diarize FROM segments_cv GROUP BY record_id""",
}
ORACLE_SQL = {
    "price_distribution": """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(median(o_totalprice), 4) AS median,
        round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(max(o_totalprice), 4) AS max FROM orders GROUP BY o_orderpriority""",
    "before_after": """WITH a AS (SELECT l_partkey, avg(CAST(l_quantity AS BIGINT)) AS q, avg(CAST(round(l_discount * 100) AS BIGINT)) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_partkey, avg(CAST(l_quantity AS BIGINT)) AS q, avg(CAST(round(l_discount * 100) AS BIGINT)) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT coalesce(a.l_partkey, r.l_partkey) AS l_partkey, round(a.q, 6) AS l_quantity_before, round(r.q, 6) AS l_quantity_after, round(r.q - a.q, 6) AS l_quantity_change,
               round(a.d, 6) AS l_discount_before, round(r.d, 6) AS l_discount_after, round(r.d - a.d, 6) AS l_discount_change FROM a FULL JOIN r ON a.l_partkey = r.l_partkey""",
    "stage_table": """WITH s AS (SELECT l_linestatus, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS a, coalesce(sum(l_quantity) FILTER (l_linenumber = 1), 0.0) AS s1, coalesce(sum(l_quantity) FILTER (l_linenumber = 2), 0.0) AS s2,
            coalesce(sum(l_quantity) FILTER (l_linenumber = 3), 0.0) AS s3, sum(l_quantity) AS t FROM lineitem GROUP BY 1)
        SELECT l_linestatus, a AS audio_s, s1, s2, s3, t AS total_s, round(t / a, 10) AS rtf, round(t * 4 / a, 10) AS k, round(t * 4 / 3600.0::DOUBLE, 4) AS cores FROM s WHERE a > 0""",
}
