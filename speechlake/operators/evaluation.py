"""Measures: diarization error, paired comparison, signed ranks, counts per record."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import fixtures
from . import intervals
from .cells import TURNS, WORDS, meet


def _open(segments: DataFrame, name: str) -> DataFrame:
    """Intervals of each speaker, merged, with the speaker in `name`."""
    key = F.struct("record_id", "speaker_id").alias("record_id")
    rows = intervals.speech_islands(segments.select(key, "seg_idx", "start_us", "end_us"))
    return rows.select("record_id.record_id", F.col("record_id.speaker_id").alias(name), "start_us", "end_us")


def shared_time(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(record_id, ref, hyp, us): how long two speakers of the two sides speak together."""
    a = ref.withColumnsRenamed({"start_us": "r0", "end_us": "r1"})
    b = hyp.withColumnsRenamed({"start_us": "h0", "end_us": "h1"})
    us = F.least("r1", "h1") - F.greatest("r0", "h0")
    met = meet(a, b, ["record_id"], ("r0", "r1"), ("h0", "h1"), TURNS, TURNS).where(us > 0)
    return met.groupBy("record_id", "ref", "hyp").agg(F.sum(us).alias("us"))


def outside_collars(side: DataFrame, name: str, reference: DataFrame, collar_us: int) -> DataFrame:
    """The side's intervals (record_id, `name`, start_us, end_us) without half a collar before and after each boundary of the reference."""
    edges = reference.where("end_us > start_us").select("record_id", F.explode(F.array("start_us", "end_us")).alias("t")).distinct()
    holes = edges.select("record_id", (F.col("t") - collar_us // 2).alias("start_us"), (F.col("t") + (collar_us - collar_us // 2)).alias("end_us"))
    rows = side.select("record_id", F.struct(name, "start_us").alias("island"), "start_us", "end_us")
    left = intervals.difference(rows, holes, TURNS, WORDS)
    return left.select("record_id", F.col(f"island.{name}").alias(name), "start_us", "end_us")


def best_mapping(pairs: DataFrame) -> DataFrame:
    """(record_id, matched_us): the one-to-one mapping of speakers that shares most time; one matrix of speakers a record, many records a batch."""

    def matched(pairs: list[dict]) -> int:
        refs, hyps = ({v: i for i, v in enumerate(sorted({p[side] for p in pairs}))} for side in ("ref", "hyp"))
        gain = np.zeros((len(refs), len(hyps)))
        for p in pairs:
            gain[refs[p["ref"]], hyps[p["hyp"]]] += p["us"]
        n = max(gain.shape)
        cost = np.zeros((n, n))
        cost[: gain.shape[0], : gain.shape[1]] = gain.max() - gain
        cost[gain.shape[0] :, :] = cost[:, gain.shape[1] :] = gain.max()
        # Rows enter one by one by the shortest augmenting path over reduced costs.
        row_price, col_price, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
        for row in range(n):
            far, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
            i, at, reach = row, -1, 0.0
            while i >= 0:
                step = reach + cost[i] - row_price[i] - col_price
                better = ~done & (step < far)
                far[better], via[better] = step[better], at
                at = int(np.argmin(np.where(done, np.inf, far)))
                reach, done[at] = far[at], True
                i = owner[at]
            seen = done.copy()
            seen[at] = False
            row_price[row] += reach
            row_price[owner[seen]] += reach - far[seen]
            col_price[seen] -= reach - far[seen]
            while at >= 0:
                before = via[at]
                owner[at] = owner[before] if before >= 0 else row
                at = before
        real = [(owner[c], c) for c in range(gain.shape[1]) if owner[c] < gain.shape[0]]
        return int(sum(gain[r, c] for r, c in real))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(matched, b.column(1).to_pylist()), pa.int64())], ["record_id", "matched_us"])

    named = pairs.where("ref IS NOT NULL AND hyp IS NOT NULL").groupBy(F.col("record_id").cast("long").alias("record_id"))
    return named.agg(F.collect_list(F.struct("ref", "hyp", "us")).alias("pairs")).mapInArrow(run, "record_id long, matched_us long")


def diarization_error(reference: DataFrame, hypothesis: DataFrame, collar_us: int = 0) -> DataFrame:
    """(record_id, total_us, missed_us, false_us, confused_us, der_pct); der_pct is 0 for a record without speech left.

    Over the timeline with R and H speakers open: missed max(0, R - H), false alarm
    max(0, H - R), confused min(R, H) less what the best mapping matches. With a collar, the
    time of that width around each boundary of a reference interval counts for nothing, in
    the mapping either; a record of which nothing is left outside collars is left out.
    """
    ref, hyp = _open(reference, "ref"), _open(hypothesis, "hyp")
    if collar_us:
        ref, hyp = outside_collars(ref, "ref", reference, collar_us), outside_collars(hyp, "hyp", reference, collar_us)

    def turned(df: DataFrame, r: int, h: int) -> DataFrame:
        edge = lambda t, d: F.struct(F.col(t).alias("t"), F.lit(d * r).alias("r"), F.lit(d * h).alias("h"))
        return df.select("record_id", F.inline(F.array(edge("start_us", 1), edge("end_us", -1))))

    ends = turned(ref, 1, 0).unionByName(turned(hyp, 0, 1))
    w = Window.partitionBy("record_id").orderBy("t")
    steps = ends.groupBy("record_id", "t").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    line = steps.select("record_id", F.sum("r").over(upto).alias("R"), F.sum("h").over(upto).alias("H"), (F.lead("t").over(w) - F.col("t")).alias("d"))
    weigh = lambda e: F.coalesce(F.sum(e * F.col("d")), F.lit(0))
    sums = line.groupBy("record_id").agg(
        weigh(F.col("R")).alias("total_us"),
        weigh(F.greatest(F.lit(0), F.col("R") - F.col("H"))).alias("missed_us"),
        weigh(F.greatest(F.lit(0), F.col("H") - F.col("R"))).alias("false_us"),
        weigh(F.least("R", "H")).alias("both_us"),
    )
    matched = best_mapping(shared_time(ref, hyp))
    full = sums.join(matched, "record_id", "left").withColumn("confused_us", F.col("both_us") - F.coalesce("matched_us", F.lit(0)))
    share = F.try_divide((F.col("missed_us") + F.col("false_us") + F.col("confused_us")) * F.lit(100.0), F.col("total_us"))
    return full.select("record_id", "total_us", "missed_us", "false_us", "confused_us", F.round(F.coalesce(share, F.lit(0.0)), 2).alias("der_pct"))


def signed_ranks(diffs: DataFrame, column: str) -> DataFrame:
    """(w_plus, w_minus, n): rank sums of the signed differences without zeros, mean ranks on ties.

    Ranks come from counts per distinct size, so that rows are combined before the one
    ordered pass, which sees distinct sizes alone.
    """
    sizes = diffs.where(F.col(column) != 0).groupBy(F.abs(column).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col(column) > 0).alias("up"))
    rank = F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("n") - 1) / 2
    ranked = sizes.withColumn("rank", rank)
    zero = F.lit(0.0)
    return ranked.agg(F.coalesce(F.sum(F.col("rank") * F.col("up")), zero).alias("w_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("n") - F.col("up"))), zero).alias("w_minus"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def rank_p_value(diffs: DataFrame, column: str, exact_to: int = 50) -> DataFrame:
    """(w, n, p_value): the two-sided signed-rank test of one column of differences, zeros left out.

    Up to exact_to differences without ties or zeros the share of sign patterns at least as far
    out is counted; else the normal approximation with the correction for ties, without one for
    continuity. No difference at all but zeros, or no row: p_value 1. Null and NaN differences are left out.
    """
    known = diffs.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(column)
    sizes = known.groupBy(F.abs(column).alias("size")).agg(F.count("*").cast("double").alias("t"))
    ties = sizes.agg(F.coalesce(F.sum(F.when(F.col("size") != 0, F.pow("t", F.lit(3)) - F.col("t"))), F.lit(0.0)).alias("ties"), F.count_if(F.col("size") == 0).alias("zeros"))

    @F.pandas_udf("double")
    def p_of(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(float(a), int(b), float(c), bool(d), exact_to) for a, b, c, d in zip(w, n, ties, zeros)])

    both = signed_ranks(known, column).unionByName(ties, allowMissingColumns=True)  # a row each
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    w = F.least("w_plus", "w_minus")
    return one.select(w.alias("w"), F.col("n"), p_of(w, F.col("n").cast("long"), "ties", F.col("zeros").cast("long")).alias("p_value"))


def signed_rank_p(w: float, n: int, ties: float, zeros: bool, exact_to: int = 50) -> float:
    """The p-value for the lesser rank sum w of n differences; ties: the sum of t^3 - t over groups of equal sizes."""
    if n == 0:
        return 1.0
    if n <= exact_to and not ties and not zeros:
        ways = [1] + [0] * int(w)
        for rank in range(1, n + 1):
            for at in range(int(w), rank - 1, -1):
                ways[at] += ways[at - rank]
        return min(1.0, 2 * sum(ways) / 2**n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def speaker_count_summary(counts: DataFrame) -> DataFrame:
    """(n, match_pct, mae, mean_rtf) of rows (expected, found, seconds, duration_s).

    A row without expected or found counts nowhere but in mean_rtf; durations of zero have no factor.
    """
    known = F.col("expected").isNotNull() & F.col("found").isNotNull()
    off = F.when(known, F.abs(F.col("found") - F.col("expected")))
    return counts.agg(
        F.count(off).alias("n"),
        F.round(F.avg(F.when(known, F.when(off == 0, 100.0).otherwise(0.0))), 4).alias("match_pct"),
        F.round(F.avg(off), 6).alias("mae"),
        F.round(F.avg(F.try_divide(F.col("seconds"), F.col("duration_s"))), 6).alias("mean_rtf"),
    )


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    by = lambda flag: li.where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return paired_differences(by("A"), by("R"), "l_orderkey", "q")


def paired_differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, diff): new less old value of the keys that both have, null values left out."""
    a, b = (df.where(F.col(value).isNotNull()).select(key, F.col(value).alias(n)) for df, n in ((old, "old_value"), (new, "new_value")))
    return a.join(b, key).select(key, (F.col("new_value") - F.col("old_value")).alias("diff"))


def paired_summary(diffs: DataFrame, band: float = 0.001) -> DataFrame:
    """(n, mean, median, improved, degraded, unchanged) of differences (diff): within the band on both sides nothing has changed.

    The exact median holds the distinct differences.
    """
    d = F.col("diff")
    return diffs.agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.median(d).alias("median"), F.count_if(d < -band).alias("improved"), F.count_if(d > band).alias("degraded"), F.count_if(F.abs(d) <= band).alias("unchanged"))


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_summary(_paired(spark, sf_dir))


#: The labels of a comparison's rows, its heads and what is said of its p-value, from the reference behaviour.
COMPARISON = (
    ("**Model Yükleme Süresi (`load_time_sec`)**", "load_s", "", "s", 3),
    ("**Kaçırılan Konuşma (% Missed)**", "missed", "%", "", 2),
    ("**Yanlış Alarm (% False Alarm)**", "false_alarm", "%", "", 2),
    ("**Konuşmacı Karmaşası (% Confusion)**", "confusion", "%", "", 2),
    ("**Konuşmacı Sayısı Eşleşme Oranı**", "matched", "%", "", 2),
    ("**Medyan İşlem Süresi (P50)**", "median_s", "", "s", 3),
    ("**P95 İşlem Süresi (P95)**", "p95_s", "", "s", 3),
    ("**Maksimum RAM Kullanımı (RSS)**", "rss_mb", "", " MB", 1),
)
DER_LABEL, P_LABEL, NO_CHANGE, CHANGE = "**Ortalama DER ± Std**", "**Wilcoxon p-değeri**", "İstatistiksel Olarak Anlamlı Fark Yok (p >= 0.05)", "İstatistiksel Olarak Anlamlı Fark Var (p < 0.05)"
HEAD, HEAD_OLD, HEAD_NEW, HEAD_DIFF = "Metrik / Performans Göstergesi", "(Eski)", "(Yeni)", "Fark / Değişim"


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over the files of a run (file, der, missed, false_alarm, confusion, expected, found, seconds, rss_mb, load_s): means, deviation, percentiles of time, share of right counts, most memory."""
    right = F.when(F.col("expected") == F.col("found"), 100.0).otherwise(0.0)
    means = [F.avg(c).alias(c) for c in ("der", "missed", "false_alarm", "confusion")]
    return runs.agg(*means, F.stddev_pop("der").alias("der_std"), F.avg(right).alias("matched"), F.median("seconds").alias("median_s"), F.percentile("seconds", 0.95).alias("p95_s"), F.max("rss_mb").alias("rss_mb"), F.max("load_s").alias("load_s"))


def comparison_lines(old: DataFrame, new: DataFrame, old_name: str, new_name: str) -> DataFrame:
    """(n, line): the lines of a Markdown table that sets two runs (`run_summary`) side by side, with the p-value of their paired error rates.

    Missing figures count as 0. All is aggregates of one row; the lines are made from that row.
    """
    both = run_summary(old).select(*[F.coalesce(c, F.lit(0.0)).alias(f"o_{c}") for c in run_summary(old).columns])
    both = both.join(run_summary(new).select(*[F.coalesce(c, F.lit(0.0)).alias(f"n_{c}") for c in run_summary(new).columns]))  # one row each
    both = both.join(rank_p_value(paired_differences(old, new, "file", "der"), "diff").select("p_value"))  # one row
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    def cells(label: str, name: str, before: str, after: str, digits: int) -> Column:
        before = before.replace("%", "%%")
        shown = lambda c, sign="": F.format_string(f"`{before}%{sign}.{digits}f{after}`", c)
        o, n = F.col(f"o_{name}"), F.col(f"n_{name}")
        return line(F.lit(label), shown(o), shown(n), shown(n - o, "+"))

    der = line(F.lit(DER_LABEL), *(F.format_string("`%%%.2f ± %%%.2f`", f"{s}_der", f"{s}_der_std") for s in "on"), F.format_string("`%%%+.2f`", F.col("n_der") - F.col("o_der")))
    p = line(F.lit(P_LABEL), F.lit("-"), F.format_string("`p = %.4f`", "p_value"), F.when(F.col("p_value") >= 0.05, NO_CHANGE).otherwise(CHANGE))
    measures = [cells(*c) for c in COMPARISON]
    head = [line(*map(F.lit, (HEAD, f"{old_name.upper()} {HEAD_OLD}", f"{new_name.upper()} {HEAD_NEW}", HEAD_DIFF))), F.lit("| :--- | :---: | :---: | :---: |")]
    return both.select(F.posexplode(F.array(*head, measures[0], der, *measures[1:], p)).alias("n", "line"))


def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed_ranks(_paired(spark, sf_dir), "diff")


def der(spark: SparkSession, sf_dir: str, collar_us: int = 0) -> DataFrame:
    """The turns against themselves 0.2 s later without every fourth: the derived input of FIXTURES.md."""
    ref = fixtures.segments_cv(spark, sf_dir)
    hyp = ref.withColumn("start_us", F.col("start_us") + 200_000).withColumn("end_us", F.col("end_us") + 200_000).withColumn("speaker_id", F.concat(F.lit("h_"), "speaker_id"))
    return diarization_error(ref, hyp.where("seg_idx % 4 <> 3"), collar_us)


def der_collar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return der(spark, sf_dir, 250_000)


def words_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fixtures.words_cv(spark, sf_dir)
    seconds = (F.max("end_us") - F.min("start_us")) / 1e6
    return w.groupBy("record_id").agg(F.count("*").alias("n_words"), F.count_distinct("role").alias("n_speakers"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("speakers"), F.round(seconds, 3).alias("audio_s"), F.round(F.count("*") / F.lit(100.0) / seconds, 4).alias("rtf"))


PAIRED = """WITH a AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS qa FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS qr FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    p AS (SELECT a.l_orderkey, CAST(qr - qa AS BIGINT) AS diff FROM a JOIN r ON a.l_orderkey = r.l_orderkey)"""
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_p_value(_paired(spark, sf_dir), "diff")


def speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings: lines expected, suppliers found."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = li.groupBy("l_orderkey").agg(F.count("*").alias("expected"), F.count_distinct("l_suppkey").alias("found"), F.sum(F.col("l_linenumber").cast("double")).alias("seconds"), F.sum(F.col("l_quantity").cast("double")).alias("duration_s"))
    return speaker_count_summary(own)


def der_sql(collar_us: int) -> str:
    """The error by elementary stretches of time and all six mappings of three roles; to be put behind segments_cv."""
    half = collar_us // 2
    return f""", hyp AS (
            SELECT record_id, 'h_' || speaker_id AS speaker_id, start_us + 200000 AS start_us, end_us + 200000 AS end_us FROM segments_cv WHERE seg_idx % 4 <> 3
        ), edges AS (
            SELECT record_id, unnest([start_us, end_us]) AS t FROM segments_cv WHERE end_us > start_us
        ), times AS (
            SELECT record_id, unnest([t, t - {half}, t + {half}]) AS t FROM edges UNION SELECT record_id, unnest([start_us, end_us]) FROM hyp
        ), stretches AS (
            SELECT record_id, t, lead(t) OVER (PARTITION BY record_id ORDER BY t) - t AS d FROM times
        ), kept AS (
            SELECT * FROM stretches s WHERE d > 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.record_id = s.record_id AND e.t - {half} <= s.t AND s.t + s.d <= e.t + {half})
        ), r AS (
            SELECT DISTINCT k.record_id, t, d, speaker_id FROM kept k JOIN segments_cv s ON k.record_id = s.record_id AND s.start_us <= t AND t + d <= s.end_us
        ), h AS (
            SELECT DISTINCT k.record_id, t, d, speaker_id FROM kept k JOIN hyp s ON k.record_id = s.record_id AND s.start_us <= t AND t + d <= s.end_us
        ), counts AS (
            SELECT record_id, t, d, count(*) FILTER (side = 'r') AS nr, count(*) FILTER (side = 'h') AS nh
            FROM (SELECT record_id, t, d, 'r' AS side FROM r UNION ALL SELECT record_id, t, d, 'h' FROM h) x GROUP BY record_id, t, d
        ), mappings(m, a, b) AS (
            VALUES (1, 'user', 'user'), (1, 'assistant', 'assistant'), (1, 'system', 'system'), (2, 'user', 'user'), (2, 'assistant', 'system'), (2, 'system', 'assistant'),
                   (3, 'user', 'assistant'), (3, 'assistant', 'user'), (3, 'system', 'system'), (4, 'user', 'assistant'), (4, 'assistant', 'system'), (4, 'system', 'user'),
                   (5, 'user', 'system'), (5, 'assistant', 'user'), (5, 'system', 'assistant'), (6, 'user', 'system'), (6, 'assistant', 'assistant'), (6, 'system', 'user')
        ), shared AS (
            SELECT r.record_id, m, sum(r.d) AS us FROM r JOIN h ON r.record_id = h.record_id AND r.t = h.t JOIN mappings ON r.speaker_id = a AND h.speaker_id = 'h_' || b GROUP BY r.record_id, m
        ), matched AS (SELECT record_id, max(us) AS us FROM shared GROUP BY record_id
        ), sums AS (
            SELECT record_id, sum(d * nr) AS total_us, sum(d * greatest(0, nr - nh)) AS missed_us, sum(d * greatest(0, nh - nr)) AS false_us, sum(d * least(nr, nh)) AS both_us FROM counts GROUP BY record_id
        )
        SELECT s.record_id, total_us, missed_us, false_us, both_us - coalesce(us, 0) AS confused_us, round(coalesce((missed_us + false_us + both_us - coalesce(us, 0)) * 100.0 / nullif(total_us, 0), 0.0), 2) AS der_pct
        FROM sums s LEFT JOIN matched m ON s.record_id = m.record_id"""


QUERIES = {"wilcoxon_p": wilcoxon_p, "speaker_counts": speaker_counts, "paired_compare": paired_compare, "wilcoxon_w": wilcoxon_w, "der": der, "der_collar": der_collar, "words_per_record": words_per_record}
ORACLE_SQL = {
    "speaker_counts": """
        WITH own AS (SELECT l_orderkey, count(*) AS expected, count(DISTINCT l_suppkey) AS found, sum(CAST(l_linenumber AS DOUBLE)) AS seconds, sum(CAST(l_quantity AS DOUBLE)) AS duration_s FROM lineitem GROUP BY 1)
        SELECT count(*) AS n, round(avg(CASE WHEN expected = found THEN 100.0 ELSE 0.0 END), 4) AS match_pct, round(avg(abs(found - expected)), 6) AS mae, round(avg(seconds / nullif(duration_s, 0)), 6) AS mean_rtf FROM own""",
    "paired_compare": f"{PAIRED} SELECT count(*) AS n, round(avg(diff), 6) AS mean, median(diff) AS median, count(*) FILTER (diff < 0) AS improved, count(*) FILTER (diff > 0) AS degraded, count(*) FILTER (diff = 0) AS unchanged FROM p",
    "wilcoxon_w": f"""{PAIRED}, r2 AS (SELECT diff, avg(rn) OVER (PARTITION BY abs(diff)) AS rank FROM (SELECT diff, row_number() OVER (ORDER BY abs(diff)) AS rn FROM p WHERE diff <> 0) x)
        SELECT coalesce(sum(rank) FILTER (diff > 0), 0.0) AS w_plus, coalesce(sum(rank) FILTER (diff < 0), 0.0) AS w_minus, count(*) AS n FROM r2""",
}
