"""Queries over the derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import fixtures
from ..functions import text
from . import coverage, evaluation, exports, features, intervals, jobs, lifecycle, merging, reports, signals, speakers, turns, vectors

SEGMENTS_EV = """
    segments_ev AS (
        SELECT user_id AS record_id, event_type AS speaker_id, event_id AS seg_idx, epoch_us(ts) AS start_us,
               epoch_us(ts) + CAST(round(value * 600e6) AS BIGINT) AS end_us
        FROM events)"""
PAIRS = """
    pairs AS (
        SELECT a.record_id, a.seg_idx AS seg_a, b.seg_idx AS seg_b, a.speaker_id AS speaker_a, b.speaker_id AS speaker_b,
               greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us
        FROM segments_ev a JOIN segments_ev b ON a.record_id = b.record_id AND a.speaker_id <> b.speaker_id
             AND (a.start_us < b.start_us OR (a.start_us = b.start_us AND a.seg_idx < b.seg_idx))
             AND least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) > 50000)"""


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_pairs(fixtures.segments_ev(spark, sf_dir))


def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = intervals.overlap_pairs(fixtures.segments_ev(spark, sf_dir))
    return pairs.groupBy("record_id").agg(F.count("*").alias("n_overlaps"), F.round(F.sum(F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("overlap_s"))


def speech_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.speech_islands(fixtures.segments_ev(spark, sf_dir)).select("record_id", "start_us", "end_us")


def speech_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.speech_islands(fixtures.segments_ev(spark, sf_dir))
    return found.groupBy("record_id").agg(F.count("*").alias("n_islands"), F.round(F.sum(F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("speech_s"))


def word_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.attribute(fixtures.words_cv(spark, sf_dir), fixtures.segments_cv(spark, sf_dir))
    return found.select("record_id", "w_idx", "speaker_id")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.utterances(turns.attribute(fixtures.words_cv(spark, sf_dir), fixtures.segments_cv(spark, sf_dir), by_record=True))


def utterances_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("record_id", "speaker_id", "start_us", "end_us", "n_words", F.md5("text").alias("text_md5"))


def utterances_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.relabel(turns.bind_short(_turns(spark, sf_dir))).select("record_id", "u_idx", "speaker_id", "label", "start_us", "end_us")


def sandwich_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.sandwich(fixtures.segments_ev(spark, sf_dir)).select("record_id", "seg_idx", "smoothed")


def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.merge_adjacent(fixtures.segments_ev(spark, sf_dir))


def speaker_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.sum(F.greatest(F.lit(0), F.col("end_us") - F.col("start_us")))
    by = fixtures.segments_ev(spark, sf_dir).groupBy("record_id", "speaker_id").agg(own.alias("us"))
    share = F.col("us") / F.sum("us").over(Window.partitionBy("record_id"))
    return by.select("record_id", "speaker_id", F.round(F.col("us") / 1e6, 3).alias("speech_s"), F.round(share, 4).alias("share"), (share < 0.15).alias("small"))


WORDS_CV = """
    tokens AS (
        SELECT conv_id AS record_id, turn, role, unnest(words) AS word, unnest(range(len(words))) AS pos
        FROM (SELECT *, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS words FROM conversations) x
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY turn, pos) - 1 AS w_idx FROM tokens
    ), words_cv AS (
        SELECT *, 400000 * w_idx + 2000000 * (w_idx // 37) AS start_us, 400000 * w_idx + 2000000 * (w_idx // 37) + 300000 AS end_us FROM numbered
    ), segments_cv AS (
        SELECT record_id, turn AS seg_idx, min(role) AS speaker_id, min(start_us) + 300000 * (turn % 5 - 2) AS start_us, max(end_us) + 300000 * (turn % 5 - 2) AS end_us
        FROM words_cv GROUP BY record_id, turn
    ), met AS (
        SELECT w.record_id, w.w_idx, w.word, w.start_us, w.end_us, s.seg_idx, s.speaker_id, coalesce(s.start_us * 2 <= w.start_us + w.end_us AND w.start_us + w.end_us <= s.end_us * 2, false) AS holds,
               least(w.end_us, s.end_us) - greatest(w.start_us, s.start_us) AS shared
        FROM words_cv w LEFT JOIN segments_cv s ON w.record_id = s.record_id
             AND (least(w.end_us, s.end_us) > greatest(w.start_us, s.start_us) OR (s.start_us * 2 <= w.start_us + w.end_us AND w.start_us + w.end_us <= s.end_us * 2))
    ), attributed AS (
        SELECT record_id, w_idx, word, start_us, end_us, coalesce(speaker_id, 'SPEAKER_UNKNOWN') AS speaker_id FROM met
        QUALIFY row_number() OVER (PARTITION BY record_id, w_idx ORDER BY holds DESC, CASE WHEN holds THEN 0 ELSE shared END DESC, seg_idx) = 1
    ), flagged AS (
        SELECT *, CASE WHEN speaker_id = lag(speaker_id) OVER w AND start_us - lag(end_us) OVER w <= 1500000 THEN 0 ELSE 1 END AS new
        FROM attributed WINDOW w AS (PARTITION BY record_id ORDER BY w_idx)
    ), utterances AS (
        SELECT record_id, u_idx, speaker_id, min(start_us) AS start_us, arg_max(end_us, w_idx) AS end_us, count(*) AS n_words, string_agg(word, ' ' ORDER BY w_idx) AS text
        FROM (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY w_idx) AS u_idx FROM flagged) x GROUP BY record_id, u_idx, speaker_id
    )"""
ISLANDS = """
    flagged AS (
        SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY record_id ORDER BY start_us, end_us, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
        FROM segments_ev WHERE end_us > start_us
    ), islands AS (
        SELECT record_id, min(start_us) AS start_us, max(end_us) AS end_us
        FROM (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY start_us, end_us, seg_idx ROWS UNBOUNDED PRECEDING) AS island FROM flagged) x GROUP BY record_id, island
    )"""
OWN = [overlap_pairs, overlap_summary, speech_islands, speech_seconds, word_attribution, utterances_raw, utterances_relabelled, sandwich_rule, adjacent_merge, speaker_durations]
QUERIES = {f.__name__: f for f in OWN} | lifecycle.QUERIES | vectors.QUERIES
ORACLE_SQL = lifecycle.ORACLE_SQL | vectors.ORACLE_SQL | {
    "overlap_pairs": f"WITH {SEGMENTS_EV}, {PAIRS} SELECT * FROM pairs",
    "overlap_summary": f"""WITH {SEGMENTS_EV}, {PAIRS}
        SELECT record_id, count(*) AS n_overlaps, round(sum(end_us - start_us) / 1e6, 3) AS overlap_s FROM pairs GROUP BY record_id""",
    "speech_islands": f"WITH {SEGMENTS_EV}, {ISLANDS} SELECT * FROM islands",
    "speech_seconds": f"WITH {SEGMENTS_EV}, {ISLANDS} SELECT record_id, count(*) AS n_islands, round(sum(end_us - start_us) / 1e6, 3) AS speech_s FROM islands GROUP BY record_id",
    "word_attribution": f"WITH {WORDS_CV} SELECT record_id, w_idx, speaker_id FROM attributed",
    "utterances_raw": f"WITH {WORDS_CV} SELECT record_id, speaker_id, start_us, end_us, n_words, md5(text) AS text_md5 FROM utterances",
    "utterances_relabelled": f"""WITH {WORDS_CV}, bound AS (
            SELECT *, coalesce(end_us - start_us < 1000000 AND start_us - lag(end_us) OVER w < 300000 AND NOT regexp_matches(lag(text) OVER w, '[.?!:;…]$'), false) AS b
            FROM utterances WINDOW w AS (PARTITION BY record_id ORDER BY u_idx)
        ), spoken AS (
            SELECT record_id, u_idx, start_us, end_us, last_value(CASE WHEN NOT b THEN speaker_id END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY u_idx ROWS UNBOUNDED PRECEDING) AS speaker_id FROM bound
        ), firsts AS (
            SELECT record_id, speaker_id, row_number() OVER (PARTITION BY record_id ORDER BY min(u_idx)) - 1 AS n FROM spoken WHERE speaker_id <> 'SPEAKER_UNKNOWN' GROUP BY record_id, speaker_id
        )
        SELECT s.record_id, u_idx, s.speaker_id, coalesce('SPEAKER_' || lpad(CAST(n AS VARCHAR), 2, '0'), s.speaker_id) AS label, start_us, end_us
        FROM spoken s LEFT JOIN firsts f ON s.record_id = f.record_id AND s.speaker_id = f.speaker_id""",
    "sandwich_rule": f"""WITH {SEGMENTS_EV}
        SELECT record_id, seg_idx, CASE WHEN lag(speaker_id) OVER w = lead(speaker_id) OVER w AND lag(speaker_id) OVER w <> speaker_id AND end_us - start_us < 800000 THEN lag(speaker_id) OVER w ELSE speaker_id END AS smoothed
        FROM segments_ev WINDOW w AS (PARTITION BY record_id ORDER BY start_us, seg_idx)""",
    "adjacent_merge": f"""WITH {SEGMENTS_EV}, runs AS (
            SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY start_us, seg_idx ROWS UNBOUNDED PRECEDING) AS run
            FROM (SELECT *, CASE WHEN speaker_id = lag(speaker_id) OVER (PARTITION BY record_id ORDER BY start_us, seg_idx) THEN 0 ELSE 1 END AS new FROM segments_ev) x
        ), cut AS (
            SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY record_id, run ORDER BY start_us, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50000 THEN 0 ELSE 1 END AS opens FROM runs
        )
        SELECT record_id, speaker_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_merged
        FROM (SELECT *, sum(opens) OVER (PARTITION BY record_id, run ORDER BY start_us, seg_idx ROWS UNBOUNDED PRECEDING) AS island FROM cut) y GROUP BY record_id, run, island, speaker_id""",
    "speaker_durations": f"""WITH {SEGMENTS_EV}, own AS (SELECT record_id, speaker_id, sum(greatest(0, end_us - start_us)) AS us FROM segments_ev GROUP BY record_id, speaker_id), shared AS (
            SELECT *, us / sum(us) OVER (PARTITION BY record_id) AS s FROM own)
        SELECT record_id, speaker_id, round(us / 1e6, 3) AS speech_s, round(s, 4) AS share, s < 0.15 AS small FROM shared""",
}

GAPS = """
    stretched AS (SELECT record_id, speaker_id, seg_idx, start_us, end_us + 3000000 AS end_us FROM segments_cv
    ), flags2 AS (
        SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY record_id ORDER BY start_us, end_us, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
        FROM stretched WHERE end_us > start_us
    ), isl AS (
        SELECT record_id, island, min(start_us) AS s0, max(end_us) AS s1
        FROM (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY start_us, end_us, seg_idx ROWS UNBOUNDED PRECEDING) AS island FROM flags2) x GROUP BY record_id, island
    ), inside AS (
        SELECT i.*, w.w_idx, w.start_us AS w0, w.end_us AS w1 FROM isl i LEFT JOIN (SELECT * FROM words_cv WHERE w_idx % 9 < 3) w ON w.record_id = i.record_id AND w.end_us > i.s0 AND w.start_us < i.s1
    ), gaps AS (
        SELECT record_id, g0 AS start_us, w0 AS end_us FROM (
            SELECT *, coalesce(max(w1) OVER (PARTITION BY record_id, island ORDER BY w0, w_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s0) AS g0 FROM inside WHERE w_idx IS NOT NULL) a WHERE w0 > g0
        UNION ALL
        SELECT record_id, g0, s1 FROM (SELECT record_id, island, s0, s1, coalesce(max(w1), s0) AS g0 FROM inside GROUP BY record_id, island, s0, s1) b WHERE s1 > g0
    )"""
SMALL = """
    own AS (SELECT record_id, speaker_id, CAST(sum(greatest(0, end_us - start_us)) AS BIGINT) AS us FROM segments_ev GROUP BY record_id, speaker_id
    ), below AS (SELECT *, us / sum(us) OVER (PARTITION BY record_id) < 0.15 AS b, row_number() OVER (PARTITION BY record_id ORDER BY us DESC, speaker_id) AS rn FROM own
    ), small AS (SELECT record_id, speaker_id, us, b AND NOT (bool_and(b) OVER (PARTITION BY record_id) AND rn = 1) AS small FROM below)"""
QUERIES |= coverage.QUERIES | text.QUERIES
ORACLE_SQL |= text.ORACLE_SQL | {
    "untranscribed_gaps": f"WITH {WORDS_CV}, {GAPS} SELECT * FROM gaps WHERE end_us - start_us >= 2000000",
    "speech_coverage": f"""WITH {WORDS_CV}, {GAPS}, sp AS (SELECT record_id, sum(s1 - s0) AS speech_us FROM isl GROUP BY record_id), g AS (
            SELECT record_id, sum(end_us - start_us) AS gap_us, count(*) FILTER (end_us - start_us >= 2000000) AS n_long, coalesce(sum(end_us - start_us) FILTER (end_us - start_us >= 2000000), 0) AS long_us FROM gaps GROUP BY record_id)
        SELECT sp.record_id, speech_us, coalesce(gap_us, 0) AS gap_us, coalesce(n_long, 0) AS n_long, coalesce(long_us, 0) AS long_us,
               round(greatest(0.0, (speech_us - coalesce(gap_us, 0)) * 100.0 / speech_us), 2) AS covered_pct FROM sp LEFT JOIN g ON g.record_id = sp.record_id""",
    "overlap_sweep_exact": f"""WITH {SEGMENTS_EV}, steps AS (
            SELECT record_id, t, sum(d) AS d FROM (SELECT record_id, start_us AS t, 1 AS d FROM segments_ev WHERE end_us > start_us UNION ALL SELECT record_id, end_us, -1 FROM segments_ev WHERE end_us > start_us) a GROUP BY record_id, t
        ), opened AS (SELECT record_id, t, sum(d) OVER w AS open, lead(t) OVER w AS until FROM steps WINDOW w AS (PARTITION BY record_id ORDER BY t))
        SELECT record_id, sum(CASE WHEN open > 1 THEN until - t ELSE 0 END) AS overlap_us FROM opened GROUP BY record_id""",
    "vad_filter": f"""WITH {WORDS_CV}, vad AS (SELECT * FROM segments_cv WHERE seg_idx % 3 = 1 AND record_id % 5 <> 0)
        SELECT record_id, w_idx FROM words_cv w WHERE EXISTS (SELECT 1 FROM vad v WHERE v.record_id = w.record_id AND (v.start_us - 600000) * 2 <= w.start_us + w.end_us AND w.start_us + w.end_us <= (v.end_us + 600000) * 2)
              OR NOT EXISTS (SELECT 1 FROM vad v WHERE v.record_id = w.record_id)""",
    "small_speakers": f"WITH {SEGMENTS_EV}, {SMALL} SELECT * FROM small",
    "nearest_major": f"""WITH {SEGMENTS_EV}, {SMALL}, told AS (SELECT s.*, m.small FROM segments_ev s JOIN small m ON m.record_id = s.record_id AND m.speaker_id = s.speaker_id)
        SELECT a.record_id, a.seg_idx, b.seg_idx AS near_idx, greatest(0, a.start_us - b.end_us, b.start_us - a.end_us) AS distance_us FROM told a JOIN told b ON a.record_id = b.record_id AND a.small AND NOT b.small
        QUALIFY row_number() OVER (PARTITION BY a.record_id, a.seg_idx ORDER BY CASE WHEN least(a.end_us, b.end_us) > greatest(a.start_us, b.start_us) THEN -1 ELSE greatest(0, a.start_us - b.end_us, b.start_us - a.end_us) END, b.seg_idx) = 1""",
    "min_duration_keep": f"""WITH {SEGMENTS_EV}, told AS (
            SELECT *, bool_or(end_us - start_us >= 20000000000) OVER (PARTITION BY record_id, speaker_id) AS kept, row_number() OVER (PARTITION BY record_id, speaker_id ORDER BY end_us - start_us DESC, start_us, seg_idx) AS rn FROM segments_ev)
        SELECT record_id, seg_idx FROM told WHERE end_us - start_us >= 20000000000 OR (NOT kept AND rn = 1)""",
}
for _part in (signals, features, evaluation, jobs, merging, reports):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
QUERIES |= speakers.QUERIES
ORACLE_SQL["words_per_record"] = f"""WITH {WORDS_CV} SELECT record_id, count(*) AS n_words, count(DISTINCT role) AS n_speakers, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers,
    round((max(end_us) - min(start_us)) / 1e6, 3) AS audio_s, round(count(*) / 100.0 / ((max(end_us) - min(start_us)) / 1e6), 4) AS rtf FROM words_cv GROUP BY record_id"""


ORACLE_SQL["merged_speakers"] = f"WITH {SEGMENTS_EV}, {SMALL} {merging.MERGED_SQL}"
ORACLE_SQL |= {name: f"WITH {WORDS_CV} {body}" for name, body in reports.WORD_BODY.items()}
ORACLE_SQL["der"] = f"WITH {WORDS_CV} {evaluation.der_sql(0)}"
ORACLE_SQL["der_collar"] = f"WITH {WORDS_CV} {evaluation.der_sql(250_000)}"


def smooth_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = turns.attribute(fixtures.words_cv(spark, sf_dir), fixtures.segments_cv(spark, sf_dir), by_record=True)
    return turns.smooth_words(words).select("record_id", "w_idx", "speaker_id")


def micro_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.absorb_punctuation(_turns(spark, sf_dir)).select("record_id", "u_idx", "speaker_id")


def merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.merge_turns(turns.bind_short(_turns(spark, sf_dir)), clause_us=4_000_000, silence_us=2_500_000).select("record_id", "run", "speaker_id", "start_us", "end_us", "n_words", F.md5("text").alias("text_md5"))


def utterances_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.bind_short(_turns(spark, sf_dir)).select("record_id", "u_idx", "speaker_id")


BOUND = """bound AS (
        SELECT *, coalesce(end_us - start_us < 1000000 AND start_us - lag(end_us) OVER w < 300000 AND NOT regexp_matches(lag(text) OVER w, '[.?!:;…]$'), false) AS b
        FROM utterances WINDOW w AS (PARTITION BY record_id ORDER BY u_idx)
    ), spoken AS (
        SELECT record_id, u_idx, start_us, end_us, n_words, text, last_value(CASE WHEN NOT b THEN speaker_id END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY u_idx ROWS UNBOUNDED PRECEDING) AS speaker_id FROM bound
    )"""
QUERIES |= {f.__name__: f for f in (smooth_words, micro_rule, merge_turns, utterances_bound)} | exports.queries(_turns)
ORACLE_SQL |= {name: f"WITH {WORDS_CV} {body}" for name, body in exports.ORACLE_BODY.items()} | {
    "smooth_words": f"""WITH {WORDS_CV} SELECT record_id, w_idx, CASE WHEN lag(speaker_id) OVER w = lead(speaker_id) OVER w AND lag(speaker_id) OVER w <> speaker_id THEN lag(speaker_id) OVER w ELSE speaker_id END AS speaker_id
        FROM attributed WINDOW w AS (PARTITION BY record_id ORDER BY w_idx)""",
    "micro_rule": f"""WITH {WORDS_CV} SELECT record_id, u_idx, CASE WHEN regexp_full_match(text, '[\\s?.!,:;…–-]*') THEN coalesce(lag(speaker_id) OVER w, lead(speaker_id) OVER w, speaker_id) ELSE speaker_id END AS speaker_id
        FROM utterances WINDOW w AS (PARTITION BY record_id ORDER BY u_idx)""",
    "utterances_bound": f"WITH {WORDS_CV}, {BOUND} SELECT record_id, u_idx, speaker_id FROM spoken",
    "merge_turns": f"""WITH {WORDS_CV}, {BOUND}, flags3 AS (
            SELECT *, CASE WHEN speaker_id = lag(speaker_id) OVER w AND trim(text) <> '' AND trim(lag(text) OVER w) <> '' AND (start_us - lag(end_us) OVER w <= 2500000
                OR (start_us - lag(end_us) OVER w <= 4000000 AND NOT regexp_matches(lag(text) OVER w, '[.?!:;…]$'))) THEN 0 ELSE 1 END AS new FROM spoken WINDOW w AS (PARTITION BY record_id ORDER BY u_idx))
        SELECT record_id, run, speaker_id, min(start_us) AS start_us, arg_max(end_us, u_idx) AS end_us, CAST(sum(n_words) AS BIGINT) AS n_words, md5(string_agg(trim(text), ' ' ORDER BY u_idx)) AS text_md5
        FROM (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY u_idx ROWS UNBOUNDED PRECEDING) AS run FROM flags3) x GROUP BY record_id, run, speaker_id""",
}
