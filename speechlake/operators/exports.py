"""Utterances as lines: RTTM, SRT, plain text, label tracks and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock


def _s(us):
    return F.col(us) / 1e6


def rttm_lines(turns: DataFrame) -> DataFrame:
    """(record_id, start_us, line), at least 0.01 s long."""
    size = F.greatest(F.lit(0.01), F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3))
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("record_id").cast("string"), _s("start_us"), size, "speaker_id")
    return turns.select("record_id", "start_us", line.alias("line"))


def srt_lines(turns: DataFrame) -> DataFrame:
    """(record_id, n, block): numbered from 1 by start."""
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("start_us", "u_idx"))
    block = F.concat_ws("\n", n.cast("string"), F.concat(clock(F.col("start_us")), F.lit(" --> "), clock(F.col("end_us"))), F.format_string("[%s] %s", "speaker_id", "text"))
    return turns.select("record_id", n.alias("n"), block.alias("block"))


def label_lines(turns: DataFrame) -> DataFrame:
    return turns.select("record_id", "start_us", F.format_string("%.6f\t%.6f\t%s", _s("start_us"), _s("end_us"), "speaker_id").alias("line"))


def reports(turns: DataFrame) -> DataFrame:
    """(record_id, report): JSON with sorted speakers, counts and utterances in order."""
    each = F.struct("start_us", "u_idx", F.round(_s("start_us"), 2).alias("start"), F.round(_s("end_us"), 2).alias("end"), F.col("speaker_id").alias("speaker"), "text")
    parts = F.transform(F.array_sort(F.collect_list(each)), lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["speaker"].alias("speaker"), u["text"].alias("text")))
    own = turns.groupBy("record_id").agg(F.sort_array(F.collect_set("speaker_id")).alias("speakers"), F.count("*").alias("n_utterances"), F.sum("n_words").alias("n_words"), parts.alias("utterances"))
    return own.select("record_id", F.to_json(F.struct("record_id", "speakers", "n_utterances", "n_words", "utterances")).alias("report"))


#: The words of the header and the rule below it, from the reference behaviour.
TEXT_HEADER = ("Dosya: ", "Tespit Edilen Dil: ", "Konuşmacı Sayısı: ", "Toplam Süre: ", " saniye", "=" * 60)


def minutes_clock(us: Column) -> Column:
    """MM:SS.ss, half hundredths up; minutes go on past 59, and what rounds to a whole minute stays 60.00 seconds."""
    cs = F.floor((us % 60_000_000 + 5_000) / 10_000)
    return F.format_string("%02d:%02d.%02d", F.floor(us / 60_000_000), F.floor(cs / 100), cs % 100)


def text_reports(turns: DataFrame, recordings: DataFrame) -> DataFrame:
    """(record_id, report): a header of name, language, speakers and seconds, then each utterance with its times.

    recordings (record_id, name, lang, duration_s); a record without a row there has empty fields
    and 0.00 seconds. A null text counts as empty. One record's utterances are one text.
    """
    file, lang, speakers, total, unit, rule = TEXT_HEADER
    block = F.concat(F.lit("["), minutes_clock(F.col("start_us")), F.lit(" - "), minutes_clock(F.col("end_us")), F.lit("] "), F.coalesce("speaker_id", F.lit("")), F.lit(":\n  "), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("start_us", "u_idx", block.alias("block")))), lambda u: u["block"])
    own = turns.groupBy("record_id").agg(F.sort_array(F.collect_set("speaker_id")).alias("who"), F.array_join(blocks, "").alias("body"))
    told = own.join(recordings.select("record_id", "name", "lang", "duration_s"), "record_id", "left")
    field = lambda label, value: F.concat(F.lit(label), F.coalesce(value, F.lit("")), F.lit("\n"))
    count = F.concat(F.size("who").cast("string"), F.lit(" ("), F.array_join("who", ", "), F.lit(")"))
    seconds = F.concat(F.format_string("%.2f", F.coalesce("duration_s", F.lit(0.0))), F.lit(unit))
    head = [field(file, F.col("name")), field(lang, F.col("lang")), field(speakers, count), field(total, seconds), F.lit(rule + "\n\n")]
    return told.select("record_id", F.concat(*head, "body").alias("report"))


def write_lines(lines: DataFrame, path: str, column: str = "line", order: tuple[str, ...] = ("start_us",)) -> None:
    """A folder of text files with each record's lines together and in order; rows are dealt by record."""
    lines.repartition("record_id").sortWithinPartitions("record_id", *order).select(column).write.mode("overwrite").text(path)


def queries(turns_of) -> dict:
    def run(make):
        return lambda spark, sf_dir: make(turns_of(spark, sf_dir))

    hashed = lambda t: srt_lines(t).select("record_id", "n", F.md5("block").alias("block_md5"))
    return {
        "rttm_lines": run(lambda t: rttm_lines(t).select("record_id", "line")),
        "srt_lines": run(hashed),
        "label_lines": run(lambda t: label_lines(t).select("record_id", "line")),
        "report_json": run(reports),
        "text_reports": run(lambda t: text_reports(t, t.groupBy("record_id").agg(F.concat(F.lit("record_"), F.col("record_id").cast("string")).alias("name"), F.lit("en").alias("lang"), F.max(F.floor(F.col("end_us") / 1e6)).cast("double").alias("duration_s"))).select("record_id", F.md5("report").alias("report_md5"))),
    }


_CLOCK = "printf('%02d:%02d:%02d,%03d', {us} // 3600000000, {us} // 60000000 % 60, {us} // 1000000 % 60, {us} // 1000 % 1000)"
_MINUTES = "printf('%02d:%02d.%02d', {us} // 60000000, ({us} % 60000000 + 5000) // 10000 // 100, ({us} % 60000000 + 5000) // 10000 % 100)"
ORACLE_BODY = {
    "text_reports": f"""SELECT record_id, md5('Dosya: record_' || CAST(record_id AS VARCHAR) || chr(10) || 'Tespit Edilen Dil: en' || chr(10)
            || 'Konuşmacı Sayısı: ' || CAST(count(DISTINCT speaker_id) AS VARCHAR) || ' (' || array_to_string(list_sort(list(DISTINCT speaker_id)), ', ') || ')' || chr(10)
            || 'Toplam Süre: ' || CAST(max(end_us // 1000000) AS VARCHAR) || '.00 saniye' || chr(10) || repeat('=', 60) || chr(10) || chr(10)
            || string_agg('[' || {_MINUTES.format(us="start_us")} || ' - ' || {_MINUTES.format(us="end_us")} || '] ' || speaker_id || ':' || chr(10) || '  ' || text || chr(10) || chr(10), '' ORDER BY start_us, u_idx)) AS report_md5
        FROM utterances GROUP BY record_id""",
    "rttm_lines": "SELECT record_id, printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', CAST(record_id AS VARCHAR), start_us / 1e6, greatest(0.01, round((end_us - start_us) / 1e6, 3)), speaker_id) AS line FROM utterances",
    "label_lines": "SELECT record_id, printf('%.6f' || chr(9) || '%.6f' || chr(9) || '%s', start_us / 1e6, end_us / 1e6, speaker_id) AS line FROM utterances",
    "srt_lines": f"""SELECT record_id, n, md5(CAST(n AS VARCHAR) || chr(10) || {_CLOCK.format(us="start_us")} || ' --> ' || {_CLOCK.format(us="end_us")} || chr(10) || '[' || speaker_id || '] ' || text) AS block_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY start_us, u_idx) AS n FROM utterances) x""",
}
