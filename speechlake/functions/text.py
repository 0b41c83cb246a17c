"""Text functions on columns: repeats, punctuation, file names, messages, urls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.fixtures import view

BLANKS = "[ \\t\\r\\n]+"
#: Types of errors, and parts of messages, that no further attempt mends.
PERMANENT_TYPES = ["PermanentJobError", "ValueError", "TypeError", "FileNotFoundError"]
PERMANENT = [
    "corrupt",
    "unsupported format",
    "invalid audio",
    "cannot decode",
    "header corrupt",
    "not a valid audio",
    "bozuk",
    "desteklenmeyen",
    "file not found",
    "no such file",
    "bulunamadı",
]


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _told(parts: Column) -> Column:
    """Each part with itself, the two before and the one after in lower case: arrays side by side, so that a pass over them is linear."""
    low = F.transform(parts, F.lower)
    none = F.array(F.lit(None).cast("string"))
    return F.arrays_zip(parts.alias("part"), low.alias("own"), F.concat(none, low).alias("one"), F.concat(none, none, low).alias("two"), F.slice(low, F.lit(2), F.size(low)).alias("next"))


def _kept(parts: Column, gone) -> Column:
    return F.transform(F.filter(_told(parts), lambda z: z.part.isNotNull() & ~F.coalesce(gone(z), F.lit(False))), lambda z: z.part)


def collapse_runs(parts: Column) -> Column:
    """Runs of three and more equal parts, letter case aside, become their first; runs of two stay."""
    return _kept(parts, lambda z: (z.own == z.one) & (F.coalesce(z.own == z.two, F.lit(False)) | F.coalesce(z.own == z.next, F.lit(False))))


def drop_third_repeats(words: Column) -> Column:
    """A word equal to the two kept before it goes: runs are cut to two."""
    return _kept(words, lambda z: (z.own == z.one) & (z.own == z.two))


def collapse_words(text: Column) -> Column:
    return F.array_join(collapse_runs(tokens(text)), " ")


def collapse_commas(text: Column) -> Column:
    return F.array_join(collapse_runs(F.transform(F.split(text, ","), lambda part: F.trim(part))), ", ")


def close_punctuation(text: Column) -> Column:
    """No white space before ? ! , . : and ;."""
    return F.regexp_replace(text, r"[ \t\r\n]+([?!,.:;])", "$1")


def collapse_phrases(text: Column) -> Column:
    """Two words said three times and more in a row are kept once, from the left; a greedy scan that expressions cannot state.

    Texts of fewer than six words stay as they are. The scan is nested so that workers need not import this package.
    """

    def scan(text: str | None) -> str | None:
        words = (text or "").split()
        if len(words) < 6:
            return text
        low, out, i = [w.lower() for w in words], [], 0
        while i < len(words):
            times = 1
            while i + 2 * times + 1 < len(words) and low[i + 2 * times : i + 2 * times + 2] == low[i : i + 2]:
                times += 1
            out += words[i : i + (2 if times >= 3 else 1)]
            i += 2 * times if times >= 3 else 1
        return " ".join(out)

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(scan)

    return F.pandas_udf(batch, StringType())(text)


def only_punctuation(text: Column) -> Column:
    """Nothing but punctuation and white space, blank text too."""
    return F.length(F.regexp_replace(text, r"[\s?.!,:;…\-–]+", "")) == 0


def ends_punctuated(text: Column) -> Column:
    return text.rlike(r"[.?!:;…]\s*$")


def safe_stem(name: Column, fallback: Column) -> Column:
    """A file stem of letters, digits, _ and -, or the fallback."""
    own = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\-]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(own, F.lit("")), fallback)


#: What stands for a path, the patterns of paths on drives and under folders, and the name of an upload without one, from the reference behaviour.
MASK, DRIVE, FOLDERS, UPLOAD = "[FILE_PATH]", r"[A-Za-z]:\\[^\s:]+", r"/(?:[^\s:]+/)+[^\s:]+", "upload.bin"


def mask_paths(message: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(message, DRIVE, MASK), FOLDERS, MASK)


def error_message(kind: Column, message: Column) -> Column:
    """What a user is told of an error: its type, and its message with paths masked (null: empty)."""
    return F.concat(F.coalesce(kind, F.lit("")), F.lit(": "), mask_paths(F.coalesce(message, F.lit(""))))


def safe_file_name(name: Column) -> Column:
    """The last part of a path without white space around it, at most 255 characters; UPLOAD for null, an empty one, . and ..."""
    base = F.regexp_replace(F.regexp_replace(name, r"(?s)^.*[/\\]", ""), r"^\s+|\s+$", "")
    return F.when(~base.isin("", ".", ".."), F.substring(base, 1, 255)).otherwise(UPLOAD)


def extension(name: Column) -> Column:
    """.wav and the like in lower case: a point and 1 to 8 letters or digits; else null."""
    found = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})$", 1))
    return F.nullif(found, F.lit(""))


def first_integer(name: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def parse_number(text: Column, kind: str = "double") -> Column:
    """Blank, none and null are null, as is what is no number."""
    clean = F.trim(text)
    return F.when(~F.lower(clean).isin("", "none", "null"), clean).try_cast(kind)


def clock(us: Column, comma: bool = True) -> Column:
    """HH:MM:SS,mmm of microseconds."""
    ms = F.round(us / 1000).cast("long")
    mark = "," if comma else "."
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


#: What encloses a list in an answer, from the reference behaviour.
FENCES = (r"(?s)```json(.*?)(?:```|\z)", r"(?s)```(.*?)(?:```|\z)")


def speaker_map(answer: Column) -> Column:
    """Of a model's answer the map idx -> speaker: from the JSON list in the first fence, or else in the whole text.

    Items that are no objects, or lack idx or speaker, are left out; of several with one idx the
    last counts. No list, bad JSON or an idx that is no number: an empty map, as for null.
    """
    body = F.when(F.contains(answer, F.lit("```json")), F.regexp_extract(answer, FENCES[0], 1)).when(F.contains(answer, F.lit("```")), F.regexp_extract(answer, FENCES[1], 1)).otherwise(answer)
    items = F.from_json(F.regexp_extract(body, r"(?s)\[.*\]", 0), "array<string>")
    pairs = F.transform(items, lambda x: F.struct(F.get_json_object(x, "$.idx").alias("idx"), F.trim(F.get_json_object(x, "$.speaker")).alias("speaker")))
    whole = F.transform(F.filter(pairs, lambda p: p.idx.isNotNull() & p.speaker.isNotNull()), lambda p: F.struct(p.idx.try_cast("double").cast("int").alias("idx"), p.speaker.alias("speaker")))
    good = F.reverse(F.when(F.forall(whole, lambda p: p.idx.isNotNull()), whole))
    ids = F.transform(good, lambda p: p.idx)
    once = F.array_distinct(ids)
    found = F.map_from_arrays(once, F.transform(once, lambda i: F.get(good, (F.array_position(ids, i) - 1).cast("int")).speaker))
    return F.coalesce(found, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")))


def is_permanent(kind: Column, message: Column) -> Column:
    """By the error's type, else by its message; errors said to be transient, and all unknown ones, are not."""
    told = F.lower(message).rlike("|".join(PERMANENT))
    return F.when(kind == "TransientJobError", False).otherwise(F.coalesce(kind.isin(PERMANENT_TYPES), F.lit(False)) | F.coalesce(told, F.lit(False)))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")


def _digest(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).select("conv_id", "turn", F.md5(make(F.col("text"))).alias("text_md5"))

    return run


def word_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens(F.col("text")).alias("words"))
    return docs.select("doc_id", F.size("words").alias("n_before"), F.size(collapse_runs(F.col("words"))).alias("n_after"))


def repeat_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens(F.col("text")).alias("words"))
    return docs.select("doc_id", F.size(drop_third_repeats(F.col("words"))).alias("n_kept"))


def phrase_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(collapse_phrases(F.col("text"))).alias("text_md5"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "pages")
    pages = spark.table("pages")
    base = safe_file_name(F.col("url"))
    return pages.select("page_id", base.alias("base"), extension(F.col("url")).alias("ext"), safe_stem(F.regexp_replace("url", "[^A-Za-z0-9]", "_"), F.lit("sample")).alias("stem"), mask_paths(F.col("url")).alias("masked"))


_LOW = "list_transform(p, lambda x: lower(x))"
_RUNS = f"""list_filter(p, lambda x, i: NOT coalesce(i > 1 AND ({_LOW})[i] = ({_LOW})[i - 1]
            AND ((i > 2 AND ({_LOW})[i] = ({_LOW})[i - 2]) OR (i < len(p) AND ({_LOW})[i] = ({_LOW})[i + 1])), false))"""
_WORDS = "list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')"
QUERIES = {
    "punct_space": _digest(close_punctuation),
    "comma_collapse": _digest(collapse_commas),
    "word_run_collapse": word_run_collapse,
    "repeat_filter": repeat_filter,
    "phrase_collapse": phrase_collapse,
    "file_names": file_names,
}
ORACLE_SQL = {
    "punct_space": "SELECT conv_id, turn, md5(regexp_replace(text, '[ \\t\\r\\n]+([?!,.:;])', '\\1', 'g')) AS text_md5 FROM conversations",
    "comma_collapse": f"SELECT conv_id, turn, md5(array_to_string({_RUNS}, ', ')) AS text_md5 FROM (SELECT conv_id, turn, list_transform(string_split(text, ','), lambda y: trim(y)) AS p FROM conversations) t",
    "word_run_collapse": """WITH w AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i, len(p) AS n FROM (SELECT doc_id, """ + _WORDS + """ AS p FROM documents) t), f AS (
            SELECT *, coalesce(lower(x) = lag(lower(x)) OVER o AND (coalesce(lower(x) = lag(lower(x), 2) OVER o, false) OR coalesce(lower(x) = lead(lower(x)) OVER o, false)), false) AS gone
            FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
        SELECT d.doc_id, coalesce(max(n), 0) AS n_before, count(f.doc_id) FILTER (NOT gone) AS n_after FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
    "repeat_filter": """WITH w AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT doc_id, """ + _WORDS + """ AS p FROM documents) t), f AS (
            SELECT *, coalesce(lower(x) = lag(lower(x)) OVER o AND lower(x) = lag(lower(x), 2) OVER o, false) AS gone FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
        SELECT d.doc_id, count(f.doc_id) FILTER (NOT gone) AS n_kept FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
    # The last part by splitting, the stem by trimming.
    "file_names": """WITH b AS (SELECT page_id, url, trim(list_last(string_split_regex(url, '[/\\\\]')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS last FROM pages)
        SELECT page_id, CASE WHEN coalesce(last, '') IN ('', '.', '..') THEN 'upload.bin' ELSE left(last, 255) END AS base, nullif(lower(regexp_extract(url, '[.][a-zA-Z0-9]{1,8}$')), '') AS ext,
               coalesce(nullif(trim(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), '_'), ''), 'sample') AS stem,
               regexp_replace(regexp_replace(url, '[a-zA-Z]:\\\\[^[:space:]:]+', '[FILE_PATH]', 'g'), '/([^[:space:]:]+/)+[^[:space:]:]+', '[FILE_PATH]', 'g') AS masked FROM b""",
}
