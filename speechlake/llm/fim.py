"""Fill-in-the-middle transformation of documents, by SQL over Arrow batches inside mapInArrow.

A text is cut into units (runs of A-Z and a-z, every other code point alone). Two of four
numbers drawn from the sha256 of the salt and the id cut the units in prefix, middle and suffix;
the third decides whether the text stays plain, the fourth which of the two orders is
written. Each batch is registered as a table and transformed by one SQL statement; no row
becomes a Python object. Batches are dealt on in slices of bounded bytes, since the list
of a long text's units takes some 20 times its bytes.

Defined results: null text counts as empty and gives form plain with an empty output; texts that hold
one of the sentinels stay plain, so that an output can be read back; a null id is drawn as
an empty one; repeated rows come back each, alike; extra columns are left out; an empty table gives
an empty result. `restore` reads any output back; outputs that are no such form give null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The sentinels before prefix, suffix and middle, and what a unit is.
PREFIX, SUFFIX, MIDDLE, UNIT = "<P>", "<S>", "<M>", "[A-Za-z]+|[^A-Za-z]"
#: Bytes of text that one statement is given, one text at least.
SLICE = 1 << 20
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

#: h1 to h4 are the salted digest's first groups of eight digits; a <= b are the two cuts.
TRANSFORM = f"""
    WITH drawn AS (
        SELECT place, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
               sha256($salt || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
        FROM batch
    ), numbers AS (
        SELECT place, doc_id, text, units, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(digest, CAST(i AS BIGINT), 8) AS BIGINT)) AS h
        FROM drawn
    ), cuts AS (
        SELECT place, doc_id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
               CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= $share THEN 'plain'
                    WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
        FROM numbers
    ), parts AS (
        SELECT place, doc_id, text, n, form,
               CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
               CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle,
               CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix
        FROM cuts
    )
    SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
           CASE form WHEN 'plain' THEN text
                     WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                     ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
    FROM parts ORDER BY place"""

#: A sentinel stands once in an output that isn't plain, so its halves are what lies before and after it.
RESTORE = f"""
    WITH halves AS (
        SELECT place, form, output, string_split(output, '{MIDDLE}') AS ends,
               string_split(string_split(output, '{MIDDLE}')[1], CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS pair
        FROM batch
    )
    SELECT CASE WHEN form = 'plain' THEN output
                WHEN len(ends) <> 2 OR len(pair) <> 2 THEN NULL
                WHEN form = 'psm' AND starts_with(output, '{PREFIX}') THEN substr(pair[1], {len(PREFIX) + 1}) || ends[2] || pair[2]
                WHEN form = 'spm' AND starts_with(output, '{SUFFIX}') THEN pair[2] || ends[2] || substr(pair[1], {len(SUFFIX) + 1}) END AS text
    FROM halves ORDER BY place"""


def slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that have at most SLICE bytes in column `texts`, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def connect():
    import duckdb

    return duckdb.connect(config={"threads": 1, "preserve_insertion_order": True})


def answers(con, batch: pa.RecordBatch, sql: str, given: dict) -> Iterator[pa.RecordBatch]:
    """What the statement gives for the batch's rows, in their order."""
    numbered = pa.Table.from_batches([batch.append_column("place", pa.array(np.arange(batch.num_rows)))])
    con.register("batch", numbered)
    found = con.sql(sql, params=given).to_arrow_table()
    con.unregister("batch")
    yield from found.combine_chunks().to_batches()


def transform(docs: DataFrame, salt: str = "1:", share: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text).

    share: per cent of texts that are rearranged; spm: per cent of those with the suffix first.
    """
    common.ship(docs.sparkSession)
    given = {"salt": salt, "share": share, "spm": spm}
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            for piece in slices(b, 1):
                for found in answers(con, piece, TRANSFORM, given):
                    yield found.select(names)
        con.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def restore(rows: DataFrame, name: str = "text") -> DataFrame:
    """rows (form, output and any others) with the exact text that was transformed, in a column of this name."""
    common.ship(rows.sparkSession)
    form, output = rows.columns.index("form"), rows.columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            for piece in slices(b, output):
                both = pa.RecordBatch.from_arrays([piece.column(form), piece.column(output)], ["form", "output"])
                for found in answers(con, both, RESTORE, {}):
                    yield pa.RecordBatch.from_arrays([*piece.columns, found.column(0)], [*piece.schema.names, name])
        con.close()

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def digests(docs: DataFrame, salt: str = "1:", share: int = 90, spm: int = 20) -> DataFrame:
    """The transformed documents and their restored texts as digests: output_sha256 and restored_sha256, lowercase hex.

    Both statements run on a slice before the next is read, so that no output leaves its task.
    """
    common.ship(docs.sparkSession)
    given = {"salt": salt, "share": share, "spm": spm}
    kept = [c.split()[0] for c in OUT.split(", ")][:-1]
    sums = "SELECT sha256(t.output) AS output_sha256, sha256(r.text) AS restored_sha256 FROM t POSITIONAL JOIN r"
    schema = OUT.rsplit(", ", 1)[0] + ", output_sha256 string, restored_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            for piece in slices(b, 1):
                for t in answers(con, piece, TRANSFORM, given):
                    both = pa.RecordBatch.from_arrays([t.column("form"), t.column("output")], ["form", "output"])
                    for r in answers(con, both, RESTORE, {}):
                        con.register("t", pa.Table.from_batches([t.select(["output"])]))
                        con.register("r", pa.Table.from_batches([r]))
                        found = con.sql(sums).to_arrow_table().combine_chunks().to_batches()[0]
                        con.unregister("t")
                        con.unregister("r")
                        yield pa.RecordBatch.from_arrays([*(t.column(c) for c in kept), *found.columns], [*kept, *found.schema.names])
        con.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
