"""URL filters: a blocked Bloom filter before an exact hash join.

A listed entry is a canonical host and path; it fits its host and all subdomains where the
url's path starts with its path, and the longest fitting entry decides. A url's possible
entries are its host's suffixes joined with its path's prefixes of listed lengths. The filter
(one 64-bit word a block, so one look-up a key) passes the few that may be listed, and a join
on the whole key removes what it passed wrongly. A url that nothing fits is allowed.

Defined results: null, or no `://`: host and path empty, allowed; repeated rows are judged
each; extra columns are left out; an empty list allows everything.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The filter never has more words than this (8 MB): a longer list passes more to the join, and the result is the same.
MAX_WORDS, WORDS_A_KEY, PROBES = 1 << 20, 0.25, 5
REST = re.compile(r"([^/?#]*)([^?#]*)", re.S)
UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = REST.match(url, at + 3).groups()
    return host.translate(UPPER), path


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    parts = host.split(".") if host else []
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [".".join(parts[i:]) + s for i in range(len(parts)) for s in starts]


def word_and_mask(key: str, words: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key.encode())
    mask = 0
    for i in range(PROBES):
        mask |= 1 << (h >> 6 * i & 63)
    return (h >> 32) % words, mask


def build_filter(listed: DataFrame) -> np.ndarray:
    """The filter's words; made on the executors, each word once to the driver."""
    n = min(MAX_WORDS, max(64, int(listed.count() * WORDS_A_KEY) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [word_and_mask(k, n) for k in b.column(0).to_pylist()]
            masks = np.array([m for _, m in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array(masks)], ["word", "mask"])

    words = np.zeros(n, np.uint64)
    for word, mask in listed.select("key").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask")).collect():
        words[word] = mask & (1 << 64) - 1
    return words


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url), by listed (host, path, verdict)."""
    spark = pages.sparkSession
    common.ship(spark)
    listed = listed.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").dropDuplicates(["key"])
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())  # at most as many as a path has characters
    run_id, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((build_filter(listed), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = common.worker_state(("urls", run_id), lambda: ([int(w) for w in sent.value[0]], sent.value[1]))
        memo = common.Memo(lambda key: words[(x := word_and_mask(key, len(words)))[0]] & x[1] == x[1], 50_000)
        for b in batches:
            split = [split_url(u) for u in b.column(2).to_pylist()]
            hits = [[k for k in candidates(h, p, lengths) if memo[k]] for h, p in split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(hits, pa.list_(pa.string()))],
                ["row", "page_id", "host", "path", "hits"],
            )

    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url")
    seen = common.Saved(source.mapInArrow(run, "row long, page_id long, host string, path string, hits array<string>"), "urls")
    fits = (
        seen.df.select("row", F.explode("hits").alias("key"))
        .join(listed, "key")
        .groupBy("row")
        .agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    )
    return seen.df.join(fits, "row", "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )
