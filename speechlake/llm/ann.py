"""Approximate nearest neighbours by multi-index hashing.

Binary codes come from a rotation learned on a bounded sample (iterative quantisation). A
code is split in substrings, each with a table of its own. Codes within a Hamming radius R of
a query agree with it in some substring up to floor(R / substrings) bits, so probing the
values that near in every table retrieves every such code; candidates within R are then
ranked by their floats. R is the distance that TARGET of the true neighbours kept in the
sample; neighbours in the whole table are nearer, so recall there is higher. How long the
substrings are follows from R and the number of rows: it decides on work, never on results.

Every row stands once in each table. A table's values are dealt to slots, a query goes to the
slots of the values that it probes, and a task looks them up in the index of one slot and
passes on at most k rows a query. Slots of more than ROWS rows (one value may be hot) are
split, as are more than QUERIES queries of one slot. A pair that several tables give is ranked
where the first of them does. Queries that find fewer than k rows are asked again with twice
the radius. Nothing but the sample and the rotation reaches the driver.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows of null vec_id; a query's own row is left
out, other rows of its id are not, and rows that share an id are candidates and queries each;
ties go to the smaller id; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, TARGET = 2000, 0.99
ROWS, QUERIES = 8192, 4096
#: Bytes that a substring may have, and the most values that a query may probe in one table for it.
WIDTHS, MOST_PROBES = (1, 2, 3, 4), 4096
BITS_OF = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Codes:
    """A learned rotation and the radius that goes with it."""

    def __init__(self, x: np.ndarray, k: int, rounds: int = 30):
        rng = np.random.default_rng(7)
        self.mean = x.mean(axis=0)
        unit = self._unit(x)
        d = x.shape[1]
        bits = self.bits = -(-d // 8) * 8
        # Columns beyond the dimension are further directions of the same space.
        self.rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0][:d]
        for _ in range(rounds):
            b = np.where(unit @ self.rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(unit.T @ b, full_matrices=False)
            self.rotation = u @ vt
        codes = self(x)
        self.radius = bits
        if len(x) > k:
            seen = []
            for i in range(min(len(x), 300)):
                dist = ((x - x[i]) ** 2).sum(axis=1)
                dist[i] = np.inf
                near = np.argpartition(dist, k - 1)[:k]
                seen += BITS_OF[codes[near] ^ codes[i]].sum(axis=1, dtype=np.int64).tolist()
            self.radius = int(np.quantile(seen, TARGET, method="higher"))

    def _unit(self, x: np.ndarray) -> np.ndarray:
        c = x - self.mean
        return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of bytes: one substring each."""
        return np.packbits(self._unit(x) @ self.rotation >= 0, axis=1)


class Split:
    """How codes are cut: the tables' bytes, and how many bits a probe may be off in each."""

    def __init__(self, code_bytes: int, radius: int, rows: int):
        def split(width: int) -> tuple[list[tuple[int, int]], int]:
            parts = [(at, min(width, code_bytes - at)) for at in range(0, code_bytes, width)]
            return parts, radius // len(parts)

        def near(width: int) -> int:
            off = split(width)[1]
            return sum(math.comb(8 * width, i) for i in range(min(off, 8 * width) + 1))

        def cost(width: int) -> float:  # of a query: probes, and rows that they give
            return len(split(width)[0]) * near(width) * (1 + rows / 2.0 ** (8 * width))

        self.radius = radius
        if radius >= 8 * code_bytes:  # one table gives all rows
            self.parts, self.off = [(0, 1)], 8
        else:
            self.parts, self.off = split(min((w for w in WIDTHS if w == 1 or near(w) <= MOST_PROBES), key=cost))
        self.masks = {n: [sum(1 << b for b in c) for i in range(min(self.off, 8 * n) + 1) for c in itertools.combinations(range(8 * n), i)] for n in {n for _, n in self.parts}}

    def value(self, t: int) -> Column:
        at, n = self.parts[t]
        return F.conv(F.hex(F.substring("code", at + 1, n)), 16, 10).cast("long")


def found_in(table: int, split: Split, k: int, queries: pa.Table, rows: pa.Table) -> pa.Table:
    """At most k rows for each query, of those that this table is the first to give."""
    out = ([], [], [], [])
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if len(queries) and len(rows):
        matrix = lambda t, name, n, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(len(t), n)
        width = len(rows["code"][0].as_py())
        codes, asked = matrix(rows, "code", width, np.uint8), matrix(queries, "code", width, np.uint8)
        dims = len(rows["v"][0])
        x, q = (t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for t in (rows, queries))
        at, n = split.parts[table]
        weights = 256 ** np.arange(n - 1, -1, -1, dtype=np.int64)
        values = codes[:, at : at + n] @ weights
        order = np.argsort(values, kind="stable")
        values = values[order]
        masks, starts = np.array(split.masks[n], np.int64), np.array([p for p, _ in split.parts])
        ids, uids = rows["vec_id"].to_numpy(), rows["uid"].to_numpy()
        every = split.radius >= 8 * width
        for uid, qid, vector, code in zip(queries["uid"].to_numpy(), queries["vec_id"].to_numpy(), q, asked):
            if every:
                near = np.flatnonzero(uids != uid)
            else:
                probes = (code[at : at + n] @ weights) ^ masks
                low, high = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
                many = high - low
                near = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                off = BITS_OF[codes[near] ^ code]
                by_table = np.add.reduceat(off, starts, axis=1, dtype=np.int64)
                near = near[(by_table.sum(axis=1) <= split.radius) & ~(by_table[:, :table] <= split.off).any(axis=1) & (uids[near] != uid)]
            score = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
            if len(near) > 4 * k:  # all that can be among the k, ties too
                kept = score <= np.partition(score, k - 1)[k - 1]
                near, score = near[kept], score[kept]
            best = np.lexsort((ids[near], score))[:k]
            for o, part in zip(out, (np.full(len(best), uid), np.full(len(best), qid), ids[near][best], score[best])):
                o.append(part)
    return pa.table([pa.array(np.concatenate(o) if o else [], f.type) for o, f in zip(out, schema)], schema)


def usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def with_codes(rows: DataFrame, codes) -> DataFrame:
    """Adds code, a row's binary code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes.value(x)], pa.binary())], [*b.schema.names, "code"])

    return rows.mapInArrow(run, "uid long, vec_id long, v array<double>, q boolean, code binary")


def nearest_within(rows: DataFrame, queries: DataFrame, n: int, split: Split, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): what each table has for each query."""
    slots = max(1, n // ROWS)
    tables = range(len(split.parts))
    slot = lambda value: F.pmod(F.xxhash64(value), F.lit(slots)).cast("int")
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), slot(split.value(t)).alias("slot")) for t in tables])).alias("p")
    right = rows.select("uid", "vec_id", "v", "code", one).select("uid", "vec_id", "v", "code", "p.*")

    def probed(t: int) -> Column:
        masks = split.masks[split.parts[t][1]]
        if slots == 1:
            return F.array(F.lit(0))
        return F.array_distinct(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: slot(split.value(t).bitwiseXOR(m))))

    def places(t: int) -> Column:
        return F.transform(probed(t), lambda s: F.struct(F.lit(t).alias("t"), s.alias("slot")))

    asked = F.explode(F.flatten(F.array(*map(places, tables)))).alias("p")
    left = queries.select("uid", "vec_id", "v", "code", asked).select("uid", "vec_id", "v", "code", "p.*")
    # How often a slot's rows and its queries are split: every part of the ones meets every part of the others.
    cuts = lambda df, most, name: df.groupBy("t", "slot").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = common.Saved(cuts(right.select("t", "slot"), ROWS, "parts").join(cuts(left.select("t", "slot"), QUERIES, "turns"), ["t", "slot"]), "slots").df
    dealt = lambda df, own, many, other, all_: df.join(sizes, ["t", "slot"]).select(
        "uid", "vec_id", "v", "code", "t", "slot", F.pmod(F.xxhash64("uid"), F.col(many)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(all_) - 1)).alias(other)
    )
    left, right = dealt(left, "turn", "turns", "part", "parts"), dealt(right, "part", "parts", "turn", "turns")
    keys = ["t", "slot", "part", "turn"]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return found_in(key[0].as_py(), split, k, a, b)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).where("vec_id is not null")
    top = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(usable(F.col("v"), top.n if top else 0))
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    if not total or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    codes = spark.sparkContext.broadcast(Codes(np.array([r.v for r in sample], float), k))
    coded = common.Saved(with_codes(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v", F.coalesce("q", F.lit(False)).alias("q")), codes), "vectors")
    queries, radius, bits = coded.df.where("q"), codes.value.radius, codes.value.bits
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = None
    while True:
        near = nearest_within(coded.df, queries, total, Split(bits // 8, radius, total), k)
        ranked = common.Saved(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
        done = ranked.df
        if radius < bits and k < total:
            full = ranked.df.where(F.col("rank") == min(k, total - 1)).select("query")
            done = ranked.df.join(full, "query", "left_semi")
            queries = queries.join(full.withColumnRenamed("query", "uid"), "uid", "left_anti")
        found = done if found is None else found.unionByName(done)
        if radius >= bits or k >= total or not queries.limit(1).count():
            break
        radius = min(bits, 2 * radius)
    return found.select("query_id", "rank", "vec_id", "score")
