"""What the operators of this subpackage share: tables, saved steps, memoised words, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import re
import sys
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed but can be seen at the same path.

    Texts are long: where the session leaves the rows of an Arrow batch at Spark's default, they become BATCH.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, with a local master alone, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    own = tempfile.mkdtemp(prefix="speechlake-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Saved:
    """A step written as Parquet in the shared folder: cuts lineage, survives lost executors."""

    opened: list[list] = []

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)
        for scope in Saved.opened:
            scope.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, most: int = 16 << 20, width: Column | None = None) -> DataFrame:
    """A saved table for the small side of a join: marked for broadcast if its values have at most so many bytes (width of a row), counted here."""
    width = sum((F.octet_length(c) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(0)) if width is None else width
    held = df.agg(F.sum(F.coalesce(width, F.lit(8)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


@contextlib.contextmanager
def steps() -> Iterator[list]:
    """Steps saved inside are dropped at the end, but for those taken out of the list: for callers that have written their result by then."""
    own: list[Saved] = []
    Saved.opened.append(own)
    try:
        yield own
    finally:
        Saved.opened.remove(own)
        for step in own:
            step.drop()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, n: int, total: int = 6_400, max_bytes: int = 64 << 20, values: int = 1_024) -> list:
    """Rows (doc_id, text, key): of each value at most n ids, smallest hashes first; of a repeated id the smallest text.

    labels (doc_id, key) may be a join with docs: ids are chosen without texts, and only the
    chosen ids' texts are read. The `values` most frequent values count. With v of them a value
    gets at most min(n, total // v) ids, one at least, and max_bytes // v bytes of whole texts,
    one text at least, so what the driver gets is bounded.

    Ids are chosen by a threshold on their hash that follows the value's number of rows;
    where repeated ids leave a value short the threshold is doubled.
    """
    spark = docs.sparkSession
    rows = labels.select("doc_id", key).where(f"{key} is not null and doc_id is not null")
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().orderBy(F.desc("count"), key).limit(values).collect()}
    if not counts:
        return []
    n = max(1, min(n, total // len(counts)))
    share = {v: min(1.0, (n + 6 * n**0.5) / c) for v, c in counts.items()}
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    own = Window.partitionBy(key).orderBy("place", "doc_id")
    while True:
        limits = F.broadcast(spark.createDataFrame(list(share.items()), rows.select(key, F.lit(0.0).alias("share")).schema))  # a row a value
        near = rows.withColumn("place", place).join(limits, key).where("place < share or share = 1.0").select("doc_id", key, "place").distinct()
        chosen = near.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n).select("doc_id", key, "place").collect()
        found = Counter(r[key] for r in chosen)
        short = [v for v, s in share.items() if s < 1 and found[v] < n]
        if not short:
            break
        share |= {v: min(1.0, 2 * share[v]) for v in short}
    picked = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], near.schema))  # n ids a value
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", key, "place").agg(F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    kept = texts.withColumn("bytes", so_far).withColumn("rank", F.row_number().over(own)).where((F.col("bytes") <= max_bytes // len(counts)) | (F.col("rank") == 1))
    return sorted(kept.select("doc_id", "text", key).collect(), key=lambda r: (r[key], r.doc_id))


class Memo(dict):
    """A dictionary that computes what it lacks, bounded by two generations.

    When the young generation is full it becomes the old one; entries of the old one that
    are asked for again move over. So frequent keys stay and memory is bounded by 2 * size.
    """

    def __init__(self, make: Callable, size: int = 200_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def worker_state(key, make: Callable):
    """The object of this key in a Python worker process, kept from task to task until another key is asked for: one at a time."""
    kept = sys.__dict__.setdefault("_speechlake_state", {})
    if key not in kept:
        if kept:
            kept.clear()
            give_back()
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def sliced(column: pa.Array, rows: int = 128) -> Iterator[list]:
    """The column's values, a few rows at a time, so that a batch of long texts isn't held as Python objects."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def each(column: pa.Array, rows: int = 128) -> Iterator:
    return itertools.chain.from_iterable(sliced(column, rows))


def keep_rows(docs: DataFrame, state: tuple, make: Callable, text: str = "text") -> DataFrame:
    """The rows whose text passes make()(text), with all their columns; make() runs once a worker.

    Only the texts go to the workers, and only a flag comes back.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = worker_state(state, make)
        for b in batches:
            yield pa.array([test(t) for t in each(b)], pa.bool_())

    return docs.where(F.arrow_udf(run, "boolean")(F.col(f"`{text}`")))


def merge_pairs(parts: list[str], rank, none: float) -> list[str]:
    """Byte-pair merges: again and again the adjacent pair of highest rank(left, right), leftmost on ties, until all are `none`."""
    ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
    while ranks:
        best = max(ranks)
        if best == none:
            break
        i = ranks.index(best)
        parts[i] += parts.pop(i + 1)
        ranks.pop(i)
        if i:
            ranks[i - 1] = rank(parts[i - 1], parts[i])
        if i < len(ranks):
            ranks[i] = rank(parts[i], parts[i + 1])
    return parts


class Cover:
    """What byte-pair merges make of a string, found from the left.

    Merges are local: a sequence of tokens is the result of merging exactly if every token
    is what its own characters merge to and every two neighbours are what the two together
    merge to. So tokens are tried longest first, checked against the token before, and
    taken back at a dead end. `apart` splits a string in the symbols that merging starts
    from, `rank` gives a pair's priority.
    """

    def __init__(self, tokens, apart: Callable, rank: Callable, none: float, cache: int = 200_000):
        merged = lambda x: merge_pairs(apart(x), rank, none)
        self.tokens = {t for t in tokens if merged(t) == [t]}
        self.sizes: dict[str, list[int]] = {}
        for t in self.tokens:
            self.sizes.setdefault(t[:3], []).append(len(t))
        for t in list(self.sizes):  # shorter tokens are tried after the longer ones that start alike
            self.sizes[t] = sorted({*self.sizes[t], *(n for n in (1, 2) if t[:n] in self.tokens), 1}, reverse=True)
        self.fits = Memo(lambda pair: merged(pair[0] + pair[1]) == list(pair), cache)

    def __call__(self, text: str) -> list[str]:
        sizes, fits, n = self.sizes, self.fits, len(text)
        out, dead, at, last, shorter = [], set(), 0, "", 0
        while at < n:
            head = text[at : at + 3]
            for k in sizes.get(head) or self._short(head):
                t = text[at : at + k]
                if (not shorter or k < shorter) and (k < 4 or t in self.tokens) and len(t) == k and (not last or fits[last, t]) and (not dead or (at, k, len(last)) not in dead):
                    out.append(t)
                    at, last, shorter = at + k, t, 0
                    break
            else:
                t = out.pop()
                last, at, shorter = out[-1] if out else "", at - len(t), len(t)
                dead.add((at, len(t), len(last)))
        return out

    def _short(self, head: str) -> list[int]:
        found = [k for k in range(len(head), 0, -1) if k == 1 or head[:k] in self.tokens]
        if len(self.sizes) < 1_000_000:
            self.sizes[head] = found
        return found


def connected_components(edges: DataFrame, rounds: int = 100) -> Saved:
    """(node, component): the smallest node reachable, for every node with an edge.

    edges: columns a, b (long), each link once in either order. Every round hooks the label
    of each node, and the label of that label, to the smallest label next to it, then
    shortens chains by one jump. Label messages are combined map-side, so a hub costs one
    row per task; the joins are between exchanged tables, which adaptive execution can
    split when one label is hot. Steps are written to the shared folder.
    """
    both = Saved(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = Saved(both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        old = labels.df.select("node", "label")
        seen = both.df.join(old.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("low"))
        hooks = (
            old.join(seen.withColumnRenamed("a", "node"), "node")
            .where("low < label")
            .select(F.explode(F.array("node", "label")).alias("node"), "low")
            .groupBy("node")
            .agg(F.min("low").alias("low"))
        )
        hooked = Saved(
            old.join(hooks, "node", "left").select("node", "label", F.coalesce(F.least("label", "low"), "label").alias("next")), "hooked"
        )
        up = hooked.df.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumped = hooked.df.join(up, "next", "left").select("node", F.coalesce(F.least("next", "far"), "next").alias("label"), F.col("label").alias("was"))
        new = Saved(jumped, "labels")
        labels.drop()
        hooked.drop()
        labels = new
        if not labels.df.where("label < was").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    both.drop()
    return labels
