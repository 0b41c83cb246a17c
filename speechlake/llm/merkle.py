"""A Merkle manifest of a dataset: leaves, trees of fixed arity per group, one root, and a proof per row.

A leaf is the SHA-256 of a row's fields. Leaves of a group, in order, are hashed in runs of
ARITY up to the group's subroot; subroots in the groups' order likewise up to the root.

Ascent: every node is sent, with its index, to the block of BLOCK leaves of its stratum it
belongs to (combineByKey). A block's combiner holds partial parents only: when a parent
has as many children as the size of its tree says, its digest replaces them and is itself
sent to the next parent, so that a run of neighbours in one task is one digest before it
is shuffled. What comes out of a block is the digest of its top, a leaf of the next
stratum; only unfinished frontiers and tops reshuffle. Descent: each block meets the path
of its top over the reverse link (block to parent and place) and gives every leaf its
siblings, level by level. Blocks are bounded, whatever the size of a group.

Defined results: null fields count as `-`; null ids come first and are not tampered with;
rows that share an id stand in the order of their leaves; equal rows are leaves of their
own; null is a group of its own, before all others; a group of one row has its leaf as
subroot, a dataset of one group its subroot as root; an empty table gives an empty result;
extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node; the fields of a leaf in their order.
ARITY, FIELDS = 8, ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block, and the leaves it has at most.
LEVELS = 3
BLOCK = ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(parts: list[bytes]) -> bytes:
    """SHA-256 of the digests' hex texts, one after another."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def leaf(**changed: Column) -> Column:
    """The digest (binary) of a row's fields, some of them given: `-` for null, else bytes, colon, value."""
    values = [changed.get(f, F.col(f)).cast("string") for f in FIELDS]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256))


def placed(rows: DataFrame, *order: str) -> common.Saved:
    """rows (tree string, ...) with at (long): the place in their tree by these columns, and n (long), the tree's size.

    Sorted by ranges over all trees, so that a large tree is many tasks; a range's rows of a tree
    are numbered from the sum of the ranges before. The last column of `order` has to be
    unique where a tree may hold many equal rows, since a range doesn't end between equals.
    """
    keys = ["tree", *order]
    held = common.Saved(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "sorted"
    )
    own = Window.partitionBy("tree")
    runs = held.df.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))  # a row per tree and range
    starts = runs.select("tree", "part", F.sum("rows").over(own).alias("n"), (F.sum("rows").over(own.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"))
    starts = common.Saved(starts, "starts")
    out = common.Saved(held.df.join(common.if_small(starts.df), ["tree", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift"), "placed")
    held.drop()
    starts.drop()
    return out


def level_sizes(n: int, levels: int = LEVELS) -> list[int]:
    """Nodes on each level of a stratum whose leaves are n, up to `levels` levels; a tree that is down to one node grows no further."""
    out = [n]
    while len(out) <= levels and out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Partial:
    """Partial parents of one block: by (level, index) of a parent the digests of its children met so far, by index.

    `top` is the digest of the block once all of it is met. What `add` is told may come in any order.
    """

    def __init__(self, n: int):
        self.sizes, self.open, self.top = level_sizes(n), {}, None

    def add(self, level: int, index: int, digest: bytes) -> Partial:
        while level + 1 < len(self.sizes):
            parent = (level + 1, index // ARITY)
            met = self.open.setdefault(parent, {})
            met[index] = digest
            if len(met) < min(ARITY, self.sizes[level] - ARITY * parent[1]):
                return self
            digest = hashed([met[i] for i in sorted(met)])
            del self.open[parent]
            level, index = parent
        self.top = digest
        return self

    def join(self, other: Partial) -> Partial:
        for (level, _), met in other.open.items():
            for index, digest in met.items():
                self.add(level - 1, index, digest)
        self.top = self.top or other.top
        return self

    def __reduce__(self):
        return _partial, (self.sizes[0], self.open, self.top)


def _partial(n: int, open_: dict, top: bytes | None) -> Partial:
    out = Partial(n)
    out.open, out.top = open_, top
    return out


def ascend(nodes: DataFrame, parts: int) -> DataFrame:
    """nodes (tree, at, n, digest) to the tops of their blocks: tree, at (the block's number), n (blocks of the tree), digest."""

    def keyed(r) -> tuple:
        return (r[0], r[1] // BLOCK, r[2]), (r[1], bytes(r[3]))

    def tops(met: tuple) -> tuple:
        (tree, block, n), partial = met
        return tree, block, -(-n // BLOCK), partial.top

    pairs = nodes.select("tree", "at", "n", "digest").rdd.map(keyed)
    # The arity of a parent follows from the size of the tree: the levels of a block are those of its whole stratum.
    joined = pairs.map(lambda kv: (kv[0], (kv[1], kv[0][2]))).combineByKey(
        lambda v: Partial(v[1]).add(0, *v[0]), lambda p, v: p.add(0, *v[0]), Partial.join, parts
    )
    return nodes.sparkSession.createDataFrame(joined.map(tops), "tree string, at long, n long, digest binary")


def unfolded(n: int, digests: list[bytes]) -> list[list[bytes]]:
    """All levels of a block with these leaves, in a stratum of n."""
    levels = [digests]
    for _ in level_sizes(n)[1:]:
        below = levels[-1]
        levels.append([hashed(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[bytes]], i: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The run's others on the left and on the right of leaf i, level by level."""
    for nodes in levels[:-1]:
        run = i - i % ARITY
        yield nodes[run:i], nodes[i + 1 : run + ARITY]
        i //= ARITY


PATH = "path array<struct<left:binary,right:binary>>"


def _blocks(nodes: DataFrame, paths: DataFrame, each, columns: str, *more: str) -> DataFrame:
    """each(block of nodes as dict of lists, its levels, the path of its top) for every block, by cogroups of bounded size."""

    def run(key, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by([("at", "ascending")])
        rows = block.to_pydict()
        levels = unfolded(rows["n"][0], rows["digest"])
        path = [(s["left"], s["right"]) for s in above.column("path")[0].as_py()] if above.num_rows else []
        return each(rows, levels, path)

    left = nodes.select("tree", "at", "n", "digest", *more, F.expr(f"at div {BLOCK}").alias("block"))
    right = paths.select(F.col("tree").alias("tree_"), F.col("at").alias("block_"), "path")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree_", "block_")).applyInArrow(run, columns)


def descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (tree, at, path) of nodes (tree, at, n, digest), from those of the blocks they lie in: nearest siblings first."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))])

    def each(rows: dict, levels: list, path: list) -> pa.Table:
        found = [[{"left": b"".join(a), "right": b"".join(b)} for a, b in siblings(levels, i)] + [{"left": a, "right": b} for a, b in path] for i in range(len(rows["at"]))]
        return pa.Table.from_arrays([pa.array(rows["tree"]), pa.array(rows["at"], pa.int64()), pa.array(found, schema.field("path").type)], schema=schema)

    return _blocks(nodes, paths, each, f"tree string, at long, {PATH}")


def climb(leaves: common.Saved, parts: int) -> list[common.Saved]:
    """The strata of all trees from the leaves (tree, at, n, digest) upward; the last has a node a tree.

    Trees that are done keep their one node, at 0 of 1, in every further stratum.
    """
    strata = [leaves]
    while strata[-1].df.where("n > 1").limit(1).count():
        strata.append(common.Saved(ascend(strata[-1].df, parts), "stratum"))
    return strata


def paths(strata: list[common.Saved], top: DataFrame) -> common.Saved:
    """Paths of the blocks of the lowest stratum, from the paths of the trees' roots (tree, at = 0, path)."""
    found = common.Saved(top, "paths")
    for stratum in reversed(strata[1:]):
        lower = common.Saved(descend(stratum.df, found.df), "paths")
        found.drop()
        found = lower
    return found


def manifest(docs: DataFrame, tampered: Column | None = None, change: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents (doc_id, source, lang, n_chars, text).

    Groups are the values of lang, leaves ascend by doc_id. proof_sha256 is the digest of a leaf's siblings,
    level by level to the root. folded_root is the root recomputed from the leaf and its siblings; where
    `tampered` holds, from the leaf of the text that `change` gives.
    """
    spark = docs.sparkSession
    common.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    changed = F.when(tampered, leaf(text=change(F.col("text")))) if change else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("copy"))
    rows = common.Saved(rows, "leaves")  # texts are read once; what follows works on digests
    leaves = placed(rows.df, "doc_id", "digest", "copy")
    rows.drop()
    strata = climb(leaves, parts)
    # The subroots of all trees are the leaves of one more tree.
    roots = placed(strata[-1].df.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), "own")
    upper = climb(roots, parts)
    root = upper[-1].df.first()
    root = bytes(root.digest).hex() if root else ""
    over = paths(upper, upper[-1].df.select("tree", "at", F.array().cast("array<struct<left:binary,right:binary>>").alias("path")))
    own = descend(roots.df, over.df).select("at", "path").join(roots.df.select("at", "own", "digest"), "at")
    own = common.Saved(own.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("at"), "path", "digest"), "subroots")
    blocks = paths(strata, own.df.select("tree", "at", "path"))
    for step in (over, *upper, *strata[1:]):
        step.drop()
    subroots = own.df.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    proofs = prove(leaves.df, blocks.df).join(common.if_small(subroots), "tree")
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def prove(leaves: DataFrame, paths_: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, proof_sha256, folded_root) of leaves (tree, at, n, digest, doc_id, changed), the digests as hex."""
    columns = "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string"
    names = [c.split()[0] for c in columns.split(", ")]

    def each(rows: dict, levels: list, path: list) -> pa.Table:
        hexed = [[d.hex().encode() for d in nodes] for nodes in levels]
        over = [(a.hex().encode(), b.hex().encode()) for a, b in path]
        beyond = b"".join(a + b for a, b in over)
        proof, folded = [], []
        for i, changed in enumerate(rows["changed"]):
            steps = [(b"".join(a), b"".join(b)) for a, b in siblings(hexed, i)]
            proof.append(hashlib.sha256(b"".join(a + b for a, b in steps) + beyond).hexdigest())
            now = changed.hex().encode() if changed is not None else hexed[0][i]
            for a, b in (*steps, *over):
                now = hashlib.sha256(a + now + b).hexdigest().encode()
            folded.append(now.decode())
        return pa.Table.from_arrays([pa.array(rows["tree"]), pa.array(rows["doc_id"], pa.int64()), pa.array([h.decode() for h in hexed[0]]), pa.array(proof), pa.array(folded)], names)

    return _blocks(leaves, paths_, each, columns, "doc_id", "changed")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
