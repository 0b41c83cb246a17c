"""SimHash near-dedup by pigeonhole blocks.

`fingerprints` gives a document's 64-bit SimHash over word shingles. `link_components` links
fingerprints at a small Hamming distance: 64 bits are split in blocks, close pairs share at
least `blocks - distance` of them, rows are joined on every such combination of blocks and
the distance is verified. `near_duplicates` takes a similarity instead of a distance.

Defined results: null text counts as empty; a text without words has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle; repeated rows are
linked to each other; a row of null doc_id is linked too, and a component is named by its
smallest known doc_id (null without any); extra columns are left out (`keep_one` keeps them,
whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Blocks of more distinct fingerprints than this are not paired but linked through midpoints.
HOT_BLOCK = 512
#: Hashes that are turned to bits at once, so that a very long text needs bounded memory.
CHUNK = 1 << 15


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = [0, *(n + i for i, n in enumerate(itertools.accumulate(map(len, words)), 1))]
    ends = [s - 1 for s in starts[size:]]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits, highest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += part.sum(axis=0, dtype=np.int32)
    return total


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed long."""
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes)).view(">i8")[0])


def simhash(text: bytes, size: int) -> int:
    """As a signed long."""
    return majority(shingle_hashes(words_of(text), size))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of documents (doc_id, text)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t or b"", size) for t in common.each(b.column(1).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of blocks - distance of the blocks: close pairs agree on one at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(part, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_links(fps: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """(a, b) links that join all fingerprints within the distance (0 to 2), directly or by a chain.

    fps: distinct fingerprints, column fp. A block that holds more than HOT_BLOCK fingerprints
    is not joined with itself: there every fingerprint meets the points one flipped bit away
    (itself too), outside the block's bits. Two fingerprints are within two bits exactly if
    they share such a point, and at most 65 can share one, so these groups are small. Both
    ways are exact.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance is 0, 1 or 2")
    masks = block_masks(blocks, distance)
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("block", "key"))
    sizes = common.Saved(keys.groupBy("block", "key").count().where("count > 1"), "blocks")
    few = sizes.df.where(F.col("count") <= HOT_BLOCK).select("block", "key")
    many = sizes.df.where(F.col("count") > HOT_BLOCK).select("block", "key")
    kept = common.Saved(keys.join(few, ["block", "key"], "left_semi"), "kept")
    left, right = kept.df, kept.df.withColumnRenamed("fp", "b")
    close = (
        left.join(right, ["block", "key"])
        .where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance))
        .select(F.col("fp").alias("a"), "b")
    )
    # A fingerprint may flip the bits outside of any hot block it stands in; each point is made once.
    flips = F.array(*[F.lit(signed(1 << i)) for i in range(64)])
    outside = F.element_at(F.array(*[F.lit(signed(~m & (1 << 64) - 1)) for m in masks]), F.col("block") + 1)
    free = keys.join(many, ["block", "key"], "left_semi").groupBy("fp").agg(F.bit_or(outside).alias("free"))
    flip = F.concat(F.array(F.lit(0).cast("long")), F.filter(flips, lambda f: f.bitwiseAND(F.col("free")) != 0))
    points = free.select("fp", F.explode(flip).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # At distance 2 a shared point is proof; below it the distance is checked again.
    star = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if distance == 2:
        star = star.select("a", F.explode("fps").alias("b")).where("a <> b")
    else:
        star = star.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
        star = star.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return close.unionByName(star).distinct()


def link_components(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked, named by the smallest doc_id."""
    prints = common.Saved(fingerprints(docs, size), "prints")
    reps = common.Saved(prints.df.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    links = common.Saved(hamming_links(reps.df.select("fp"), distance), "links")
    comp = common.connected_components(links.df)
    labelled = common.Saved(reps.df.join(comp.df.withColumnRenamed("node", "fp"), "fp", "left"), "labelled")
    lows = common.Saved(labelled.df.where("label is not null").groupBy("label").agg(F.min("rep").alias("low")), "lows")
    name = common.Saved(
        labelled.df.join(lows.df, "label", "left").select("fp", F.coalesce("low", "rep").alias("component_id")), "names"
    )
    for step in (links, reps, comp, labelled, lows):
        step.drop()
    return prints.df.join(name.df, "fp").select("doc_id", "fp", "component_id")


# Near duplicates by fingerprint, and by similarity: an exact join on the rarest shingles, exact verification.

#: Lists of more texts than this get leaders before what is left is paired.
LONG_LIST, LEADERS = 64, 3
#: Of 1 in SAMPLED texts the shingles are counted, and at most COMMON of those met again come last in every text.
SAMPLED, COMMON = 8, 50_000
#: Bits of a set's parity, by which pairs that differ in too many shingles are told without looking at the sets.
BITS = 512


def parity(tokens: np.ndarray) -> list[int]:
    """BITS bits as signed longs, each the parity of how many tokens fall on it: two sets differ in at least as many tokens as their bits do."""
    odd = np.bincount(tokens % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def prints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, fp, shingles binary, bits): th hashes the text, fp is the SimHash of its distinct shingles (a line that repeats counts once,
    as in the similarity), shingles are 32 bits of each distinct one, sorted, bits their parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hashes = [np.unique(shingle_hashes(words_of(t), size)) for t in common.each(part.column(2).cast(pa.binary()))]
                sets = [np.unique(h.astype(np.uint32)) for h in hashes]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(map(majority, hashes), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(map(parity, sets), pa.list_(pa.int64()))],
                    ["doc_id", "th", "fp", "shingles", "bits"],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, fp long, shingles binary, bits array<long>")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles that texts of a sample share, rarest first. What is found here decides on speed only, not on results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int32))], ["token"])

    met = sets.where(F.pmod("th", F.lit(SAMPLED)) == 0).select("shingles").mapInArrow(run, "token int").groupBy("token").count().where("count > 1")
    rows = met.orderBy(F.desc("count"), "token").limit(COMMON).select("token").collect()
    return np.array([r.token for r in reversed(rows)], np.int32).view(np.uint32)


def prefix_size(n: int, similarity: float) -> int:
    """Of two sets at the similarity, in one order of all shingles, the first so many of each have one in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def postings(sets: DataFrame, similarity: float) -> DataFrame:
    """(token, th, n, at): the first shingles of each text (th, shingles) of n, each with its place in the order; no shingles count as one of their own."""
    last = common_shingles(sets)
    by_token = np.argsort(last)
    known = last[by_token]

    def first(s: np.ndarray) -> np.ndarray:
        size = prefix_size(len(s), similarity)
        if not len(known):
            return s[:size]
        found = np.minimum(np.searchsorted(known, s), len(known) - 1)
        late = known[found] == s
        early = s[~late]
        return early[:size] if len(early) >= size else np.concatenate([early, last[np.sort(by_token[found[late]])]])[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                sets = [np.frombuffer(x, np.uint32) for x in part.column(1).to_pylist()]
                sets = [s if len(s) else np.zeros(1, np.uint32) for s in sets]
                firsts = [first(s) for s in sets]
                many = [len(f) for f in firsts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(firsts).view(np.int32)),
                        pa.array(np.repeat(np.array(part.column(0)), many)),
                        pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), many)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in many])),
                    ],
                    ["token", "th", "n", "at"],
                )

    return sets.select("th", "shingles").mapInArrow(run, "token int, th long, n int, at int")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - both
                kept.append(union == 0 or both >= similarity * union - 1e-9)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    left = sets.select(F.col("th").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("th").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def like_sizes(similarity: float) -> Column:
    return F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9


def paired(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): rows (token, th, n, at, label, bits) of one token and different labels that can reach the similarity.

    At the first shingle that two texts share, no more than what follows can be shared besides.
    Where rows carry bits, sets whose parities differ more than sets at the similarity may are left out.
    """
    with_bits = "bits" in rows.columns
    right = rows.select("token", F.col("th").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("label").alias("other"), *[F.col("bits").alias("other_bits")] * with_bits)
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))
    reach = most >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-9
    if with_bits:
        apart = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("other_bits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
        reach &= apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n") + F.col("m")) + 1e-9
    met = rows.join(right, "token").where((F.col("th") < F.col("b")) & (F.col("label") != F.col("other")) & like_sizes(similarity) & reach)
    return met.select(F.col("th").alias("a"), "b").distinct()


def led(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): LEADERS texts of each token's list with all others of it. Lists of like texts mostly have the same leaders."""
    named = [F.min(F.struct(F.xxhash64("th", F.lit(i)).alias("h"), "th", "n")).alias(f"l{i}") for i in range(LEADERS)]
    leaders = rows.groupBy("token").agg(*named).select("token", F.explode(F.array(*[F.struct(F.col(f"l{i}.th").alias("a"), F.col(f"l{i}.n").alias("m")) for i in range(LEADERS)])).alias("l")).select("token", "l.*")
    met = rows.join(leaders, "token").where((F.col("th") != F.col("a")) & like_sizes(similarity))
    return met.select(F.least("a", "th").alias("a"), F.greatest("a", "th").alias("b")).distinct()


def fingerprint_links(sets: DataFrame, distance: int) -> common.Saved:
    """(a, b): links that join the texts (th, fp) whose fingerprints are within the distance; equal ones through their smallest th."""
    leads = common.Saved(sets.groupBy("fp").agg(F.min("th").alias("lead")), "leads")
    same = sets.select("th", "fp").join(leads.df, "fp").where("th <> lead").select(F.col("th").alias("a"), F.col("lead").alias("b"))
    close = hamming_links(leads.df.select("fp"), distance)
    for end in ("a", "b"):
        close = close.join(leads.df.select(F.col("fp").alias(end), F.col("lead").alias(f"lead_{end}")), end)
    found = common.Saved(same.unionByName(close.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))), "alike")
    leads.drop()
    return found


def similar_components(sets: DataFrame, similarity: float, distance: int = 2) -> common.Saved:
    """(node, label): components of the texts (th, fp, shingles, bits) linked by fingerprint or at the similarity; see near_duplicates."""
    alike = fingerprint_links(sets, distance)
    counted = postings(sets, similarity).withColumn("count", F.count("*").over(Window.partitionBy("token")))
    shared = common.Saved(counted.where("count > 1"), "shared")
    short = shared.df.where(F.col("count") <= LONG_LIST).withColumn("label", F.col("th"))
    long = shared.df.where(F.col("count") > LONG_LIST)
    first = common.Saved(paired(short, similarity).unionByName(led(long, similarity)).distinct(), "pairs")
    found = common.Saved(verified(first.df, sets, similarity), "found")
    comp = common.connected_components(found.df.unionByName(alike.df))
    labelled = long.join(comp.df.withColumnRenamed("node", "th"), "th", "left").select("token", "th", "n", "at", F.coalesce("label", "th").alias("label"))
    labelled = common.Saved(labelled, "labelled")
    mixed = labelled.df.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    open_ = labelled.df.join(mixed, "token", "left_semi").join(sets.select("th", "bits"), "th")
    rest = common.Saved(paired(open_, similarity), "pairs")
    for step in (first, shared, labelled):
        step.drop()
    if rest.df.limit(1).count():
        more = common.Saved(verified(rest.df, sets, similarity), "found")
        if more.df.limit(1).count():
            comp = common.connected_components(found.df.unionByName(more.df).unionByName(alike.df))
        more.drop()
    for step in (rest, found, alike):
        step.drop()
    return comp


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """(doc_id, th): of each group of near-duplicate documents (doc_id, text), the one that stays.

    Equal texts are one. Texts are linked if the SimHash fingerprints of their distinct word
    shingles are within the distance (`hamming_links`), or if the sets of shingles have at least the
    Jaccard similarity, which meets what fingerprints miss; groups are the components of the links; the smallest doc_id of a
    group stays. In one order of all shingles, common ones last, two such texts share one of
    their first n - ceil(similarity * n) + 1: every pair that does is a candidate, so no link
    is missed at any size. In lists of more than LONG_LIST texts some leaders meet all others
    first; then every pair that is not yet in one group is looked at, linked texts too.
    """
    common.ship(docs.sparkSession)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    done = common.Saved(prints(source.withColumn("th", F.xxhash64("text")), size), "prints")
    sets = common.Saved(done.df.select("th", "fp", "shingles", "bits").dropDuplicates(["th"]), "sets")
    reps = common.Saved(done.df.groupBy("th").agg(F.min("doc_id").alias("rep")), "reps")
    done.drop()
    comp = similar_components(sets.df, similarity, distance)
    sets.drop()
    labelled = common.Saved(reps.df.join(comp.df.withColumnRenamed("node", "th"), "th", "left").select("th", "rep", F.coalesce("label", "th").alias("label")), "labelled")
    best = labelled.df.groupBy("label").agg(F.min(F.struct("rep", "th")).alias("b"))
    keepers = common.Saved(best.select(F.col("b.rep").alias("doc_id"), F.col("b.th").alias("th")), "keepers")
    for step in (reps, comp, labelled):
        step.drop()
    return keepers.df


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """docs without near duplicates: one row of each group stays, with all its columns."""
    own_id, own_text = common.fresh(docs, "own_id", "own_text")
    keepers = near_duplicates(docs, size, similarity, distance).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_text))
    keyed = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(own_text, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(keepers, [own_id, own_text], "left_semi").dropDuplicates([own_id, own_text]).select(*[F.col(f"`{c}`") for c in docs.columns])
