"""Language-model scoring over a subword lattice.

The vocabulary's pieces get unigram probabilities from how often the training texts' words
use them (add-one). A text's probability sums over every segmentation into pieces: in log
space alpha(j) = logsum over pieces w ending at j of alpha(j - |w|) + log p(w). Pieces never
span words, so a text's lattice falls apart into its words' lattices and one end symbol, and
the marginal of every distinct word of the corpus is computed once.

Corpus counts (words, pieces) cover all training texts. Each word's count and marginal are
needed with every text: those of the HEAD words that occur most often, in training texts or
others, go to the workers, the rest are looked up by a join that no frequent word can skew, so
every count is exact at every size.

Defined results: null text counts as empty (one end symbol); repeated rows are scored each;
extra columns are left out; without training texts every count is zero.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import words_of

#: Words whose counts are sent to the workers: a bound on what is broadcast, not on what is counted.
HEAD = 100_000
#: Distinct words that a task holds before it passes its partial counts on.
FLUSH = 200_000
MARK = "▁"


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c long, n long): words and, as a null word, the ends of documents (text, train); c counts in training texts only, n in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = list(counts)
            for w in held.keys() - counts.keys():
                words.append(w)
            c = [counts.get(w, 0) for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([k + held.get(w, 0) for k, w in zip(c, words)], pa.int64())], ["word", "c", "n"])

        counts, held = Counter(), Counter()
        for b in batches:
            for t, train in zip(common.each(b.column(0).cast(pa.binary())), b.column(1).to_pylist()):
                own = counts if train else held
                own.update(words_of(t or b""))
                own[None] += 1
                if len(counts) + len(held) > FLUSH:
                    yield out()
                    counts.clear()
                    held.clear()
        yield out()

    return docs.select("text", "train").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def pieces_of(model: str) -> tuple[object, list[str]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return sp, [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def count_pieces(words: DataFrame, model: str) -> DataFrame:
    """(piece int, c long): how often the words (word, c) use each piece of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = common.worker_state(("lm-sp", model), lambda: pieces_of(model)[0])
        counts: Counter = Counter()
        for b in batches:
            words = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            for ids, c in zip(sp.encode(words, num_threads=1), b.column(1).to_pylist()):
                for i in ids:
                    counts[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["piece", "c"])

    return words.where("word is not null and c > 0").select("word", "c").mapInArrow(run, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c"))


class Lattice:
    """Natural-log marginals of words under unigram piece probabilities."""

    def __init__(self, pieces: list[str], counts: dict[int, int], ends: int):
        total = sum(counts.values()) + ends + len(pieces)
        prob = [(counts.get(i, 0) + 1) / total for i in range(len(pieces))]
        self.end = math.log((ends + 1) / total)
        self.byte = {int(p[3:5], 16): math.log(prob[i]) for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
        self.logp = {p: math.log(prob[i]) for i, p in enumerate(pieces) if not (p.startswith("<") and p.endswith(">") and len(p) > 1)}
        self.sizes: dict[str, set[int]] = {}
        for p in self.logp:
            self.sizes.setdefault(p[:3], set()).add(len(p))
        for head, found in self.sizes.items():
            found |= {n for n in range(1, len(head) + 1) if head[:n] in self.logp}

    def _sizes(self, head: str) -> set[int]:
        """Lengths of the pieces that may start where these three characters stand."""
        found = self.sizes.get(head)
        if found is None:
            found = {n for n in range(1, len(head) + 1) if head[:n] in self.logp}
            if len(self.sizes) < 1_000_000:
                self.sizes[head] = found
        return found

    def __call__(self, word: bytes) -> float:
        text, logp = MARK + word.decode("utf-8", "replace"), self.logp
        end = len(text)
        terms: list[list[float]] = [[] for _ in range(end + 1)]
        terms[0].append(0.0)
        for i in range(end + 1):
            own = terms[i]
            if len(own) == 1:
                alpha = own[0]
            else:
                top = max(own)
                alpha = top + math.log(sum([math.exp(t - top) for t in own]))
            terms[i] = ()
            if i == end:
                return alpha
            for n in self._sizes(text[i : i + 3]):
                p = logp.get(text[i : i + n])
                if p is not None and i + n <= end:
                    terms[i + n].append(alpha + p)
            if text[i] not in logp:  # a character outside the vocabulary is spelled in bytes
                terms[i + 1].append(alpha + sum([self.byte.get(b, self.end) for b in text[i].encode()]))
        raise AssertionError


def score(docs: DataFrame, train: Column, model: str, head: int = HEAD) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text); learned from those where train is true."""
    spark = docs.sparkSession
    common.ship(spark)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text"
    )
    counted = common.Saved(count_words(source), "words")
    totals = counted.df.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0))).first()
    n, v, ends = map(int, totals)
    piece_counts = dict(count_pieces(counted.df, model).collect())  # a row per piece of the vocabulary at most
    grammar = spark.sparkContext.broadcast((piece_counts, ends))
    run_id, end = uuid.uuid4().hex, Lattice(pieces_of(model)[1], piece_counts, ends).end

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = common.worker_state(("lattice", run_id), lambda: Lattice(pieces_of(model)[1], *grammar.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([lattice(w) for w in b.column(0).to_pylist()], pa.float64())], ["word", "c", "n", "logp"])

    words = common.Saved(counted.df.where("word is not null").select("word", "c", "n").mapInArrow(marginals, "word binary, c long, n long, logp double"), "marginals")
    top = words.df.orderBy(F.desc("n"), "word").limit(head).collect()
    known = {bytes(w): (c, math.log10(c + 1), logp) for w, c, _, logp in top}
    most = top[-1].n if len(top) == head else 0  # so often each word occurs that the head lacks, at most
    sent = spark.sparkContext.broadcast(known)
    schema = "row long, doc_id long, train boolean, n_tokens long, n_known long, logs double, lattice double, words array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = []
                part = b.slice(at, 512)
                for row, doc_id, own, text in zip(*(c.to_pylist() for c in part.columns[:3]), part.column(3).cast(pa.binary()).to_pylist()):
                    words = words_of(text or b"")
                    hit, logs, lat, rare, times = int(ends > 0), math.log10(ends + 1), end, [], []
                    for w, k in Counter(words).items():
                        found = known.get(w)
                        if found:
                            hit += k if found[0] else 0
                            logs += k * found[1]
                            lat += k * found[2]
                        else:
                            rare.append(w)
                            times.append(k)
                    rows.append((row, doc_id, own, len(words) + 1, hit, logs, lat, rare, times))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split(" ")[0] for f in schema.split(", ")])

    out = common.Saved(source.mapInArrow(run, schema), "scored")
    # What the head lacks: no word here occurs more often in the whole corpus than any of the head's, so none is in very many documents.
    tail = words.df.where(F.col("n") <= most)
    late = (
        out.df.select("row", F.explode(F.arrays_zip("words", "times")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"))
        .join(tail, "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"), F.sum(F.col("times") * F.col("logp")).alias("more_lattice"))
    )
    whole = out.df.drop("words", "times").join(late, "row", "left")
    zero = F.lit(0.0)
    return whole.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", zero) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        ((F.col("lattice") + F.coalesce("more_lattice", zero)) / F.lit(math.log(10))).alias("score"),
    )
