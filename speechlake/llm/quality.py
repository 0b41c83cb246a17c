"""Quality by a generalised additive model with pairwise interactions.

A text becomes a dozen measures (NAMES), each measure a bin. The log-odds of quality are an
intercept plus one number a measure, looked up by its bin, plus one number for each of a few
pairs of measures, looked up by both bins. The tables are learned by cyclic boosting: in
each round every measure in turn adds a tree of LEAVES leaves over its bins, fitted to
the gradient of the logistic loss, then damped; so correlated measures share their weight.
Afterwards every pair is tried with one tree of two by two cuts on what is left, the
PAIRS best pairs are kept, and the same cycle runs over them. A score is a sum of table
entries: bins by binary search, then additions, column by column for a batch.

It is fitted on a bounded sample of the labelled training rows: at most SAMPLE of each
label, those of smallest hash, whole texts, weighed so that the labels count as they do among all
training rows. Defined results: null and empty texts have all measures 0 and a score of
their own; a long text is measured whole; of trees, cuts or pairs of equal gain the first is
taken; repeated rows are scored each; extra columns are left out; without both labels in
training every score is the share of label 1 (0.5 without rows); an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many training documents of each label; bins of a measure alone and in a pair; pairs kept.
SAMPLE, BINS, PAIR_BINS, PAIRS = 2000, 64, 12, 10
#: Rounds of the cycle, leaves of a tree, damping, least weighted rows of a leaf.
ROUNDS, LEAVES, RATE, LEAST = 300, 3, 0.05, 5.0
NAMES = ("length", "word_length", "longest_word", "symbols", "capitals", "digits", "punctuation", "short_words", "distinct_words", "distinct_lines", "repeated_pairs", "line_length", "bare_words", "marked_words", "other_letters")

_KIND = np.zeros(256, np.uint8)  # 0 symbol, 1 white space, 2 lower, 3 capital, 4 digit, 5 punctuation, 6 lead byte beyond ASCII, 7 its continuation
for _kind, _bytes in enumerate((b"", b" \t\n\r\v\f", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:!?'\"()-", bytes(range(192, 256)), bytes(range(128, 192)))):
    _KIND[list(_bytes)] = _kind


def measures(text: str) -> list[float]:
    """The text's measures, in the order of NAMES: shares are of characters, words, lines or pairs of neighbouring words."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8)
    chars = int(kinds.sum() - kinds[7])
    letters = max(1, kinds[2] + kinds[3] + kinds[6])
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x]
    sizes = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    ends = [w[-1] for w in words]
    marks = sum(_KIND[e] == 0 for e in ends) if n else 0
    bare = sum(not w.isalnum() and _KIND[list(w)].max(initial=0) < 2 for w in words if len(w) < 4)
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(chars)),
        float(sizes.mean()),
        float(np.log1p(sizes.max())),
        kinds[0] / chars,
        kinds[3] / letters,
        kinds[4] / chars,
        kinds[5] / chars,
        float((sizes < 4).mean()),
        len(set(words)) / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        1 - pairs / max(1, n - 1) if n > 1 else 0.0,
        float(np.log1p(chars / max(1, len(lines)))),
        bare / max(1, n),
        marks / max(1, n),
        kinds[6] / letters,
    ]


@dataclass
class Model:
    """Edges of the bins of each measure, its table; coarser edges, the pairs and their tables; the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    intercept: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of measures: a look-up and an addition a table."""
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (a, b), grid in zip(self.pairs, self.grids):
            z += grid[bins[a], bins[b]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def edges_of(column: np.ndarray, bins: int) -> np.ndarray:
    """Lower ends of the second and further bins: quantiles of the values, each once."""
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))
    return cuts[cuts > column.min()] if len(column) else cuts


def gain(g, h):
    """What a leaf of gradient g and curvature h takes off the loss; 0 where it is too small to be one."""
    return np.where(h > 0, g * g / np.maximum(h, 1e-9), 0.0)


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best cut of the bins in two runs of LEAST weighted rows each; (0, 0) if none gains."""
    if len(g) < 2:
        return 0.0, 0
    left, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    found = gain(left, hl) + gain(g.sum() - left, h.sum() - hl) - gain(g.sum(), h.sum())
    found = np.where((nl >= LEAST) & (n.sum() - nl >= LEAST), found, 0.0)
    at = int(np.argmax(found))
    return (float(found[at]), at + 1) if found[at] > 1e-12 else (0.0, 0)


def line_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values of the bins from a tree with so many leaves, grown by the best cut each time."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        cuts = [(*best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in runs]
        most, at, a, b = max(cuts, key=lambda c: c[0])
        if not most:
            break
        k = runs.index((a, b))
        runs[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / max(h[a:b].sum(), 1e-9)
    return out


def square_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values of the cells) of the best tree that cuts a grid once each way, each of the four leaves of LEAST weighted rows or empty of any say."""
    none = (0.0, np.zeros_like(g))
    if min(g.shape) < 2:
        return none

    def corners(x: np.ndarray) -> np.ndarray:
        low = x.cumsum(0).cumsum(1)
        a, row, column, all_ = low[:-1, :-1], low[:-1, -1:], low[-1:, :-1], low[-1, -1]
        return np.stack([a, row - a, column - a, all_ - row - column + a])

    gs, hs, enough = corners(g), corners(h), corners(n) >= LEAST
    found = np.where(enough, gain(gs, hs), 0.0).sum(0) - gain(g.sum(), h.sum())
    at = int(np.argmax(found))
    if found.flat[at] <= 1e-12:
        return none
    i, j = np.unravel_index(at, found.shape)
    leaf = np.where(enough[:, i, j], gs[:, i, j] / np.maximum(hs[:, i, j], 1e-9), 0.0)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(found.flat[at]), out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """The model of rows of measures and labels 0 and 1; weight: how many rows each stands for."""
    weight = np.ones(len(y)) if weight is None else weight
    scale = len(y) / max(weight.sum(), 1e-9)
    weight = weight * scale
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    width = x.shape[1]
    if share in (0.0, 1.0) or not len(y):
        return Model([np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [], float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    edges = [edges_of(x[:, j], BINS) for j in range(width)]
    coarse = [edges_of(x[:, j], PAIR_BINS) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [], float(np.log(share / (1 - share))))
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-3)

    def sums(cells: np.ndarray, shape: tuple) -> list[np.ndarray]:
        size = int(np.prod(shape))
        return [np.bincount(cells, v, size).reshape(shape) for v in (*slopes(), weight)]

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            step = RATE * line_tree(*sums(bins[j], (len(table),)))
            table += step
            z += step[bins[j]]
    cells = {(a, b): rough[a] * (len(coarse[b]) + 1) + rough[b] for a in range(width) for b in range(a + 1, width)}
    shapes = {(a, b): (len(coarse[a]) + 1, len(coarse[b]) + 1) for a, b in cells}
    promise = {p: square_tree(*sums(c, shapes[p]))[0] for p, c in cells.items()}
    model.pairs = [p for p in sorted(promise, key=lambda p: -promise[p])[:pairs] if promise[p]]
    model.grids = [np.zeros(shapes[p]) for p in model.pairs]
    for _ in range(rounds):
        for p, grid in zip(model.pairs, model.grids):
            step = RATE * square_tree(*sums(cells[p], shapes[p]))[1]
            grid += step
            z += step.ravel()[cells[p]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` documents (doc_id, text) of each label of labels (doc_id, quality)."""
    found = docs.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id")
    counts = {r[0]: r[1] for r in found.groupBy("quality").count().collect()}  # two labels
    rows = common.labelled_sample(docs, found, "quality", sample)
    x = np.array([measures(r.text) for r in rows]).reshape(-1, len(NAMES))
    y = np.array([r.quality for r in rows], float)
    del rows
    taken = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    common.give_back()
    return fit(x, y, np.array([counts[int(q)] / taken[int(q)] for q in y]))


def score(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of documents (doc_id, text); predicted is 1 from a score of `limit` on."""
    spark = docs.sparkSession
    common.ship(spark)
    run_id = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(model)  # tables of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = common.worker_state(("quality", run_id), lambda: sent.value)
        for b in batches:
            x = np.array([measures(t) for t in common.each(b.column(1))]).reshape(-1, len(NAMES))
            s = held.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= limit).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def shapes_of(model: Model) -> dict[str, list[tuple[float, float]]]:
    """Each measure's table as (lower end of a bin, its part of the log-odds): what the model says of it, to be looked at."""
    return {name: list(zip([float("-inf"), *model.edges[j].tolist()], model.tables[j].tolist())) for j, name in enumerate(NAMES)}
