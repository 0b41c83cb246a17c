"""Toxicity by multiple-instance learning.

Only documents are labelled. A sentence's probability is logistic in its words and their
four- and five-letter beginnings (each once a sentence); a document's is the noisy-or
1 - prod(1 - p_sentence). The document labels' likelihood is climbed in the sentence
weights, so the model learns which sentences carry the label and can point at them.

It is fitted on a bounded sample of the labelled training rows: at most SAMPLE of each
label, those of smallest hash; whole texts. Words in fewer than LEAST_DOCS of them have no
weight. Defined results: null text counts as empty and has no sentence (score 0, as any
text without one); of sentences that weigh alike the first is shown; a long text is scored
whole; repeated rows are scored each; extra columns are left out (`keep_clean` keeps them);
without both labels in training every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many training documents of each label; documents that a feature must be in.
SAMPLE, LEAST_DOCS = 1200, 5
SENTENCE, WORD = re.compile(r"[.!?…\n]+"), re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    return (word, "^" + word[:4], "^" + word[:5]) if len(word) > 4 else (word, "^" + word)


def sentences(text: str) -> list[list[str]]:
    found = (WORD.findall(s) for s in SENTENCE.split(text.lower()))
    return [words for words in found if words]


def fit(texts: list[str], labels: list[int], rounds: int = 80, rate: float = 0.2, negatives: float = 3.0, penalty: float = 1e-4) -> tuple[dict[str, float], float] | None:
    """Weights of the features and the constant; None without both labels."""
    if len(set(labels)) < 2:
        return None
    # Words as numbers, sentence after sentence: a text is let go before the next is read.
    words_at: dict[str, int] = {}
    parts, sizes, owner = [], array("i"), array("i")
    for d, text in enumerate(texts):
        for words in sentences(text):
            own = {words_at.setdefault(w, len(words_at)) for w in words}
            parts.append(np.fromiter(own, np.int32, len(own)))
            sizes.append(len(own))
            owner.append(d)
    if not parts:
        return None
    words, owner = np.concatenate(parts), np.array(owner)
    del parts
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    feature_at: dict[str, int] = {}
    table = np.full((len(words_at), 3), -1, np.int32)
    for w, i in words_at.items():
        for j, f in enumerate(features(w)):
            table[i, j] = feature_at.setdefault(f, len(feature_at))
    del words_at
    n = len(feature_at)
    ids, of = table[words].ravel(), np.repeat(sentence, 3)
    of, ids = of[ids >= 0], ids[ids >= 0]
    once = np.unique(of.astype(np.int64) * n + ids)
    of, ids = (once // n).astype(np.int32), (once % n).astype(np.int32)
    spread = np.bincount(np.unique(owner[of].astype(np.int64) * n + ids) % n, minlength=n)
    names = [f for f, k in zip(feature_at, spread >= LEAST_DOCS) if k]
    place = np.cumsum(spread >= LEAST_DOCS) - 1
    kept = spread[ids] >= LEAST_DOCS
    sentence, ids = of[kept], place[ids[kept]].astype(np.int32)
    del feature_at, once, of, table, words
    if not names:
        return None
    y = np.array(labels, float)
    weigh = np.where(y == 1, 1.0, negatives)
    w = np.zeros(len(names) + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(sentence, w[ids], len(sizes)) + w[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        share = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0) * weigh
        g_sentence = p * share[owner] / len(y)
        g = np.append(np.bincount(ids, g_sentence[sentence], len(names)) - penalty * np.sign(w[:-1]), g_sentence.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
    return {f: float(w[i]) for i, f in enumerate(names)}, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float] | None:
    """Fits on at most `sample` documents (doc_id, text) of each label of labels (doc_id, toxic)."""
    found = docs.select("doc_id").join(labels.select("doc_id", "toxic"), "doc_id")
    rows = common.labelled_sample(docs, found, "toxic", sample)
    weights = fit([r.text or "" for r in rows], [r.toxic for r in rows])
    del rows
    common.give_back()
    return weights


class Scorer:
    def __init__(self, weights: tuple[dict[str, float], float] | None):
        self.none = weights is None
        if self.none:
            return
        self.w, self.bias = weights
        self.memo = common.Memo(self._pull, 100_000)

    def _pull(self, word: str) -> tuple:
        return tuple((f, self.w[f]) for f in features(word) if f in self.w)

    def sentence(self, words: list[str]) -> float:
        found = dict([pair for pull in map(self.memo.__getitem__, words) if pull for pair in pull])
        return self.bias + sum(found.values())

    def __call__(self, text: str) -> tuple[float, str | None]:
        """Noisy-or of the sentences, and the sentence that weighs most if it is likelier toxic than not."""
        if self.none:
            return 0.0, None
        kept, top, where = 1.0, 0.0, None
        for raw in SENTENCE.split(text):
            words = WORD.findall(raw.lower())
            if words:
                z = max(-30.0, min(30.0, self.sentence(words)))
                kept *= 1 / (1 + np.exp(z)) if z > -20 else 1 - 2e-9
                if z > top:
                    top, where = z, raw.strip()
        return float(1 - kept), where


def score(docs: DataFrame, weights: tuple[dict[str, float], float] | None) -> DataFrame:
    """(doc_id, score, predicted, sentence) of documents (doc_id, text); sentence: the worst one, if any is toxic."""
    spark = docs.sparkSession
    common.ship(spark)
    run_id = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(weights)  # bounded by SAMPLE texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = common.worker_state(("toxic", run_id), lambda: Scorer(sent.value))
        for b in batches:
            found = [scorer(t or "") for t in common.each(b.column(1))]
            s = [x for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([x for _, x in found], pa.string())],
                ["doc_id", "score", "predicted", "sentence"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, sentence string")


def keep_clean(docs: DataFrame, weights: tuple[dict[str, float], float] | None, limit: float = 0.5) -> DataFrame:
    """docs without those that score `limit` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        scorer = Scorer(sent.value)
        return lambda text: scorer(text or "")[0] < limit

    return common.keep_rows(docs, ("toxic-keep", uuid.uuid4().hex), make)
