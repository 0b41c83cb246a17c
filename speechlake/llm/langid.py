"""Language ID by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, on hashed character n-grams
of words, predicts the bit. The decoder takes the codeword of least loss, each bit's loss
weighted by how well its classifier does in training, and turns the gap between the two
best into a score; a small gap marks the text as ambiguous.

Fitted on a bounded sample of the training rows: at most SAMPLE of each language, those of
smallest hash; whole texts (see common.labelled_sample for the bounds over all languages; of
more than 1,024 languages the most frequent are learned). Defined results: a null text, or one
without a letter, is `und` with score 0, as is every text where nothing could be learned; of
codewords at equal loss the language that sorts first is taken; a long text is read whole;
repeated rows are predicted each; extra columns are left out (`keep_known` keeps them); with
one language learned, that is predicted; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, BUCKETS = 400, 4096
AMBIGUOUS = 0.1
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


BUCKET_OF = common.Memo(lambda gram: zlib.crc32(gram.encode()) % BUCKETS)


def grams(word: str) -> list[int]:
    """Buckets of the n-grams, n from 1 to 3, of the word between marks."""
    m = f"<{word}>"
    return list(map(BUCKET_OF.__getitem__, [*m, *map("".join, zip(m, m[1:])), *map("".join, zip(m, m[1:], m[2:]))]))


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1, far apart: all splits in two for up to five languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1, *s] for s in itertools.product((1, -1), repeat=n - 1)][1:]).T.astype(float)
    rng = np.random.default_rng(n)
    bits = 15 + 4 * int(np.ceil(np.log2(n)))
    tries = (rng.choice((-1.0, 1.0), (n, bits)) for _ in range(50))
    alike = lambda c: (c @ c.T - 2 * bits * np.eye(n)).max()
    return min(tries, key=alike)


def doc_vector(text: str, memo: common.Memo) -> np.ndarray:
    x = np.zeros(BUCKETS)
    words = LETTERS.findall(text.lower())
    if words:
        ids = np.concatenate([memo[w] for w in words])
        x = np.bincount(ids, minlength=BUCKETS) / len(ids)
    return x


class Model:
    def __init__(self, texts: list[str], langs: list[str], rounds: int = 100):
        self.langs = sorted(set(langs))
        self.codes = codewords(len(self.langs))
        memo = common.Memo(lambda w: np.array(grams(w), np.int16), 100_000)
        x = np.zeros((len(texts), BUCKETS), np.float32)
        for i, t in enumerate(texts):
            x[i] = doc_vector(t, memo)
        memo.clear()
        at = {g: i for i, g in enumerate(self.langs)}
        own = np.array([at[g] for g in langs], int)
        y = self.codes[own]
        self.mean = x.mean(axis=0)
        self.scale = np.float32(1 / (np.sqrt(x.var(axis=0).sum()) + 1e-9))
        x -= self.mean
        x *= self.scale
        count = np.bincount(own, minlength=len(self.langs))
        weigh = (1 / count[own] / len(self.langs))[:, None]
        y = y.astype(np.float32)
        weigh = weigh.astype(np.float32)
        w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        speed = np.zeros_like(w)
        for _ in range(rounds):
            margin = y * (x @ w + b)
            g = y * weigh / (1 + np.exp(np.clip(margin, -30, 30)))
            speed = 0.9 * speed + x.T @ g - 1e-4 * w
            w += 2.0 * speed
            b += 2.0 * g.sum(axis=0)
        loss = (np.log1p(np.exp(-np.clip(y * (x @ w + b), -30, 30))) * weigh).sum(axis=0)
        self.trust = 1 / (0.05 + loss)
        self.trust /= self.trust.sum()
        self.w, self.b = (w * self.scale).astype(float), (b - self.mean @ w * self.scale).astype(float)

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        """Language of least weighted logistic loss; its share against the next best, from 0 to 1."""
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        loss = (np.log1p(np.exp(-np.clip(self.codes * margins, -30, 30))) * self.trust).sum(axis=1)
        first, second = np.argsort(loss, kind="stable")[:2]
        return self.langs[first], float(1 - np.exp(-(loss[second] - loss[first]) * 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most `sample` rows of each language of (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = [r for r in common.labelled_sample(known, known, "lang", sample) if LETTERS.search(r.text)]
    model = Model([r.text for r in rows], [r.lang for r in rows]) if rows else None
    del rows
    common.give_back()
    return model


class Predictor:
    def __init__(self, model: Model | None):
        self.model = model
        self.cap = 100_000
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        bits = 1 if self.model is None else self.model.w.shape[1]
        self.rows = np.zeros((1024, bits + 1))

    def words(self, words: list[str]) -> np.ndarray:
        """Sums of each bit's weights over the words' n-grams, and the number of n-grams."""
        if len(self.at) > self.cap:
            self.clear()
        at = self.at
        new = [w for w in {*words} if w not in at]
        if new:
            while len(at) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            found = list(map(grams, new))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, sizes.sum())
            rows = self.rows[len(at) : len(at) + len(new)]
            rows[:, :-1] = np.add.reduceat(self.model.w[ids], np.cumsum(sizes) - sizes, axis=0)
            rows[:, -1] = sizes
            at.update(zip(new, range(len(at), len(at) + len(new))))
        return self.rows[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text and self.model else []
        if not words:
            return UNKNOWN, 0.0
        total = self.words(words)
        return self.model.decode(total[:-1] / total[-1] + self.model.b)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of documents (doc_id, text)."""
    spark = docs.sparkSession
    common.ship(spark)
    run_id = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(model)  # BUCKETS weights per bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = common.worker_state(("lang", run_id), lambda: Predictor(sent.value))
        for b in batches:
            found = [guess(t) for t in common.each(b.column(1))]
            s = [x for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array(s, pa.float64()), pa.array([x < AMBIGUOUS for x in s], pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those of no known language (null text, or no letter); an ambiguous text stays."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        guess = Predictor(sent.value)
        return lambda text: guess(text)[0] != UNKNOWN

    return common.keep_rows(docs, ("lang-keep", uuid.uuid4().hex), make)
