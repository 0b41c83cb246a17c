"""The additive model against plain versions of its parts, held-out accuracy, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from speechlake.llm import quality, queries
from speechlake.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def plain_gain(g, h):
    return g * g / max(h, 1e-9) if h > 0 else 0.0


def test_line_cut_against_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k = int(rng.integers(1, 9))
        g, h, n = rng.normal(size=k), rng.random(k), rng.integers(0, 12, k).astype(float)
        all_cuts = [plain_gain(g[:i].sum(), h[:i].sum()) + plain_gain(g[i:].sum(), h[i:].sum()) - plain_gain(g.sum(), h.sum()) for i in range(1, k) if n[:i].sum() >= quality.LEAST <= n[i:].sum()]
        assert math.isclose(quality.best_cut(g, h, n)[0], max(all_cuts, default=0.0), abs_tol=1e-9) or max(all_cuts) <= 1e-12


def test_square_cut_against_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(100):
        shape = tuple(rng.integers(1, 6, 2))
        g, h, n = rng.normal(size=shape), rng.random(shape), rng.integers(0, 20, shape).astype(float)
        best, where = 0.0, None
        for i in range(1, shape[0]):
            for j in range(1, shape[1]):
                parts = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, None)) for c, d in ((0, j), (j, None))]
                total = sum(plain_gain(g[p].sum(), h[p].sum()) for p in parts if n[p].sum() >= quality.LEAST) - plain_gain(g.sum(), h.sum())
                if total > best + 1e-12:
                    best, where = total, parts
        found, values = quality.square_tree(g, h, n)
        assert math.isclose(found, best, abs_tol=1e-9)
        want = np.zeros(shape)
        for p in where or []:
            want[p] = g[p].sum() / h[p].sum() if n[p].sum() >= quality.LEAST else 0.0
        assert np.allclose(values, want)


def test_line_tree_has_its_leaves():
    g, h, n = np.array([1.0, 1, -1, -1, 3, 3]), np.ones(6), np.full(6, 10.0)
    assert quality.line_tree(g, h, n, 3).tolist() == [1, 1, -1, -1, 3, 3]
    assert len(set(quality.line_tree(g, h, n, 2).tolist())) == 2
    assert quality.line_tree(np.ones(4), np.ones(4), np.full(4, 10.0)).tolist() == [1, 1, 1, 1]


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(3)
    x = np.hstack([rng.random((1500, 2)), rng.random((1500, len(quality.NAMES) - 2))])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, both = quality.fit(x[:1000], y[:1000], pairs=0), quality.fit(x[:1000], y[:1000])
    right = lambda m: ((m.scores(x[1000:]) > 0.5) == y[1000:]).mean()
    assert both.pairs[0] == (0, 1) and right(both) > 0.9 and right(alone) < 0.65
    plain = [m.intercept + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(m.edges, m.tables, row)) + sum(g[np.searchsorted(m.coarse[a], row[a], "right"), np.searchsorted(m.coarse[b], row[b], "right")] for (a, b), g in zip(m.pairs, m.grids)) for m in [both] for row in x[:50]]
    assert np.allclose(both.logits(x[:50]), plain)


def test_boosting_climbs_and_weights_count():
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * rng.random(600) > 0.6).astype(float)
    loss = lambda m: -np.mean(y * np.log(m.scores(x) + 1e-12) + (1 - y) * np.log(1 - m.scores(x) + 1e-12))
    losses = [loss(quality.fit(x, y, rounds=r)) for r in (1, 10, 100)]
    assert losses[0] > losses[1] > losses[2]
    blind = np.zeros((400, 3))
    y = np.array([0.0] * 200 + [1.0] * 200)
    assert np.allclose(quality.fit(blind, y, np.where(y == 1, 3.0, 1.0)).scores(blind[:1]), 0.75)


def plain_measures(text):
    words, lines = text.split(), [x for x in text.split("\n") if x]
    marks = [c for c in text if c.isascii() and not c.isalnum() and c not in " \t\n\r\v\f.,;:!?'\"()-"]
    letters = max(1, sum(c.isalpha() if c.isascii() else True for c in text))
    capitals = sum(c.isascii() and c.isupper() for c in text)
    return {
        "length": math.log1p(len(text)), "symbols": len(marks) / len(text), "capitals": capitals / letters, "digits": sum(c in "0123456789" for c in text) / len(text),
        "punctuation": sum(c in ".,;:!?'\"()-" for c in text) / len(text), "distinct_words": len(set(words)) / max(1, len(words)), "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "other_letters": sum(not c.isascii() for c in text) / letters, "short_words": sum(len(w.encode()) < 4 for w in words) / max(1, len(words)),
        "repeated_pairs": 1 - len(set(zip(words, words[1:]))) / (len(words) - 1) if len(words) > 1 else 0.0,
        "bare_words": sum(len(w.encode()) < 4 and all(c in marks for c in w) for w in words) / max(1, len(words)),
    }


def test_measures_against_a_plain_version():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("aB é1 .,|$%\n\t-Üx ") for _ in range(rng.randrange(1, 80)))
        if text.split():
            got = dict(zip(quality.NAMES, quality.measures(text)))
            for name, value in plain_measures(text).items():
                assert math.isclose(got[name], value, abs_tol=1e-12), (name, text)
    assert quality.measures(None) == quality.measures("") == [0.0] * len(quality.NAMES)
    assert len(quality.measures(" \n")) == len(quality.NAMES) and all(map(math.isfinite, quality.measures(" \n\t")))


def test_held_out_accuracy(spark):
    rows = queries.op13_quality(spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count() and rows.where("score between 0 and 1").count() == docs.count()
    met = rows.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in met) and len(met) > 50
    kept = [r.predicted for r in met if r.quality == 1]
    found = [1 - r.predicted for r in met if r.quality == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(found) >= 0.9 * len(found)
    assert rows.where(F.col("held_out") != (crc_mod(F.col("doc_id"), 5) == 0)).count() == 0


def test_odd_rows(spark):
    texts = [None, "", " ", "Plain words that are fine. And more of them.", "%%% $$$ ###", "long text " * 60_000, "same", "same", "ÀÜ 😀 \0"]
    df = spark.createDataFrame([(i if i else None, t, 0.1, 9) for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted int")
    good = ["the cat sat on the mat and it was warm number %d." % i for i in range(30)]
    bad = ["CAT!! %%% ### &&& " + "x| " * i for i in range(30)]
    known = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30), "x") for i in range(60)], "doc_id long, quality int, text string")
    model = quality.train(known, labels)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert len(got) == len(texts) and got[6].score == got[7].score and got[None].score == got[1].score
    assert got[3].score > 0.8 > 0.2 > got[4].score
    assert quality.score(df.limit(0), model).count() == 0
    assert quality.shapes_of(model)["symbols"][0][0] == float("-inf")
    ones = quality.train(known, labels.where("quality = 1"))
    assert {round(r.score) for r in quality.score(df, ones).collect()} == {1}
    none = quality.train(known, labels.limit(0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    # Ties and repeated rows in training: the same model, whatever the order of the rows.
    twice = quality.train(known.unionByName(known), labels.orderBy(F.desc("doc_id")))
    assert np.allclose(twice.scores(np.array([quality.measures(t) for t in good])), model.scores(np.array([quality.measures(t) for t in good])), atol=0.05)
