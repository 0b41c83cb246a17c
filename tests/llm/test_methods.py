"""Methods against plain versions, clashing columns, and the pipeline as a whole."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechlake.llm import ann, langid, packing, pii, queries, sentencepieces, simhash, toxicity

from .test_operators import PIECES, SF, WORDS, docs


def char_map(entries: dict[bytes, bytes]) -> bytes:
    """A compiled map of these prefixes: a double array in which each node has a block of 256 places of its own."""
    nodes = sorted({k[:i] for k in entries for i in range(len(k) + 1)})
    base = {n: 256 * (i + 1) for i, n in enumerate(nodes)}
    units, out = [0x800000FF & 0xFFFFFFFF | 0x100] * (256 * (len(nodes) + 1)), b""

    def offset(frm: int, to: int) -> int:
        x = frm ^ to
        return x << 10 if x < 1 << 21 else (x >> 8) << 10 | 0x200

    places = {b"": 0}
    for n in nodes:
        if n:
            places[n] = base[n[:-1]] ^ n[-1]
    for n in nodes:
        leaf = n in entries
        units[places[n]] = offset(places[n], base[n]) | (0x100 if leaf else 0) | (n[-1] if n else 0)
        if leaf:
            units[base[n]] = 0x80000000 | len(out)
            out += entries[n] + b"\0"
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + out


def test_character_map_and_its_alignment():
    entries = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": "é".encode(), b"\t": b" "}
    found = sentencepieces.CharMap(char_map(entries))
    assert found.longest(b"abcd", 0) == (3, "é".encode()) and found.longest(b"abd", 0) == (2, b"X") and found.longest(b"ba", 0) is None
    enc = sentencepieces.Encoder(PIECES)
    enc._prepare(found, 1000)
    text = "zoo abc ﬁt\tab a"
    norm, origin = enc.normalise(text)
    assert norm == "▁zoo▁é▁fit▁X▁a"
    data, e = text.encode(), enc.encode(text)
    assert origin[-1] == len(data) and e.end[-1] == len(data) and e.begin[0] == 0
    whole = {data[a:b].decode() for a, b in zip(e.begin.tolist(), e.end.tolist())}
    assert any("abc" in w for w in whole) and enc.decode(e.ids) == "zoo é fit X a"
    assert enc.encode("plain text").ids.tolist() == sentencepieces.Encoder(PIECES).encode("plain text").ids.tolist()


def test_vocabulary_without_byte_pieces():
    enc = sentencepieces.Encoder(PIECES)
    enc.byte_id, enc.byte_value = {}, {}
    enc._prepare(sentencepieces.CharMap(b""), 1000)
    e = enc.encode("a 𒀀𒀁 b")
    assert e.ids.tolist().count(enc.unknown) == 1 and e.end[-1] == len("a 𒀀𒀁 b".encode())


def test_rows_that_share_an_id_are_found(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(1, [9.0] * 8), (100, x[3]), (100, x[4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == 100, k=len(rows)).collect()
    assert len(got) == 2 * (len(rows) - 1)
    assert sum(r.vec_id == 1 for r in got) == 4 and sum(r.vec_id == 100 for r in got) == 2


def test_slots_split_and_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 20, 800)] + rng.standard_normal((800, 16)) * 0.4, np.tile(centres[0], (300, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hit = 0
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(own.values()) & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
        assert len(own) == 10
    assert len(got) == 22 and hit >= 0.9 * 10 * len(got)


def test_clashing_columns_stay(spark):
    rows = [(0, "mail zor@x.org now", "c", "d", "e"), (1, "mail zor@x.org now", "f", "g", "h"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_id string, own_text string, held_spans string")
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id, r.own_id, r.own_text) for r in kept) == [(0, "c", "d"), (2, None, None)]
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[0].text == "mail [EMAIL] now" and (clean[1].own_id, clean[1].held_spans) == ("f", "h") and clean[2].text is None


def test_packing_keeps_null_ids_and_exchanges_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_GROUP", 20)
    texts = [" ".join(["word"] * (37 * i % 3000 + 1)) for i in range(120)]
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")))
    got = packing.pack(df, WORDS).collect()
    assert len(got) == 120 and sum(r.doc_id is None for r in got) == 12
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(full) <= packing.lower_bound([r.length for r in got], 4096) + 2


def test_noisy_or_against_a_plain_version():
    weights = ({"bad": 3.0, "^bad": 1.0, "nice": -2.0, "^nice": 0.5}, -2.0)
    text = "Bad bad day. A nice one! bad, nice"
    keep = 1.0
    for words in toxicity.sentences(text):
        own = {f for w in words for f in toxicity.features(w)}
        keep *= 1 - 1 / (1 + np.exp(-(weights[1] + sum(weights[0].get(f, 0.0) for f in own))))
    got, worst = toxicity.Scorer(weights)(text)
    assert got == pytest.approx(1 - keep) and worst == "Bad bad day"


def test_decoding_against_a_plain_version():
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze"] * 5
    model = langid.Model(texts, ["en", "fr", "de"] * 5)
    guess = langid.Predictor(model)
    for t in ("the dog", "le chien", "die katze und der hund"):
        ids = np.concatenate([langid.grams(w) for w in langid.LETTERS.findall(t)])
        margins = np.bincount(ids, minlength=langid.BUCKETS) / len(ids) @ model.w + model.b
        loss = [(np.log1p(np.exp(-np.clip(c * margins, -30, 30))) * model.trust).sum() for c in model.codes]
        assert guess(t)[0] == model.langs[int(np.argmin(loss))]


def test_entry_queries_have_the_contract_s_columns(spark):
    wanted = {"op1": "doc_id fingerprint component_id", "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op8": "doc_id held_out score predicted", "op9": "doc_id n_tokens ids_sha256 decoded_sha256", "op10": "doc_id held_out lang_pred score"}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.queries().items():
        if name.split("_")[0] in wanted:
            rows = query(spark, SF)
            assert rows.columns[: len(wanted[name.split("_")[0]].split())] == wanted[name.split("_")[0]].split()
            assert rows.count() == n


def test_pipeline_against_its_operators(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, SF)
        assert kept.columns == table.columns and kept.count() <= before
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert not any("@" in t and pii.PATTERNS["email"] and __import__("re").search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in texts.values())
