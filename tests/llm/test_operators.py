"""The ten operators against brute force, exact libraries or invariants, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from speechlake.llm import ann, common, cws, langid, lm, packing, pii, queries, sentencepieces, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "one", "One two", "one two", "a@b.co +1 (555) 123-4567 10.0.0.256 10.0.0.1 4111 1111 1111 1111", "long " * 30000, "Ünï 😀 ▁x"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def brute_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w)] if 0 < len(w) <= 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [root(i) for i in range(n)]


def test_simhash_components(spark, corpus):
    texts = [*ODD, *corpus, *corpus[:3]]
    fps = [brute_print(t) for t in texts]
    want = groups(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: r for r in simhash.link_components(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == want
    assert simhash.link_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [2, 512])
def test_hamming_links_in_hot_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BLOCK", hot)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (1 << 64) - 1 for b in base for k in (0, 1, 1, 2, 2, 3, 3, 4) for _ in range(5)})
    want = groups(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.hamming_links(df).collect()}
    at = {f: i for i, f in enumerate(fps)}
    pairs = {frozenset((at[a], at[b])) for a, b in links}
    got = groups(len(fps), lambda a, b: frozenset((a, b)) in pairs)
    assert got == want


def test_near_duplicates_keep_one(spark, corpus):
    text = max(corpus, key=len)
    words = text.split()
    copies = [" ".join(words[:-1] + [f"w{i}"]) for i in range(40)]
    texts = [text, text, *copies, *[c for c in corpus if c and c != text][:30], None, ""]
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    sets = [set(simhash.shingle_hashes(simhash.words_of((t or "").encode()), 5).tolist()) for t in texts]
    want = set(groups(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))
    assert kept == want
    assert simhash.keep_one(docs(spark, [])).count() == 0


def kept_and_wanted(spark, texts):
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    sets = [set(simhash.shingle_hashes(simhash.words_of(t.encode()), 5).tolist()) for t in texts]
    return kept, set(groups(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))


def test_near_duplicates_chained_in_a_large_group(spark):
    rng = random.Random(8)
    fresh = lambda k: f"w{k}x{rng.getrandbits(40)}"
    base = [fresh(i) for i in range(400)]

    def changed(words, n, low, high):
        words = list(words)
        for i in rng.sample(range(low, high, 5), n):
            words[i] = fresh(i)
        return words

    variants = [changed(base, 4, 0, 200) for _ in range(300)]
    chained = [changed(variants[7], 8, 200, 400) for _ in range(60)]
    texts = [" ".join(w) for w in [base, *variants, *chained]]
    kept, want = kept_and_wanted(spark, texts)
    assert kept == want


def test_near_duplicates_with_a_repeated_line(spark):
    texts = []
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(300))
        texts += [text, text + f" please{i} read{i} the{i} next{i} line{i}" * 300]
    kept, want = kept_and_wanted(spark, texts)
    assert want == set(range(0, 40, 2)) and kept == want


def test_near_duplicates_of_few_words(spark):
    texts = []
    for i in range(200):
        words = [f"w{i}x{j}" for j in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    kept, want = kept_and_wanted(spark, texts)
    assert want == set(range(0, 400, 2)) and kept == want


def test_near_duplicates_by_fingerprint(spark):
    near, far = [0, 0b11, 0b1111, 1 << 20 | 0b1111], [-1, 0xFF00FF00FF]
    empty = bytearray(np.array([7], np.uint32).tobytes())
    rows = [(th, fp, bytearray(np.array([1000 + th], np.uint32).tobytes()), [0] * 8) for th, fp in enumerate([*near, *far, near[0]])] + [(9, 0b11, empty, [0] * 8)]
    sets = spark.createDataFrame(rows, "th long, fp long, shingles binary, bits array<long>")
    label = {r.node: r.label for r in simhash.similar_components(sets, 0.8).df.collect()}
    # Chains of two bits, equal fingerprints, and nothing else: no two sets share a shingle.
    assert len({label[th] for th in (0, 1, 2, 3, 6, 9)}) == 1 and not {4, 5} & set(label)
    text = " ".join(f"w{i}" for i in range(40))
    done = simhash.prints(docs(spark, [text, text + " said again" * 50, "other"]).withColumn("th", F.col("doc_id")), 5).collect()
    assert [r.fp for r in done][0] == simhash.simhash(text.encode(), 5) and len({r.fp for r in done}) == 3


def test_document_fingerprints(spark, corpus):
    texts = [*ODD, *corpus]
    got = {r.doc_id: r for r in cws.fingerprint_pairs(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    words = [Counter(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]
    off = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = words[i], words[(i + 1) % len(texts)]
        union = sum((a | b).values())
        off.append(got[i].near_next - (sum((a & b).values()) / union if union else 1))
        if edited == t:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
    assert cws.fingerprint_pairs(docs(spark, [])).count() == 0
    assert [r.near_next for r in cws.fingerprint_pairs(docs(spark, ["a b"])).collect()] == [1.0]


def test_document_fingerprints_of_uneven_weights(spark):
    texts = []
    for i in range(40):
        texts += [" ".join([f"often{i}"] * 1000 + [f"w{i}x{side}x{j}" for j in range(100)]) for side in "ab"]
    got = {r.doc_id: r.near_next for r in cws.fingerprint_pairs(docs(spark, texts)).collect()}
    assert abs(np.mean([got[i] for i in range(0, 80, 2)]) - 1000 / 1200) < 0.03


def test_draws_of_weights_agree_as_their_share(spark):
    # A term's a has the law Exp(weight), and two of its weights agree in min / max of the samples.
    fews = F.when(F.col("weight") == 1, F.array(F.lit(-1))).otherwise(F.array(*map(F.lit, range(cws.DRAWS // cws.FEW))))
    terms = spark.range(2000).select("id", F.col("id").alias("term"), F.lit(3).alias("grp"), F.explode(F.array(*[F.lit(w).cast("long") for w in (1, 2, 3, 50)])).alias("weight"))
    drawn = cws.draws(terms.withColumn("w", F.col("weight")).withColumn("few", F.explode(fews)), ["id", "w"])
    got = {}
    for r in drawn.groupBy("w", "id").agg(*[F.min(f"d{i}").alias(f"d{i}") for i in range(cws.DRAWS)]).orderBy("w", "id").collect():
        got.setdefault(r.w, []).append(r[2:])
    d = {w: np.array(v) for w, v in got.items()}
    for w, v in d.items():
        a = -np.log1p(-((v >> 32) + 2.0**31 + 0.5) / 2.0**32)
        assert abs(a.mean() * w - 1) < 0.03 and abs(a.std() * w - 1) < 0.04
        for other in d:
            assert abs(np.mean((v & 0xFFFFFFFF) == (d[other] & 0xFFFFFFFF)) - min(w, other) / max(w, other)) < 0.015
    # Weights of 1 take no logarithm: their hash is the draw.
    h = spark.range(2000).select(F.xxhash64("id", F.lit(3), F.lit(0)).alias("h")).toPandas().h.to_numpy()
    assert sorted(h) == sorted(d[1][:, 0])


def test_document_fingerprints_of_likeness_to_the_edited_text(spark):
    texts = [" ".join([f"w{i}x{j % (20 + i)}" for j in range(60 + 7 * i)]) for i in range(60)]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "no id  at all ")], "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in cws.fingerprint_pairs(df).collect()}
    order, off = [None, *range(60)], []
    text = {None: "no id  at all "} | dict(enumerate(texts))
    for i, k in enumerate(order):
        t, nxt = text[k], text[order[(i + 1) % 61]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = Counter(t.split()), Counter(edited.split())
        off.append(got[k].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0], 0), (404, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    hit = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert len(own) == 10 and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        hit += len({r.vec_id for r in own} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 200
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def ok(kind, m):
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        d = re.sub("[^0-9]", "", m)
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return {"email": True, "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def test_pii_spans_and_terms(spark, corpus):
    rng = random.Random(3)
    noise = ["".join(rng.choice("a1.@+-_ 4é😀(") for _ in range(60)) for _ in range(300)]
    told = [f"filler{i} text stands here Zorbulon writes from zor@x.org about things" for i in range(6)]
    texts = [*ODD, *noise, *corpus[:60], *told, "1 2 3 " * 20000]
    rows = pii.find(docs(spark, texts)).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()
    got = {r.doc_id: r.s for r in rows}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = [s for s in got[i].split(",") if s and not s.startswith("term")]
        assert base == brute_spans(t), (i, t)
    at = texts.index(told[0])
    found = {texts[at][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[at].split(",")) if k == "term"}
    assert "Zorbulon" in found
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "zor@x.org" not in clean[at] and "[EMAIL]" in clean[at] and "Zorbulon" not in clean[at]
    assert clean[texts.index("one")] == "one" and clean[0] is None
    assert pii.find(docs(spark, [])).count() == 0


def test_url_filter(spark):
    hosts = ["com", "Example.COM", "www.example.com", "a.www.example.com", "notexample.com", "x.net", "net", "x.net.org", ""]
    found = [f"http://{h}{p}{e}" for h in hosts for p in ("", "/", "/en", "/en/", "/en/a", "/es/1", "/fr/", "/EN/") for e in ("", "?q=/es/", "#x://y")] + [None, "", "no", "://", "a://b://c"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(found)], "page_id long, url string, html string, rule string")
    listed = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in urls.judge(df, listed).collect()}
    for i, u in enumerate(found):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in queries.RULES if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u
    assert urls.judge(df, listed.where("false")).where("verdict = 'allow'").count() == len(found)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    texts = [*ODD, "hello <|endoftext|> world <|StartOfText|>", *corpus]
    got = packing.pack(docs(spark, texts), WORDS).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(a, min(4096, len(ids) - a)) for a in range(0, len(ids), 4096)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own]
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(full) <= packing.lower_bound([r.length for r in got], 4096) + 1
    assert packing.pack(docs(spark, []), WORDS).count() == 0


def test_bounds_and_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        bins = packing.best_fit_decreasing(lengths, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
        assert packing.lower_bound(lengths, 40) <= len(bins)
    assert packing.lower_bound([21, 22, 23], 40) == 3


def test_lm_scores(spark, corpus, monkeypatch):
    texts = [*ODD[:-2], *corpus[:80]]
    train = [i % 3 != 0 for i in range(len(texts))]
    got = {}
    for head in (20, 10**6):
        rows = lm.score(docs(spark, texts), F.col("doc_id") % 3 != 0, PIECES, head).collect()
        got[head] = {r.doc_id: r for r in rows}
    c = Counter()
    for t, own in zip(texts, train):
        if own:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        tokens = [*(t or "").encode().lower().split(), None]
        for rows in got.values():
            r = rows[i]
            assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
            assert math.isclose(r.score, got[20][i].score, rel_tol=1e-9)
    lattice = lm.Lattice(["▁", "a", "b", "ab", "▁a"], {0: 3, 1: 2, 2: 4, 3: 1, 4: 5}, 2)
    p = {k: math.exp(x) for k, x in lattice.logp.items()}
    assert math.isclose(math.exp(lattice(b"ab")), p["▁"] * p["a"] * p["b"] + p["▁"] * p["ab"] + p["▁a"] * p["b"])
    assert lm.score(docs(spark, []), F.lit(True), PIECES).count() == 0


def test_toxicity_learns_and_points(spark):
    rng = random.Random(2)
    common_words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    texts, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choice(common_words) for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            s[i % 5] += " vilewordish"
        texts.append(". ".join(s))
        labels.append(int(i % 4 == 0))
    weights = toxicity.fit(texts[:300], labels[:300])
    rows = toxicity.score(docs(spark, [*texts[300:], *ODD]), weights).orderBy("doc_id").collect()
    assert [r.predicted for r in rows[:100]] == labels[300:]
    assert all("vilewordish" in r.sentence for r in rows[:100] if r.predicted)
    assert rows[100].score == rows[101].score == 0
    assert toxicity.fit(["a"], [1]) is None and toxicity.score(docs(spark, ODD), None).where("score <> 0").count() == 0


def test_sentencepiece_exact(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    letters = [*" ▁\n\tabcthe 0123é你好😀\x00\x01.,'İ", "ing", "<unk>", "<s>", "  ", "\u0301"]
    texts = [*ODD, *corpus, *["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(800)]]
    got = {r.doc_id: r for r in sentencepieces.digest_documents(docs(spark, texts), PIECES).collect()}
    enc = sentencepieces.Encoder(PIECES)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(sp.decode(ids).encode()).hexdigest(),
        ), t
        if len(t or "") < 2000:
            e = enc.encode(t or "")
            assert e.ids.tolist() == ids and enc.decode(ids) == sp.decode(ids) == e.decoded.decode("utf-8", "replace")
            data, at = (t or "").encode(), 0
            for a, b in zip(e.begin.tolist(), e.end.tolist()):
                assert a in (at, a) and b >= a
                at = max(at, b)
            assert at == len(data)
    assert sentencepieces.encode_documents(docs(spark, ["ab c"]), PIECES).count() == 1


def test_language_id(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(table.where(common.crc_mod(F.col("doc_id"), 4) != 2))
    out = langid.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").where(common.crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.9 * len(out)
    odd = {r.doc_id: r for r in langid.predict(docs(spark, [*ODD, "123 !!"]), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, len(ODD)))
    assert langid.keep_known(docs(spark, [*ODD, "123 !!"]), model).count() == len(ODD) - 3
    assert langid.train(table.where("false")) is None
    codes = langid.codewords(8)
    assert min((codes[i] != codes[j]).sum() for i in range(8) for j in range(i)) >= 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 100 + 2)]
    df = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    got = {r.node: r.label for r in common.connected_components(df).df.collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 101, 102, 200)} == {100}
