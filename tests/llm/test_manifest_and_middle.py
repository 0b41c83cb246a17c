"""The Merkle manifest and the fill-in-middle transformation against plain versions and SQL, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from speechlake.llm import fim, merkle, queries
from speechlake.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tree string"
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def others(levels, i):
    for nodes in levels[:-1]:
        run = i // 8 * 8
        yield nodes[run:i], nodes[i + 1 : run + 8]
        i //= 8


def leaf(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    own = [sorted(by[v], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for v in langs]
    trees = [tree([leaf(r, r.text) for r in group]) for group in own]
    top = tree([t[-1][0] for t in trees])
    for k, (group, levels) in enumerate(zip(own, trees)):
        for i, r in enumerate(group):
            path = [*others(levels, i), *others(top, k)]
            lowered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            now = leaf(r, r.text.translate(LOWER) if lowered else r.text)
            for a, b in path:
                now = digest(*a, now, *b)
            yield r.doc_id, leaf(r, r.text), levels[-1][0], top[-1][0], digest(*(h for a, b in path for h in (*a, *b))), now, now == top[-1][0]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def manifest(df):
    return merkle.manifest(df, crc_mod(F.col("doc_id"), 3) == 0, merkle.lower_ascii)


ODD = [
    (None, "Null Id", "en", "s", 3, "x"),
    (None, None, None, None, None, None),
    (7, "One", "en", "s", 3, "x"),
    (7, "One", "en", "s", 3, "x"),
    (7, "Other", "en", "s", 3, "x"),
    (8, "", "", "s", 0, "x"),
    (9, "Ünï 😀 ÀA", "de", "ß", -1, "x"),
    (10, "Long " * 50_000, "fr", "s", 250_000, "x"),
    (11, "Rank", "é", "s", 3, "x"),
]


def test_manifest_of_odd_rows(spark):
    many = [(i, f"Text {i}", "la", "s", i, "x") for i in range(100, 100 + 513)] + [(3, "Same", "it", "s", 1, "x")] * 75 + [(i, "t", f"l{i}", "s", 1, "x") for i in range(60)]
    df = spark.createDataFrame([*ODD, *many], COLUMNS)
    assert by_id(manifest(df).collect()) == by_id(plain_manifest(df.collect()))


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_manifest_of_few_rows(spark, n):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", i, "x") for i in range(n)], COLUMNS)
    got = manifest(df).collect()
    assert by_id(got) == by_id(plain_manifest(df.collect()))
    assert merkle.manifest(df).where("not verified").count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512])
def test_partial_parents_in_any_order(n):
    rng = random.Random(n)
    digests = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    order = rng.sample(range(n), n)
    parts = [merkle.Partial(n) for _ in range(4)]
    for i in order:
        parts[rng.randrange(4)].add(0, i, digests[i])
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.join(p)
    assert not whole.open and whole.top.hex() == tree([d.hex() for d in digests])[-1][0]
    assert merkle.unfolded(n, digests)[-1] == [whole.top]


def test_blocks_of_one_task_leave_few_partial_parents():
    p = merkle.Partial(512)
    most = max(sum(map(len, p.add(0, i, bytes(32)).open.values())) for i in range(512))
    assert most <= 7 * merkle.LEVELS and p.top


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", " ", "abc", "a<P>b", "<S>", "<M", "<S <P < <M >" * 9, "Ünï 😀 x\n\r\t y", "nul \0 x", "one two " * 30_000, "é ﬁ", "12 ab-cd"] * 4


def test_middle_of_odd_texts_and_back(spark):
    df = spark.createDataFrame([(None if i == 5 else i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "abc def", "x", "y")] * 2, "doc_id long, text string, form string, output string")
    rows = df.collect()
    out = fim.transform(df)
    assert by_id(out.collect()) == by_id(plain_middle(r.doc_id, r.text) for r in rows)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    back = fim.restore(out.withColumn("more", F.lit(1)), name="again")
    assert by_id(back.select("doc_id", "again").collect()) == by_id((r.doc_id, r.text or "") for r in rows)
    sums = fim.digests(df).collect()
    want = [(*p[:-1], hashlib.sha256(p[-1].encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows for p in [plain_middle(r.doc_id, r.text)]]
    assert by_id(sums) == by_id(want)
    assert fim.transform(df.limit(0)).count() == 0 and fim.digests(df.limit(0)).count() == 0


def test_middle_with_other_shares(spark):
    df = spark.createDataFrame([(i, f"word {i} and more") for i in range(200)], "doc_id long, text string")
    forms = lambda **k: {r.form for r in fim.transform(df, **k).collect()}
    assert forms(share=0) == {"plain"} and forms(share=100, spm=0) == {"psm"} and forms(share=100, spm=100) == {"spm"}


def test_outputs_that_are_no_form_give_null(spark):
    df = spark.createDataFrame([("psm", "abc"), ("spm", "<S>a<P>b"), ("psm", "<P>a<S>b<M>c"), ("plain", "x")], "form string, output string")
    assert [r.text for r in fim.restore(df).collect()] == [None, None, "acb", "x"]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_fill_in_middle"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description]
    assert by_id(got.collect()) == by_id(want.fetchall())
