"""Personal data by patterns, then information-theoretic sanitisation, in DataFrame functions only.

Base spans come from patterns (emails, ip addresses, cards, phone numbers) with validity
checks. What they show is protected: each value, and the group that it belongs to (an email's
domain, an address block, a card's issuer, the beginning of a number). Every word of a
document outside of such spans is weighed by what it tells of the entities there: with counts
over the whole corpus, the pointwise mutual information log2(N * n(word, entity) / (n(word) *
n(entity))) as a share of the entity's information log2(N / n(entity)). Counts are of distinct
texts: of c copies each counts 1/c. A word that tells at least DISCLOSURE of some entity, in
at least SUPPORT texts, discloses: wherever it stands, in any text, it becomes a `term` span
(outside of base spans). Terms that tell nearly everything are removed, others generalised.

A text is cut by each pattern once (what lies between the matches gives their places); only
spans and word counts are exchanged, and texts alone that hold a disclosing word are cut in
words again.

Defined results: null text counts as empty and has no spans; repeated rows are searched each;
a word is a run of letters and digits with a letter in it, two characters at least, letter
case aside; an empty table gives an empty result; extra columns are left out (`sanitise`
keeps them, whatever their names); places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SUPPORT, DISCLOSURE, REMOVE = 3, 0.8, 0.95
KINDS = ["email", "ip", "card", "phone", "term"]
#: The patterns of the contract, with possessive repeats (nothing after them could want a character back) and,
#: for emails, starts only where a run of its characters starts or the last match ended: the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[\p{L}\p{N}]+"
BETWEEN = r"[^\p{L}\p{N}]+"
#: What an entity's group is called by: the part of its lower-cased match.
GROUPS = {"email": r"@(.*)$", "ip": r"^([0-9]+\.[0-9]+\.[0-9]+)\.", "card": r"^((?:[^0-9]*[0-9]){6})", "phone": r"^((?:[^0-9]*[0-9]){5})"}


def luhn(digits: Column) -> Column:
    """Whether the digits' check sum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return n.between(9, 15) if kind == "phone" else F.when(n.between(13, 19), luhn(digits)).otherwise(False)


def matches(text: Column, pattern: str, hint: str | None = None) -> tuple[Column, Column]:
    """The matches, and the pieces between them (one more)."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if hint is None:
        return found, pieces
    has = F.contains(text, F.lit(hint))
    return F.when(has, found).otherwise(F.array().cast("array<string>")), F.when(has, pieces).otherwise(F.array(text))


def group_of(kind: str, match: Column) -> Column:
    found = F.regexp_extract(match, GROUPS[kind], 1)
    return found if kind in ("email", "ip") else F.regexp_replace(found, "[^0-9]", "")


def searched(docs: DataFrame) -> DataFrame:
    """Of each document (row, doc_id, th, text): spans (kind, i, n, before, ok), the entities (kind, key) of the valid ones and, if there is any, its words.

    kind: place in KINDS, for groups of entities 10 more.
    """
    kept = docs
    for kind, pattern in PATTERNS.items():
        found, pieces = matches(F.col("text"), pattern, HINT[kind])
        kept = kept.withColumn(f"m_{kind}", found).withColumn(f"p_{kind}", pieces)

    def spans_of(kind: str) -> Column:
        def span(m: Column, i: Column) -> Column:
            before = F.length(F.get(f"p_{kind}", i))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(m).alias("n"), before.alias("before"), valid(kind, m).alias("ok"), F.lower(m).alias("entity"), group_of(kind, F.lower(m)).alias("family"))

        return F.transform(f"m_{kind}", span)

    kept = kept.select("row", "doc_id", "th", "text", F.concat(*map(spans_of, PATTERNS)).alias("spans"))
    good = F.filter("spans", lambda s: F.coalesce(s.ok, F.lit(False)))
    key = lambda kind, name: F.struct(kind.cast("int").alias("kind"), name.alias("key"))
    entities = F.array_distinct(F.concat(F.transform(good, lambda s: key(s.kind, s.entity)), F.transform(good, lambda s: key(s.kind + 10, s.family))))
    rest = F.col("text")
    for pattern in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.array_distinct(F.filter(F.split(F.lower(rest), BETWEEN), lambda w: (F.length(w) > 1) & w.rlike(r"\p{L}")))
    return kept.withColumn("entities", entities).select(
        "row", "doc_id", "th", F.transform("spans", lambda s: F.struct(s.kind.alias("kind"), s.i.alias("i"), s.n.alias("n"), s.before.alias("before"), s.ok.alias("ok"))).alias("spans"),
        "entities", F.when(F.size("entities") > 0, words).alias("words"),
    )


def base_spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the valid spans in what `searched` gives."""
    rows = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("before") + F.col("n")).over(so_far)).withColumn("start", F.col("end") - F.col("n"))
    return placed.where("ok").select("row", "kind", "start", "end")


def document_words(docs: DataFrame) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower("text"), BETWEEN), lambda w: F.length(w) > 1))


def disclosing(source: DataFrame, found: DataFrame, copies: DataFrame, n: float) -> DataFrame:
    """(word, share): the words that tell at least DISCLOSURE of some entity; share: how much they tell at most.

    copies (th, share): what a text that occurs several times counts each time.
    """
    weight = F.coalesce("weight", F.lit(1.0))
    enough = F.lit(SUPPORT - 1e-6)
    held = found.where("size(entities) > 0").select(F.monotonically_increasing_id().alias("doc"), "th", "entities", "words").join(copies, "th", "left")
    held = common.Saved(held.select("doc", "entities", "words", weight.alias("weight")), "held").df
    entities = held.select(F.explode("entities").alias("e"), "weight").groupBy("e.kind", "e.key").agg(F.sum("weight").alias("n_e")).where((F.col("n_e") >= enough) & (F.col("n_e") < n - 1e-6))
    entities = common.if_small(common.Saved(entities.withColumn("eid", F.monotonically_increasing_id()), "entities").df)
    # Texts get their weights before they are cut in words: what is exchanged is texts at most, and then sums.
    weighed = source.select("th", "text").join(copies, "th", "left") if copies.limit(1).count() else source.withColumn("weight", F.lit(1.0))
    counts = weighed.select(F.explode(document_words(source)).alias("word"), weight.alias("weight")).groupBy("word").agg(F.sum("weight").alias("df")).where(F.col("df") >= enough)
    # As n(word, entity) is n(entity) at most, a word in more texts than this cannot tell DISCLOSURE of the entity.
    most = lambda n_e: F.pow(F.lit(n), F.lit(1 - DISCLOSURE)) * F.pow(n_e, F.lit(DISCLOSURE)) * (1 + 1e-9)
    top = entities.agg(F.max("n_e")).first()[0] or 0.0
    counts = counts.where(F.col("df") <= most(F.lit(top))).withColumn("wid", F.monotonically_increasing_id())
    counts = common.if_small(common.Saved(counts, "counts").df)
    # Words and entities are exchanged by their numbers; names come back for the pairs that are met often enough.
    rare = held.select("doc", F.explode("words").alias("word")).join(counts, "word")
    rare = rare.groupBy("doc").agg(F.collect_list(F.struct("wid", "df")).alias("rare"))  # words of one document
    pairs = held.select("doc", "weight", F.explode("entities").alias("e")).select("doc", "weight", "e.*").join(entities, ["kind", "key"]).select("doc", "weight", "eid", "n_e").join(rare, "doc")
    pairs = pairs.select("eid", "weight", F.explode(F.filter("rare", lambda r: r.df <= most(F.col("n_e")))).alias("r")).select("eid", "r.wid", "weight")
    pairs = pairs.groupBy("eid", "wid").agg(F.sum("weight").alias("n_et")).where(F.col("n_et") >= enough)
    pairs = pairs.join(entities.select("eid", "n_e"), "eid").join(counts, "wid")
    told = F.log2(F.lit(n) * F.col("n_et") / (F.greatest("df", "n_et") * F.col("n_e"))) / F.log2(F.lit(n) / F.col("n_e"))
    return pairs.withColumn("share", told).where(F.col("share") >= DISCLOSURE).groupBy("word").agg(F.max("share").alias("share"))


def term_spans(source: DataFrame, tells: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end, share): every place of a disclosing word, once for equal rows."""
    key = ["doc_id", "th"]
    met = source.select(*key, F.explode(document_words(source)).alias("word")).join(tells, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "share")).alias("tells"))
    bytes_of = F.aggregate("tells", F.lit(16), lambda s, t: s + 8 + F.octet_length(t.word))
    met = common.if_small(common.Saved(met, "met").df, width=bytes_of).withColumnsRenamed({"doc_id": "d", "th": "h"})
    texts = source.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select(*key, "text", "tells").dropDuplicates(key)  # before texts are cut: words and gaps take several times the room
    words, gaps = matches(F.col("text"), WORD)

    def place(w: Column, i: Column) -> Column:
        hit = F.get(F.filter("tells", lambda t: t.word == F.lower(w)), F.lit(0))
        return F.struct(i.alias("i"), F.length(F.get("gaps", i)).alias("before"), F.length(w).alias("n"), hit.share.alias("share"))

    each = texts.select(*key, "tells", words.alias("words"), gaps.alias("gaps")).select(*key, F.explode(F.transform("words", place)).alias("p")).select(*key, "p.*")
    so_far = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("before") + F.col("n")).over(so_far)).withColumn("start", F.col("end") - F.col("n"))
    return placed.where("share is not null").select(*key, F.lit(KINDS.index("term")).alias("kind"), "start", "end", "share")


def find(docs: DataFrame) -> DataFrame:
    """(row, doc_id, th, spans): each document's spans (kind, start, end, share) by kind and start.

    share: of a term, how much of an entity's information it tells at most.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = common.Saved(searched(source.withColumn("row", F.monotonically_increasing_id())), "searched").df
    times = found.groupBy("th").count()
    copies = common.Saved(times.where("count > 1").select("th", (F.lit(1.0) / F.col("count")).alias("weight")), "copies").df
    copies = common.if_small(copies)
    n = float(times.count())
    spans = common.Saved(base_spans(found), "spans").df
    tells = common.if_small(common.Saved(disclosing(source, found, copies, n), "tells").df)
    listed = lambda share: F.array_sort(F.collect_list(F.struct("kind", "start", "end", share.alias("share"))))
    base = spans.groupBy("row").agg(listed(F.lit(None).cast("double")).alias("base"))
    terms = term_spans(source, tells).groupBy("doc_id", "th").agg(listed(F.col("share")).alias("terms")).withColumnsRenamed({"doc_id": "d", "th": "h"})
    whole = found.select("row", "doc_id", "th").join(base, "row", "left").join(common.Saved(terms, "terms").df, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,share:double>>")
    own = F.coalesce("base", none)
    free = F.filter(F.coalesce("terms", none), lambda t: ~F.exists(own, lambda s: (s.start < t.end) & (t.start < s.end)))
    return whole.select("row", "doc_id", "th", F.concat(own, free).alias("spans"))


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.end)), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the spans in their texts replaced: base kinds by their name, terms by TERM, or by nothing if they tell nearly all.

    Overlapping spans are replaced together, by what the first of them says. All other columns stay.
    """
    own_id, own_text, of_id, of_text, held = common.fresh(docs, "own_id", "own_text", "of_id", "of_text", "held_spans")
    in_place = lambda a, b: F.when(a.start != b.start, (a.start - b.start).cast("int")).otherwise((b.end - a.end).cast("int"))
    spans = find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(of_id), F.col("th").alias(of_text), F.array_sort("spans", in_place).alias(held)).dropDuplicates([of_id, of_text])
    tag = F.array(F.lit("[EMAIL]"), F.lit("[IP]"), F.lit("[CARD]"), F.lit("[PHONE]"), F.lit("[TERM]"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # Starting before the end of the last span: only what sticks out is taken along.
        fresh = s.start >= acc.at
        gap = F.substring("text", (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        put = F.when((s.kind == 4) & (s.share >= REMOVE), "").otherwise(F.element_at(tag, s.kind + 1))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(fresh, F.concat(acc.out, F.array(gap, put))).otherwise(acc.out).alias("out"))

    done = F.aggregate(held, start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(F.col("text"), (acc.at + 1).cast("int"), F.length("text"))))
    keyed = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_text, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(spans, F.col(own_id).eqNullSafe(F.col(of_id)) & (F.col(own_text) == F.col(of_text)), "left")
    return joined.select(*[F.when(F.col(held).isNull(), F.col("text")).otherwise(done).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
