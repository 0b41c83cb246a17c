"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words, their weights how often they occur. For each sample every term
has, by hash, r and c from Gamma(2, 1) and b from Uniform(0, 1); with t = floor(ln w / r + b)
and ln a = ln c - r * (t - b + 1), the sample is the (term, t) of least a. Two texts agree in
a sample with probability sum(min) / sum(max) of their weights, the generalised Jaccard
similarity.

Every term is drawn for each of the GROUPS * DRAWS samples: likeness is the share of equal
samples. r * b and r * (1 - b) are independent of each other and from Exp(1), and so are
c * exp(-r * (1 - b)), which is a for weight 1, and what is left of c. Drawn are these four, so
that r, c and b have their laws and a weight of 1, that of most terms, takes one hash and no
logarithm: as its a grows with the uniform behind it, that uniform's bits are compared
themselves. Others give 1 - exp(-a) in the same measure. Its upper 32 bits and 32 bits naming
(term, t) are packed in one long, so that a sample is a plain minimum.

Documents are exchanged once, in ranges of doc_id: the next document, the words and the
samples of a document are all found inside its range.

Defined results: null text counts as empty; a text without words has the all-zero
fingerprint, alike to another such one; repeated rows follow one another in the order of
their texts; the only document's next is itself; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More draws a row make methods that the virtual machine does not compile.
GROUPS, DRAWS, FEW = 11, 12, 2
SPACE = r"[\x20\x09-\x0D]+"
#: All up to the last white space.
HEAD = r"(?s)^.*[\x20\x09-\x0D]"
#: Ranges of doc_id for each of the shuffle's partitions: enough that a range's word counts stay in memory.
RANGES = 16
#: Groups from here on carry a document's own values.
OWN = 100
#: Words of the text and of the edited one alike.
BOTH = -1


def uniform(column: str, low: int) -> Column:
    """32 bits of a hash as a number between 0 and 1; the upper ones grow with the hash, taken as signed."""
    part = F.shiftright(column, 32) + F.lit(2.0**31) if low else F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))
    return (part + F.lit(0.5)) / F.lit(float(1 << 32))


def draws(terms: DataFrame, kept: list[str]) -> DataFrame:
    """Adds d0 to d(DRAWS - 1) to rows (term, weight, grp, few): what the term gives to the samples of the group.

    Weights of 1 have a few of -1 and fill a row; the others, whose draws take more code, have rows of FEW draws, from FEW * few on.
    A sample's a is in the upper, its name in the lower 32 bits; where t is 0 they are the hash itself.
    """
    each, light, more = range(FEW), F.col("few") < 0, F.col("few") >= 0
    place = lambda k: (F.col("few") * FEW + k) * 2
    out = terms.select(*kept, "term", "grp", "few", "weight", *[F.when(more, F.xxhash64("term", "grp", place(k) + j)).alias(f"{c}{k}") for k in each for j, c in enumerate("hg")])
    # a of weight 1, the rest of c, r * b and r in turn, as far as they are asked for.
    out = out.select("*", *[c for k in each for c in (F.when(more, -F.log(1 - uniform(f"h{k}", 32))).alias(f"a{k}"), F.when(more, -F.log(uniform(f"g{k}", 0))).alias(f"c{k}"))])
    moved = lambda k: F.col(f"a{k}") * (F.col("weight") - 1) >= F.col(f"c{k}")
    out = out.select("*", *[F.when(moved(k), -F.log(uniform(f"g{k}", 32))).alias(f"rb{k}") for k in each])
    out = out.select("*", *[F.when(F.col(f"rb{k}").isNotNull(), F.col(f"rb{k}") + F.log(F.col(f"c{k}") / F.col(f"a{k}") + 1)).alias(f"r{k}") for k in each])
    out = out.select("*", *[F.when(F.col(f"r{k}").isNotNull(), F.floor((F.log(F.col("weight").cast("double")) + F.col(f"rb{k}")) / F.col(f"r{k}"))).alias(f"t{k}") for k in each])

    def packed(k: int) -> Column:
        a = (F.col(f"a{k}") + F.col(f"c{k}")) * F.exp(F.col(f"rb{k}") - F.col(f"r{k}") * (F.col(f"t{k}") + 1))
        upper = F.least(F.floor((1 - F.exp(-a)) * F.lit(2.0**32)), F.lit((1 << 32) - 1)) - F.lit(1 << 31)
        name = F.col(f"h{k}").bitwiseXOR(F.col(f"t{k}") * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(F.col(f"t{k}").isNotNull(), F.shiftleft(upper, 32).bitwiseOR(name)).otherwise(F.col(f"h{k}"))

    out = out.select(*kept, "term", "grp", "few", *[packed(k).alias(f"v{k}") for k in each])
    return out.select(*kept, "grp", *[F.when(light, F.xxhash64("term", "grp", F.lit(2 * i))).when(F.col("few") == i // FEW, F.col(f"v{i % FEW}")).alias(f"d{i}") for i in range(DRAWS)])


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the id: a coarse step, then the bounds within it."""
    step = max(1, int(len(bounds) ** 0.5))
    if not bounds:
        return F.lit(0)
    coarse = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[::step]]), lambda x: x <= doc_id))
    fine = F.size(F.filter(F.slice(F.array(*[F.lit(b) for b in bounds]), (coarse - 1) * step + 1, step), lambda x: x <= doc_id))
    return F.coalesce(F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(0), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds part, at (place in the part), guard and next (the next document's text, after the last the first's).

    A range starts at an id of the table, so its first document is known without looking:
    a copy of it stands guard at the end of the range before, and serves as the last one's next.
    """
    spark = docs.sparkSession
    n = max(16, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000), F.count_if(F.col("doc_id").isNull())).first()
    low, nulls = found[0], found[2]
    bounds = sorted({b for b in found[1] or [] if b > low or nulls})
    part = range_of(F.col("doc_id"), bounds)
    first = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    lowest = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    places = F.array_compact(
        F.array(
            F.struct(F.col("part"), F.lit(0).alias("guard")),
            F.when(first, F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("guard"))),
            F.when(lowest, F.struct(F.lit(len(bounds)).alias("part"), F.lit(2).alias("guard"))),
        )
    )
    dealt = docs.withColumn("part", part).withColumn("place", F.explode(places)).select("doc_id", "text", "place.part", "place.guard").repartition(n, "part")
    order = Window.partitionBy("part").orderBy("guard", "doc_id", "text")
    return dealt.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents (doc_id, text).

    The edited text: the last quarter of the code points replaced by the first as many of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = with_next(docs).withColumn("edited", F.when(F.col("guard") == 0, edited)).withColumn("sha", F.sha2("edited", 256))
    # Words that end before the cut are those of both texts; of a guard only the text is asked for.
    rows = rows.withColumn("head", F.when(F.col("guard") == 0, F.length(F.regexp_extract(F.substring("text", F.lit(1), n - cut), HEAD, 0))).otherwise(0))
    after = lambda c: F.substring(c, F.col("head") + 1, F.length(c))
    none = F.lit(None)

    def entry(kind: int, body: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.cast("string").alias("body"), value.cast("long").alias("value"))

    # Kinds 0 and 1 are what the two texts have apart; the others carry a document's own values past the count of its words.
    sha = [F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10) for i in range(8)]
    entries = [entry(BOTH, F.substring("text", F.lit(1), F.col("head")), F.lit(1)), entry(0, after(F.col("text")), F.lit(1)), entry(1, after(F.col("edited")), F.lit(1))]
    entries += [entry(2 + i, none, v) for i, v in enumerate([*sha, n, F.col("doc_id"), F.col("guard")])]
    words = rows.select("part", "at", F.explode(F.array(*entries)).alias("e")).select(
        "part", "at", "e.kind", "e.value", F.explode(F.split(F.coalesce("e.body", F.lit("-")), SPACE)).alias("word")
    )
    counted = (
        words.where((F.col("kind") > 1) | (F.col("word") != ""))
        .select("part", "at", F.when(F.col("kind") > 1, F.col("kind")).otherwise(0).alias("mark"), F.when(F.col("kind") > 1, F.lit(0).cast("long")).otherwise(F.xxhash64("word")).alias("term"), "kind", "value")
        .groupBy("part", "at", "mark", "term")
        .agg(F.sum(F.when(F.col("kind") != 1, F.col("value"))).alias("w"), F.sum(F.when(F.col("kind").isin(BOTH, 1), F.col("value"))).alias("w_edited"))
    )
    # Sides: 0 the text, 1 the edited text, 2 both with one weight.
    is_term = F.col("mark") == 0
    on = lambda weight, side: F.struct(weight.alias("weight"), F.lit(side).alias("side"))
    same = F.col("w") == F.col("w_edited")
    sides = F.when(~is_term | F.col("w_edited").isNull(), F.array(on(F.col("w"), 0))).when(F.col("w").isNull(), F.array(on(F.col("w_edited"), 1))).when(same, F.array(on(F.col("w"), 2)))
    uses = counted.select("part", "at", "mark", "term", F.explode(sides.otherwise(F.array(on(F.col("w"), 0), on(F.col("w_edited"), 1)))).alias("u"))
    rows_of = lambda groups, fews: F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(f).alias("few")) for g in groups for f in fews])
    own = F.array(F.struct((F.col("mark") + OWN).alias("grp"), F.lit(-1).alias("few")))
    places = F.when(~is_term, own).when(F.col("u.weight") == 1, rows_of(range(GROUPS), [-1])).otherwise(rows_of(range(GROUPS), range(DRAWS // FEW)))
    asked = uses.select("part", (F.col("at") * 4 + F.col("u.side")).alias("doc"), "mark", "term", "u.weight", F.explode(places).alias("p")).select("part", "doc", "mark", "term", "weight", "p.*")
    drawn = draws(asked.withColumn("own", F.when(~is_term, F.col("weight"))), ["part", "doc", "own"])
    # A document's own value takes the place of its first draw.
    drawn = drawn.withColumn("d0", F.when(F.col("grp") < OWN, F.col("d0")).otherwise(F.col("own")))
    by_side = drawn.groupBy("part", "doc", "grp").agg(*[F.min(f"d{i}").alias(f"d{i}") for i in range(DRAWS)])
    side = F.col("doc") % 4
    mins = [F.min(F.when(side != other, F.col(f"d{i}"))).alias(f"{name}{i}") for name, other in (("x", 1), ("y", 0)) for i in range(DRAWS)]
    sampled = by_side.groupBy("part", F.floor(F.col("doc") / 4).alias("at"), "grp").agg(*mins)
    side = [F.array(*[F.col(f"{c}{i}") for i in range(DRAWS)]).alias(c) for c in "xy"]
    whole = (
        sampled.select("part", "at", F.struct("grp", *side).alias("g"))
        .groupBy("part", "at")
        .agg(F.array_sort(F.collect_list("g"), lambda p, q: p.grp - q.grp).alias("gs"))  # GROUPS and the own values
    )

    def hexed(column: Column, width: int) -> Column:
        return F.lower(F.lpad(F.hex(column), width, "0"))

    def names(side: str) -> Column:
        got = F.flatten(F.transform(F.filter("gs", lambda g: g.grp < OWN), lambda g: g[side]))
        return F.when(F.size(got) > 0, F.transform(got, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array_repeat(F.lit(None).cast("long"), GROUPS * DRAWS))

    def likeness(a: str, b: str) -> Column:
        pairs = F.filter(F.arrays_zip(F.col(a).alias("p"), F.col(b).alias("q")), lambda z: z.p.isNotNull() | z.q.isNotNull())
        return F.when(F.size(pairs) == 0, 1.0).otherwise(F.size(F.filter(pairs, lambda z: z.p == z.q)) / F.size(pairs))

    own = F.transform(F.filter("gs", lambda g: g.grp >= OWN), lambda g: g.x[0])
    order = Window.partitionBy("part").orderBy("at")
    out = whole.select("part", "at", own.alias("own"), names("x").alias("a"), names("y").alias("b")).withColumn("next", F.lead("a").over(order))
    joined = lambda c: F.array_join(F.transform(c, lambda x: hexed(F.coalesce(x, F.lit(0).cast("long")), 8)), "")
    return out.where(F.col("own")[10] == 0).select(
        F.col("own")[9].alias("doc_id"),
        F.col("own")[8].alias("n_chars"),
        F.array_join(F.transform(F.slice("own", 1, 8), lambda x: hexed(x, 8)), "").alias("edited_sha256"),
        joined("a").alias("fingerprint"),
        joined("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"),
        likeness("a", "next").alias("near_next"),
    )
