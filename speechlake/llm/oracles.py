"""SQL for the other engine of operators that joins and aggregates can express. Written apart from the operators."""

from __future__ import annotations


def crc32(value: str) -> str:
    """The unsigned crc32 of a value's text, for text of ASCII characters: a fold over characters and, inside, over bits."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))"
    chars = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], {chars}), lambda a, b: {bits}), 4294967295)"


def _levels(name: str, levels: int) -> list[str]:
    """Nodes name0 (g, i, n, h) to name<levels>, and their siblings: a tree that is down to one node stays as it is."""
    out = []
    for k in range(levels):
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}_by{k} AS MATERIALIZED (
            SELECT g, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}
        )""")
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
            SELECT g, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
            FROM {name}{k} GROUP BY g, i // 8, n
        )""")
    return out


def _folds(name: str, first: str, levels: int) -> list[str]:
    """From rows `first` (id, g, i, fold, proof) up the levels: siblings go to the proof and into the fold."""
    out, last = [], first
    for k in range(levels):
        out.append(f"""{name}_up{k} AS MATERIALIZED (
            SELECT f.* REPLACE (f.i // 8 AS i, CASE WHEN s.n > 1 THEN sha256(concat(l, fold, r)) ELSE fold END AS fold, concat(proof, l, r) AS proof)
            FROM {last} f JOIN {name}_by{k} s ON f.g = s.g AND f.i = s.i
        )""")
        last = f"{name}_up{k}"
    return out


def merkle(levels: int = 9, wide: int = 3) -> str:
    """A table of nodes a level; room for 8 ** levels rows of a language and 8 ** wide languages."""

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(CAST({f} AS VARCHAR)), ':', {f}), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""leaves AS MATERIALIZED (
            SELECT row_number() OVER () AS id, doc_id, coalesce('1' || lang, '0') AS g, {leaf("text")} AS leaf,
                   CASE WHEN {crc32("doc_id")} % 3 = 0 THEN {leaf(lower)} END AS changed FROM documents
        )""",
        """a0 AS MATERIALIZED (
            SELECT id, doc_id, g, leaf AS h, changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves
        )""",
        *_levels("a", levels),
        f"b0 AS MATERIALIZED (SELECT g AS own, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{levels})",
        *_levels("b", wide),
        "lowest AS (SELECT id, doc_id, g, i, h AS leaf, coalesce(changed, h) AS fold, '' AS proof FROM a0)",
        *_folds("a", "lowest", levels),
        f"middle AS (SELECT u.id, u.doc_id, u.leaf, b0.h AS subroot, u.fold, u.proof, b0.g, b0.i FROM a_up{levels - 1} u JOIN b0 ON u.g = b0.own)",
        *_folds("b", "middle", wide),
    ]
    return "WITH " + ", ".join(steps) + f"""
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
        FROM b_up{wide - 1} JOIN (SELECT h FROM b{wide}) ON true"""


#: Units by the characters at which they end: a text's first units are the characters before a cut.
FILL_IN_MIDDLE = """
    WITH unit AS (
        SELECT doc_id, i, sum(length(u)) OVER (PARTITION BY copy ORDER BY i) AS stop, copy
        FROM (SELECT doc_id, copy, regexp_extract_all(text, '([A-Za-z]+|[^A-Za-z])', 1) AS us FROM (SELECT *, row_number() OVER () AS copy FROM documents WHERE text <> '')), unnest(us) WITH ORDINALITY AS t(u, i)
    ), ends AS (
        SELECT copy, count(*) AS n, list(stop ORDER BY i) AS stops FROM unit GROUP BY copy
    ), texts AS (
        SELECT d.doc_id, text, n, list_prepend(0, stops) AS stops FROM (SELECT *, row_number() OVER () AS copy FROM documents WHERE text <> '') d JOIN ends USING (copy)
        UNION ALL SELECT doc_id, '', 0, [0] FROM documents WHERE coalesce(text, '') = ''
    ), cut AS (
        SELECT *, CAST('0x' || digest[1:8] AS UBIGINT) % (n + 1) AS p1, CAST('0x' || digest[9:16] AS UBIGINT) % (n + 1) AS p2,
               CAST('0x' || digest[17:24] AS UBIGINT) % 100 AS p3, CAST('0x' || digest[25:32] AS UBIGINT) % 100 AS p4
        FROM (SELECT *, sha256(concat('1:', doc_id)) AS digest FROM texts)
    ), formed AS (
        SELECT *, CAST(stops[CAST(least(p1, p2) AS BIGINT) + 1] AS BIGINT) AS a, CAST(stops[CAST(greatest(p1, p2) AS BIGINT) + 1] AS BIGINT) AS b,
               CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR p3 >= 90 THEN 'plain' WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM cut
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                  WHEN 'psm' THEN concat('<P>', substring(text, 1, a), '<S>', substring(text, b + 1), '<M>', substring(text, a + 1, b - a))
                  ELSE concat('<S>', substring(text, b + 1), '<P>', substring(text, 1, a), '<M>', substring(text, a + 1, b - a)) END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM formed"""
