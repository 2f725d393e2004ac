"""Secret scans with linking of multipart credentials.

Plain patterns give the base findings. Weak parts (identifiers, key-like
tokens, endpoints) mean nothing alone; they are reported only where parts that
complement each other stand close together; for identifiers and endpoints an
assigned secret among the base findings counts as the other part. The parts become intervals, cut
into buckets of one scope, and an interval join within a document and its
neighbouring buckets finds the pairs. Everything is SQL functions and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid.llm.shared import stored

#: Base patterns: kind, pattern, and the smallest length of a group of the match.
BASE = {
    "assign": (
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak parts: kind and pattern.
WEAK = {
    "identifier": (
        # The first character is looked at alone, as most places fail there.
        r"""(?=[ACTact])(?:(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AKIA)[A-Z0-9]{8,}+"""
        r"""|(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:(?:client|tenant|account|access_?key)_?id)"""
        r"""["\']?\x20*[:=]\x20*["\']?[A-Za-z0-9._-]{6,}+)"""
    ),
    "key": r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])",
    "endpoint": r"""(?:https?|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[^\s"\'<>]{4,}+""",
}
#: Base findings that complement weak parts.
_COMPLEMENTS = ("access", "assign")
#: A key has letters of both cases and a digit.
_KEY_LIKE = "text RLIKE '[a-z]' AND text RLIKE '[A-Z]' AND text RLIKE '[0-9]'"
#: Parts link when the gap between them is no wider (code points). Parts have no
#: upper length, so their starts may be further apart.
SCOPE = 256
_ORDER = [*BASE, *WEAK]
_BLOCK = 256


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\'", "'").replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running_sums(values: str) -> str:
    """SQL: running sums of an array; blocks keep the cost far below its square."""
    block = f"slice({values}, b * {_BLOCK} + 1, {_BLOCK})"
    sums = f"transform(blocks, b -> aggregate({block}, 0, (a, v) -> a + v))"
    offsets = (
        "aggregate(sums, struct(0 AS p, cast(array() AS array<int>) AS s), "
        "(a, v) -> struct(a.p + v AS p, array_append(a.s, a.p) AS s), a -> a.s)"
    )
    inner = (
        f"aggregate({block}, struct(offsets[b] AS p, cast(array() AS array<int>) AS s), "
        "(a, v) -> struct(a.p + v AS p, array_append(a.s, a.p + v) AS s), a -> a.s)"
    )
    blocks = f"sequence(0, (size({values}) - 1) div {_BLOCK})"
    nested = f"flatten(transform(blocks, b -> {inner}))"
    for name, value in (("offsets", offsets), ("sums", sums), ("blocks", blocks)):
        nested = f"element_at(transform(array({value}), {name} -> {nested}), 1)"
    return f"if(size({values}) = 0, cast(array() AS array<int>), {nested})"


def _matches(df: DataFrame, pattern: str, out: str, *keep: str) -> DataFrame:
    """Adds ``out``: array of (start, end, text) of all matches, in code points.

    Splitting at the pattern gives the gaps, extracting gives the matches;
    their lengths add up to the positions.
    """
    p = _literal(pattern)
    maybe = f"coalesce(text RLIKE {p}, false)"
    found = df.selectExpr(
        *keep,
        "text",
        f"if({maybe}, regexp_extract_all(text, {p}, 0), cast(array() AS array<string>)) AS found",
    )
    found = found.selectExpr(
        *keep,
        "text",
        "found",
        f"if(size(found) = 0, cast(array() AS array<int>), transform(slice(split(text, {p}, -1), 1, "
        "size(found)), (g, i) -> length(g) + length(found[i]))) AS steps",
    )
    found = found.selectExpr(*keep, "text", "found", f"{_running_sums('steps')} AS ends")
    return found.selectExpr(
        *keep,
        "text",
        "transform(ends, (e, i) -> named_struct('start', e - length(found[i]), 'end', e, "
        f"'text', found[i])) AS {out}",
    )


def _base(docs: DataFrame) -> DataFrame:
    """Base findings of each row as arrays of (start, end), one per kind."""
    keep = ["doc_id", "text_key"]
    for kind, (pattern, group, least) in BASE.items():
        docs = _matches(docs, pattern, "hits", *keep)
        size = f"length(regexp_extract(m.text, {_literal(pattern)}, 1))" if group else "length(m.text)"
        docs = docs.selectExpr(
            *keep,
            "text",
            f"transform(filter(hits, m -> {size} >= {least}), m -> named_struct('start', m.start, "
            f"'rank', {_ORDER.index(kind)}, 'end', m.end, 'kind', '{kind}')) AS {kind}",
        )
        keep.append(kind)
    return docs.drop("text")


def _weak(docs: DataFrame) -> DataFrame:
    """Weak parts and their complements of the base as rows (doc_id, text_key, kind, start, end)."""
    # Only texts that hold an identifier or an endpoint can link anything.
    anchors = f"contains(text, '://') OR contains(text, 'AKIA') OR text RLIKE {_literal(WEAK['identifier'])}"
    docs = docs.where(anchors)
    parts = []
    for kind, pattern in [*WEAK.items(), *((k, BASE[k][0]) for k in _COMPLEMENTS)]:
        rows = _matches(docs, pattern, "hits", "doc_id", "text_key")
        # Below a plain explode the optimizer tests, and so computes, the matches a second time.
        rows = rows.selectExpr("doc_id", "text_key", "explode_outer(hits) AS m").where("m IS NOT NULL")
        rows = rows.selectExpr("doc_id", "text_key", f"'{kind}' AS kind", "m.start", "m.end", "m.text")
        if kind == "key":
            rows = rows.where(_KEY_LIKE)
        if kind in _COMPLEMENTS:
            _, group, least = BASE[kind]
            rows = rows.where(f"length(regexp_extract(text, {_literal(pattern)}, {group})) >= {least}")
        parts.append(rows.drop("text"))
    return reduce(DataFrame.union, parts).distinct()


def _linked(parts: DataFrame) -> DataFrame:
    """Weak parts with a complementary part within the scope, by an interval join."""
    one = parts.selectExpr(
        "*", f"explode(sequence(start div {SCOPE}, end div {SCOPE})) AS bucket"
    )
    near = parts.selectExpr(
        "doc_id AS d2", "text_key AS t2", "kind AS k2", "start AS s2", "end AS e2",
        f"explode(sequence((start - {SCOPE}) div {SCOPE}, (end + {SCOPE}) div {SCOPE})) AS b2",
    )
    complement = F.expr("""
        (kind = 'key' AND k2 IN ('identifier', 'access', 'endpoint'))
        OR (kind IN ('identifier', 'endpoint') AND k2 IN ('key', 'assign'))
    """)
    pair = (
        F.col("doc_id").eqNullSafe(F.col("d2"))
        & (F.col("text_key") == F.col("t2"))
        & (F.col("bucket") == F.col("b2"))
        & (F.greatest("start", "s2") - F.least("end", "e2") <= SCOPE)
        & complement
    )
    return one.join(near, pair, "left_semi").drop("bucket").distinct()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: base findings and linked weak parts.

    Returns doc_id, n_assign, n_access, n_hex, base and spans (arrays of
    (start, rank, end, kind), sorted; code points, end exclusive). A null text
    is empty. Rows are told apart by doc_id (null included) and text, so
    repeated rows repeat their result. Weak parts never replace or overlap
    base findings: a part that overlaps one is left out. Other columns are not read.
    """
    docs = docs.selectExpr(
        "doc_id", "xxhash64(coalesce(text, '')) AS text_key", "coalesce(text, '') AS text"
    )
    base = _base(docs)
    # Both sides of the interval join read the parts, which are found once.
    linked = _linked(stored(_weak(docs))).groupBy("doc_id", "text_key").agg(
        F.collect_set(
            F.struct(
                "start",
                F.expr(f"array_position(array({', '.join(map(repr, _ORDER))}), kind) - 1")
                .cast("int")
                .alias("rank"),
                "end",
                "kind",
            )
        ).alias("extra")
    )
    same = F.col("b.doc_id").eqNullSafe(F.col("l.doc_id")) & (
        F.col("b.text_key") == F.col("l.text_key")
    )
    joined = base.alias("b").join(linked.alias("l"), same, "left")
    joined = joined.selectExpr(
        "b.doc_id AS doc_id",
        *[f"cast(size({k}) AS bigint) AS n_{k}" for k in BASE],
        f"array_sort(concat({', '.join(BASE)})) AS base",
        "extra",
    )
    return joined.selectExpr(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        "base",
        "if(extra IS NULL, base, array_sort(concat(base, filter(extra, e -> "
        "NOT exists(base, s -> s.start < e.end AND e.start < s.end))))) AS spans",
    )


def span_text(column: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    return (
        f"array_join(transform({column}, s -> concat_ws(':', s.kind, "
        "cast(s.start AS string), cast(s.end AS string))), ',')"
    )
