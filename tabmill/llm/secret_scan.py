"""Secret scan with DataFrame functions only.

Three base patterns give exact spans in code points.  The method adds spans
by sliding-window entropy: candidate strings of a character class are walked
once, the counts of the window's characters are kept up to date by the
character that enters and the one that leaves, and with them the sum of c *
log2(c), which gives the window's Shannon entropy.  Windows above the class's
threshold are merged into spans.  Candidates that match the allow-list
(words, UUIDs, paths, examples) add nothing; base spans are never suppressed.

Defined results: null counts as empty; texts without findings have counts of
0 and an empty list; repeated rows are rows; an empty table gives no rows;
other columns pass through unread, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabmill.llm.common import fresh, text_or_empty

#: Kind, pattern, group whose length counts (0: the match), least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``chars`` of at least ``window`` characters;
    a window counts from ``bits`` of entropy on."""
    kind: str
    pattern: str
    chars: str
    window: int
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", "[0-9A-Fa-f]", _DIGITS + "abcdefABCDEF", 16, 2.9),
    CharClass("entropy_base64", "[A-Za-z0-9+/_=-]", _LOWER + _LOWER.upper() + _DIGITS + "+/_=-", 20, 3.9),
)
#: Candidates that are no secrets.
ALLOW = (
    r"^[A-Z]?[a-z]+$", r"^[A-Z]+$", r"^[0-9]+$", r"^[a-z]+([_-][a-z]+)+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"^[A-Za-z_-]*(/[A-Za-z_-]+)+/?$", r"(?i:example|placeholder|xxxx)",
)
#: Items of a chunk in running sums over arrays, which keeps them from growing with the square of the length.
CHUNK = 512


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _starts(items: Column) -> Column:
    """struct(gap, size, ...) per item to struct(s, e): where each lies."""
    def place(acc: Column, x: Column) -> Column:
        return _let(acc["at"] + x["gap"], lambda s: F.struct((s + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["size"]).alias("e")))).alias("out")))

    def chunk(acc: Column, k: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.expr("CAST(array() AS array<struct<s:int,e:int>>)").alias("out"))
        return _let(F.aggregate(F.slice(items, k * CHUNK + 1, CHUNK), start, place),
                    lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
    none = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<array<struct<s:int,e:int>>>)").alias("out"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.flatten(F.aggregate(chunks, none, chunk)["out"])


def _located(df: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """``out``: array of struct(s, e, v) of the leftmost non-overlapping
    matches; v is the group.  The text between matches comes from a split at
    the same pattern."""
    m, v, gaps, items = (fresh(df, f"{out}_{x}") for x in ("m", "v", "g", "i"))
    df = df.withColumns({m: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
                         v: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))})
    df = df.withColumn(gaps, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)))
    sizes = F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(m)), F.col(m), lambda g, x: F.struct(F.char_length(g).alias("gap"), F.char_length(x).alias("size")))
    df = df.withColumn(items, F.when(F.size(m) > 0, sizes))
    placed = F.zip_with(_starts(F.col(items)), F.col(v), lambda p, x: F.struct(p["s"].alias("s"), p["e"].alias("e"), x.alias("v")))
    none = F.expr("CAST(array() AS array<struct<s:int,e:int,v:string>>)")
    return df.withColumn(out, F.when(F.size(m) > 0, placed).otherwise(none)).drop(m, v, gaps, items)


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_spans(text: Column, cls: CharClass) -> Column:
    """Spans (struct s, e within the candidate) of merged windows whose
    entropy reaches the threshold, by incremental counts."""
    w, most = cls.window, cls.window * (math.log2(cls.window) - cls.bits)  # bits >= threshold: sum of c log2 c <= most
    zero = F.array_repeat(F.lit(0), len(cls.chars))

    def code(k: Column) -> Column:
        return F.instr(F.lit(cls.chars), F.substring(text, k, F.lit(1)))

    def step(acc: Column, k: Column) -> Column:
        def counted(io: Column) -> Column:
            grown = F.element_at(acc["n"], io["i"])
            shrunk = F.when(io["o"] > 0, F.element_at(acc["n"], F.greatest(io["o"], F.lit(1))))
            change = (F.when(io["i"] == io["o"], F.lit(0.0)).otherwise(
                _clog(grown + 1) - _clog(grown) + F.coalesce(_clog(shrunk - 1) - _clog(shrunk), F.lit(0.0))))
            n = F.transform(acc["n"], lambda c, j: c + F.when(j + 1 == io["i"], 1).otherwise(0) - F.when(j + 1 == io["o"], 1).otherwise(0))
            return _let(acc["sum"] + change, lambda s: F.struct(n.alias("n"), s.alias("sum"), merged(s).alias("out")))

        def merged(s: Column) -> Column:
            last, new = F.element_at(acc["out"], -1), F.struct((k - w).alias("s"), k.alias("e"))
            joins = (F.size(acc["out"]) > 0) & (F.coalesce(F.try_element_at(acc["out"], F.lit(-1))["e"], F.lit(-1)) >= k - w)
            return (F.when((k < w) | (s > most), acc["out"])
                    .when(joins, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["s"].alias("s"), k.alias("e")))))
                    .otherwise(F.concat(acc["out"], F.array(new))))
        return _let(F.struct(code(k).alias("i"), F.when(k > w, code(k - w)).otherwise(F.lit(0)).alias("o")), counted)
    start = F.struct(zero.alias("n"), F.lit(0.0).alias("sum"), F.expr("CAST(array() AS array<struct<s:int,e:int>>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(text)), start, step)["out"]


def scan(df: DataFrame, text_col: str = "text", out: str = "found", allow: tuple[str, ...] = ALLOW,
         classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """``df`` with ``out``: array of struct(start, rank, kind, end) in order
    of start, then of the kind as listed."""
    text = fresh(df, "text")
    df = df.withColumn(text, text_or_empty(text_col))
    parts, drop = [], [text]

    def spans(col: str, rank: int, kind: str) -> Column:
        return F.transform(F.col(col), lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("end")))
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        col = fresh(df, kind)
        df = _located(df, text, pattern, col, group)
        df = df.withColumn(col, F.filter(F.col(col), lambda x: F.char_length(x["v"]) >= least))
        parts.append(spans(col, rank, kind))
        drop.append(col)
    for rank, cls in enumerate(classes, len(BASE)):
        col = fresh(df, cls.kind)
        df = _located(df, text, f"{cls.pattern}{{{cls.window},}}", col)
        wanted = F.filter(F.col(col), lambda x: ~F.array_contains(F.array(*[x["v"].rlike(a) for a in allow]), F.lit(True)) if allow else F.lit(True))
        found = F.flatten(F.transform(wanted, lambda x: F.transform(
            hot_spans(x["v"], cls), lambda h: F.struct((x["s"] + h["s"]).alias("s"), (x["s"] + h["e"]).alias("e")))))
        df = df.withColumn(col, found)
        parts.append(spans(col, rank, cls.kind))
        drop.append(col)
    return df.withColumn(out, F.array_sort(F.concat(*parts))).drop(*drop)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op4, one row per document."""
    found = scan(docs.select("doc_id", "text"))
    n = {f"n_{kind}": _count(r) for r, (kind, *_) in enumerate(BASE)}
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *[c.alias(k) for k, c in n.items()],
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def _count(rank: int) -> Column:
    return F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("long")


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def query_sql() -> str:
    """DuckDB twin: the windows are written out and measured one by one."""
    kinds = [(r, k, p, g, n) for r, (k, p, g, n) in enumerate(BASE)]
    kinds += [(r, c.kind, f"{c.pattern}{{{c.window},}}", 0, c.window) for r, c in enumerate(CLASSES, len(BASE))]
    hits = " UNION ALL ".join(f"""
      SELECT doc_id, {r} AS rank, '{k}' AS kind, unnest(regexp_extract_all(text, {_sql_literal(p)})) AS m,
             unnest(regexp_extract_all(text, {_sql_literal(p)}, {g})) AS v, unnest(string_split_regex(text, {_sql_literal(p)})) AS gap,
             generate_subscripts(string_split_regex(text, {_sql_literal(p)}), 1) AS i
      FROM d""" for r, k, p, g, n in kinds)
    allow = " OR ".join(f"regexp_matches(v, {_sql_literal(a)})" for a in ALLOW)
    least = " ".join(f"WHEN {r} THEN {n}" for r, _, _, _, n in kinds)
    width = " ".join(f"WHEN {r} THEN {c.window}" for r, c in enumerate(CLASSES, len(BASE)))
    bits = " ".join(f"WHEN {r} THEN {c.bits}" for r, c in enumerate(CLASSES, len(BASE)))
    nb = len(BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS ({hits}),
p AS (SELECT doc_id, rank, kind, m, v, i,
             sum(length(gap) + length(coalesce(m, ''))) OVER (PARTITION BY doc_id, rank ORDER BY i) - length(coalesce(m, '')) AS s FROM h),
q AS (SELECT doc_id, rank, kind, v, i, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM p
      WHERE m IS NOT NULL AND length(v) >= CASE rank {least} END AND (rank < {nb} OR NOT ({allow}))),
c AS (SELECT *, CASE rank {width} END AS w, CASE rank {bits} END AS bits FROM q WHERE rank >= {nb}),
x AS (SELECT doc_id, rank, kind, i, s, w, bits, unnest(range(length(v) - w + 1)) AS k, v FROM c),
y AS (SELECT *, substring(v, k::INT + 1, w) AS win FROM x),
z AS (SELECT doc_id, rank, kind, i, s + k AS a, s + k + w AS b FROM y
      WHERE log2(w) - list_sum([(w - length(replace(win, ch, ''))) * log2(w - length(replace(win, ch, '')))
                                FOR ch IN list_distinct(string_split(win, ''))]) / w >= bits),
g AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY doc_id, rank, i ORDER BY a) THEN 0 ELSE 1 END AS head FROM z),
j AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, rank, i ORDER BY a) AS isle FROM g),
f AS (SELECT doc_id, rank, kind, s, e FROM q WHERE rank < {nb}
      UNION ALL SELECT doc_id, rank, kind, min(a), max(b) FROM j GROUP BY doc_id, rank, kind, i, isle),
l AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {nb}), '') AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l USING (doc_id)"""
