"""Secret scan: written patterns, and sliding-window entropy by character class with an allow-list (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import table

#: Kind, pattern, and group and length that a match must have, else it is dropped. Runs of one class are matched from that
#: length on, which finds the same ones; an assignment's short value uses up its text, so it is matched first and dropped then.
BASE = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Characters of a window.
WINDOW = 24
#: Strings that may be secrets: runs of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
#: Kind, class of characters, alphabet in which they are counted (lower-cased or not), bits a character from which a window is odd.
CLASSES = (
    ("entropy_hex", r"[0-9A-Fa-f]{24,}", "0123456789abcdef", True, 3.05),
    ("entropy_base36", r"[0-9a-z]{24,}", "0123456789abcdefghijklmnopqrstuvwxyz", False, 3.75),
    ("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", False, 4.05),
)
#: Candidates in which one of these is nowhere found are harmless: words and numbers of up to four digits with separators between; numbers.
#: Looked for rather than matched as a whole, since a repeated group may overflow the stack on a long text.
ABSENT = (r"[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}|^[+/_=-]", r"[A-Za-z]|^[+/_=-]")
#: So are those in which one of these is found: UUIDs, named digests.
PRESENT = (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", r"^sha(?:1|224|256|384|512)[_=-]")
#: Stand-ins for a secret, in candidates of at most STAND_IN characters.
STAND_INS = r"example|placeholder|changeme|dummy|xxxxxxxx|00000000|abcdefgh|01234567|12345678"
STAND_IN = 64
KINDS = tuple(k for k, *_ in (*BASE, *CLASSES))
UNIT = 1_000_000
#: n * log2(n) in millionths, for n up to WINDOW: sums of whole numbers don't depend on their order.
TERMS = tuple(round(UNIT * n * math.log2(n)) if n else 0 for n in range(WINDOW + 1))
#: Numbers added up in one block of a running sum.
BLOCK = 256
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even where the body uses it in loops."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """Sums of the first 1, 2, 3... values, in blocks, so that long arrays aren't copied for each value."""

    def sums(start: Column, chunk: Column) -> Column:
        return F.slice(F.aggregate(chunk, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(2), F.size(chunk))

    def blocks(v: Column) -> Column:
        n = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        within = lambda b: F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(v)) - 1)
        return _let(F.transform(F.sequence(F.lit(0), n), lambda b: F.transform(within(b), lambda i: v[i])), joined)  # a slice would copy all of v

    def joined(chunks: Column) -> Column:
        zero = F.lit(0).cast("long")
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
        before = F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return _let(before, lambda at: F.flatten(F.transform(chunks, lambda c, i: sums(at[i], c))))

    return _let(values, blocks)


def _places(text: Column, pattern: str, then: Callable[[Column, Column, Column], Column], group: int = 0, least: int = 0) -> Column:
    """``then`` (match, start, end) of each leftmost non-overlapping match of ``pattern`` whose group is long enough, as one array.

    The text is cut at the matches: a match starts after all cuttings and matches before it.
    """
    p = F.lit(pattern)

    def found(matches: Column) -> Column:
        def cut(pieces: Column) -> Column:
            gaps = F.transform(matches, lambda m, i: (F.length(pieces[i]) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(F.lit(0))).cast("long"))
            return _let(_running(gaps), lambda starts: F.transform(matches, lambda m, i: F.struct(m.alias("m"), starts[i].alias("at"))))

        return F.when(F.size(matches) > 0, _let(F.split(text, pattern, -1), cut)).otherwise(F.array().cast("array<struct<m:string,at:bigint>>"))

    placed = _let(F.regexp_extract_all(text, p, F.lit(0)), found)
    if group:
        groups = F.regexp_extract_all(text, p, F.lit(group))
        placed = _let(groups, lambda g: F.filter(placed, lambda x, i: F.length(F.get(g, i)) >= least))
    return F.transform(placed, lambda x: then(x["m"], x["at"], x["at"] + F.length(x["m"])))


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))


def _windows(run: Column, alphabet: str, fold: bool, bits: float) -> Column:
    """Spans [(start, end)] of a run of one class covered by windows of at least ``bits`` a character.

    The window moves by one character: the one that enters and the one that leaves change their counts, and with them the sum of
    n * log2(n) over the window, from which the entropy follows.
    """
    limit = math.floor(UNIT * WINDOW * (math.log2(WINDOW) - bits))
    terms = F.array(*[F.lit(t) for t in TERMS])
    codes = F.transform(F.split(F.lower(run) if fold else run, ""), lambda c: F.call_function("instr", F.lit(alphabet), c))
    start = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("open"), F.lit(-1).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def move(acc: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]
        more = F.get(acc["n"], come - 1)
        less = F.coalesce(F.get(acc["n"], go - 1), F.lit(0))
        same = come == go
        counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda n, k: n + (k == come - 1).cast("int") - (k == go - 1).cast("int")))
        change = F.get(terms, more + 1) - F.get(terms, more) + F.when(go > 0, F.get(terms, F.greatest(less - 1, F.lit(0))) - F.get(terms, less)).otherwise(F.lit(0))
        total = (acc["sum"] + F.when(same, F.lit(0)).otherwise(change)).cast("long")
        first = acc["i"] - (WINDOW - 1)
        hit = (first >= 0) & (total <= limit)
        anew = hit & (first > acc["end"])
        return F.struct(
            (acc["i"] + 1).alias("i"), counts.alias("n"), total.alias("sum"), F.when(anew, first).otherwise(acc["open"]).alias("open"), F.when(hit, acc["i"] + 1).otherwise(acc["end"]).alias("end"),
            F.when(anew & (acc["open"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]).alias("out"),
        )

    def last(acc: Column) -> Column:
        return F.when(acc["open"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])

    def pairs(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.struct(x.alias("come"), F.when(i >= WINDOW, F.get(c, i - WINDOW)).otherwise(F.lit(0)).alias("go")))

    return F.aggregate(_let(codes, pairs), start, move, last)


def _harmless(candidate: Column) -> Column:
    out = (F.length(candidate) <= STAND_IN) & F.regexp_like(F.lower(candidate), F.lit(STAND_INS))
    for pattern in ABSENT:
        out = out | ~F.regexp_like(candidate, F.lit(pattern))
    for pattern in PRESENT:
        out = out | F.regexp_like(candidate, F.lit(pattern))
    return out


def _odd(text: Column) -> Column:
    """Spans of the classes in candidates that the allow-list doesn't know."""

    def of(candidate: Column, at: Column, _: Column) -> Column:
        found = []
        for k, (_, chars, alphabet, fold, bits) in enumerate(CLASSES, len(BASE)):

            def spans(run: Column, start: Column, _: Column, k=k, alphabet=alphabet, fold=fold, bits=bits) -> Column:
                return F.transform(_windows(run, alphabet, fold, bits), lambda s: _span(k, at + start + s["start"], at + start + s["end"]))

            found.append(F.flatten(_places(candidate, chars, spans)))
        return F.when(_harmless(candidate), F.array().cast(SPAN)).otherwise(F.concat(*found))

    return F.flatten(_places(text, CANDIDATE, of))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets of each document (doc_id, text), in code points, the end exclusive.

    Base kinds are patterns. Beside them, every run of a character class inside a candidate string is walked by a window of 24 characters; where
    the Shannon entropy of a window reaches the class's bound, its characters belong to a span of that class, unless the whole candidate is
    on the allow-list. A span that lies within a base span or a span of a class listed before says nothing new and is left out; base spans always stay.
    Null and empty texts have no spans and an empty list, rows that repeat a doc_id are returned each, extra columns
    are left out, and an empty table gives an empty one. All work is inside the row: no shuffle, no Python.
    """
    text = F.col("text")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    places = [_places(text, p, lambda m, a, b, k=k: _span(k, a, b), group, least if group else 0) for k, (_, p, group, least) in enumerate(BASE)]
    seen = docs.select("doc_id", *[c.alias(f"b{k}") for k, c in enumerate(places)], _odd(text).alias("odd"))

    def news(spans: Column, base: Column) -> Column:
        def told(x: Column) -> Column:
            return F.exists(F.concat(base, F.filter(spans, lambda y: y["kind"] < x["kind"])), lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))

        return F.filter(spans, lambda x: ~told(x))

    base = F.concat("b0", "b1", "b2")
    added = F.when(F.size("odd") > 0, _let(base, lambda b: news(F.col("odd"), b))).otherwise(F.col("odd"))
    both = seen.select("doc_id", *[F.size(f"b{k}").cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)], base.alias("base"), added.alias("added"))
    return both.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_entropy"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document's whole text."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql_places(source: str, column: str, pattern: str, keys: str) -> str:
    """(keys, m, pos): matches of a pattern and where they start, in code points."""
    p = pattern.replace("'", "''")
    return f"""SELECT {keys}, ms[i] AS m, list_sum([length(p) FOR p IN ps[:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN ms[:i - 1]]), 0)::BIGINT AS pos
  FROM (SELECT {keys}, regexp_extract_all({column}, '{p}') AS ms, string_split_regex({column}, '{p}') AS ps FROM {source}) q, unnest(range(1, len(ms) + 1)) u(i)"""


def _oracle() -> str:
    base = [f"SELECT rid, {k} AS kind, pos AS s, pos + length(m) AS e FROM ({_sql_places('texts', 'x', p, 'rid')})" + (" WHERE length(regexp_extract(m, '{}', {})) >= {}".format(p.replace("'", "''"), g, n) if g else "") for k, (_, p, g, n) in enumerate(BASE)]
    harmless = " OR ".join([f"(length(m) <= {STAND_IN} AND regexp_matches(lower(m), '{STAND_INS}'))", *[f"NOT regexp_matches(m, '{p}')" for p in ABSENT], *[f"regexp_matches(m, '{p}')" for p in PRESENT]])
    runs = " UNION ALL ".join(f"SELECT rid, {k} AS kind, {bits}::DOUBLE AS bits, cat + pos AS pos, {'lower(m)' if fold else 'm'} AS m FROM ({_sql_places('candidates', 'c', p, 'rid, cat')})" for k, (_, p, _, fold, bits) in enumerate(CLASSES, len(BASE)))
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    joined = f"coalesce(string_agg({kinds}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind), '')"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
base AS ({" UNION ALL ".join(base)}),
candidates AS (SELECT rid, m AS c, pos AS cat FROM ({_sql_places('texts', 'x', CANDIDATE, 'rid')}) WHERE NOT ({harmless})),
runs AS ({runs}),
hits AS (SELECT rid, kind, pos, pos + i AS s FROM runs, unnest(range(0, length(m) - {WINDOW} + 1)) u(i) WHERE list_aggregate(string_split(substr(m, i + 1, {WINDOW}), ''), 'entropy') >= bits),
gaps AS (SELECT *, s > lag(s, 1, -{10**9}) OVER (PARTITION BY rid, kind, pos ORDER BY s) + {WINDOW} AS anew FROM hits),
islands AS (SELECT *, sum(anew::INT) OVER (PARTITION BY rid, kind, pos ORDER BY s) AS g FROM gaps),
odd AS (SELECT rid, kind, min(s) AS s, max(s) + {WINDOW} AS e FROM islands GROUP BY rid, kind, pos, g),
known AS (SELECT * FROM base UNION ALL SELECT * FROM odd),
added AS (SELECT * FROM odd o WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.rid = o.rid AND k.kind < o.kind AND k.s <= o.s AND k.e >= o.e)),
based AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c, {joined} AS j FROM base GROUP BY rid),
every AS (SELECT rid, {joined} AS j, count(*) FILTER (WHERE kind >= {len(BASE)}) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(based.j, '')) AS base_sha256,
  coalesce(every.j, '') AS spans, coalesce(n, 0)::BIGINT AS n_entropy
FROM texts LEFT JOIN based USING (rid) LEFT JOIN every USING (rid)
"""


ORACLE_SQL = _oracle()
