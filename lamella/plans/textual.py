"""Queries of text cleaning, structure and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions import arrow, text
from lamella.functions.workers import workers_import
from lamella.operators import dispatch, ledger, providers
from lamella.plans.base import Listing
from lamella.sources.tables import table

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql


def docs(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    workers_import(spark)
    return table(spark, sf_dir, "documents", "doc_id", "text", *also)


@listing.add(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t\x0B\f\r \x1C-\x1F\x{85}\x{A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)
SELECT doc_id, regexp_replace(t, '^[ \n]+|[ \n]+\z', '', 'g') AS clean FROM c""")
def plain_clean(spark, sf_dir):
    """Every document's text with white space put in order."""
    return docs(spark, sf_dir).select("doc_id", text.plain_clean(F.col("text")).alias("clean"))


@listing.add(r"SELECT doc_id, regexp_replace(text, '(^|[^:/\p{L}\p{N}\p{M}_])/(?:[\p{L}\p{N}\p{M}_.-]+/)*[\p{L}\p{N}\p{M}_.-]+', '\1[redacted-path]', 'g') AS safe FROM documents")
def path_redact(spark, sf_dir):
    """Texts without absolute paths."""
    return docs(spark, sf_dir).select("doc_id", text.path_redacted(F.col("text")).alias("safe"))


@listing.add()
def secret_redact(spark, sf_dir):
    """Texts without connection URLs, signatures, secret headers, bearer values and paths; five patterns in order, tested against Python's."""
    return docs(spark, sf_dir).select("doc_id", text.secret_redacted(F.col("text")).alias("safe"), text.unsafe(F.col("text")).alias("unsafe"))


UNITS = ("'g0:b' || doc_id", "'Root-' || doc_id", "'G2.b0001'", "'paragraph/' || doc_id", "'sec-' || doc_id", "'struct:granularity=1/b3'", "(doc_id % 3) || '_b' || doc_id", "'granularity-2:' || doc_id", "'g3:leaf'", "doc_id || '.root'")
UNIT = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN {u}" for i, u in enumerate(UNITS)) + " END"


@listing.add(rf"""WITH u AS (SELECT doc_id, lower({UNIT}) AS unit_id FROM documents),
n AS (SELECT *, coalesce(nullif(regexp_extract(unit_id, '(?:^|[._:/-])g(?:ranularity)?[=_:-]?([012])(?:$|[._:/-])', 1), ''), nullif(regexp_extract(unit_id, '^(?:granularity[=_:-]?)?([012])(?:[._:/-]|$)', 1), '')) AS number FROM u)
SELECT doc_id, CASE WHEN number IS NOT NULL THEN number::INTEGER WHEN regexp_matches(unit_id, 'root|document|full') THEN 0 WHEN regexp_matches(unit_id, 'leaf|sentence|paragraph|fragment') THEN 2 ELSE 1 END AS granularity FROM n""")
def granularity_infer(spark, sf_dir):
    """Layers of unit ids in several spellings."""
    return docs(spark, sf_dir).select("doc_id", text.granularity_of(F.expr(UNIT)).alias("granularity"))


@listing.add(r"""SELECT doc_id, '/stub ' || substr(sha256(text), 1, 16) || ' ' || substr(trim(regexp_extract(text, '([^\n]*[^\s][^\n]*)', 1), ' '), 1, 200) AS summary FROM documents""")
def stub_summary(spark, sf_dir):
    """Placeholder summaries: a mark, the text's digest, its first line that isn't blank."""
    return docs(spark, sf_dir).select("doc_id", text.stub_summary(F.col("text"), "/stub ").alias("summary"))


@listing.add("SELECT doc_id, CASE WHEN starts_with(text, source || ': ') THEN substr(text, length(source) + 3) ELSE text END AS body FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN source || ': ' || text ELSE text END AS text FROM documents)")
def without_header(spark, sf_dir):
    """Texts without the header that stands before some of them."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    header = F.concat("source", F.lit(": "))
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(header, "text")).otherwise(F.col("text"))
    return d.select("doc_id", text.without_header(given, header).alias("body"))


@listing.add("""SELECT doc_id, 'bearer=Bearer [REDACTED];lang=' || lang || ';note=see [REDACTED_PATH];password=[REDACTED]' AS safe FROM documents""")
def secret_map(spark, sf_dir):
    """Maps without secrets, by key or by what the value looks like."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    m = F.create_map(F.lit("password"), "source", F.lit("lang"), "lang", F.lit("note"), F.concat(F.lit("see /srv/"), F.col("doc_id").cast("string")), F.lit("bearer"), F.concat(F.lit("bearer abc."), F.col("doc_id").cast("string")))
    pairs = F.array_sort(F.map_entries(text.secret_map(m)))
    return d.select("doc_id", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("safe"))


@listing.add("SELECT doc_id, CASE WHEN length(text) <= 480 THEN text ELSE rtrim(substr(text, 1, 479)) || '…' END AS summary FROM documents")
def truncate_summary(spark, sf_dir):
    """Summaries of at most 480 letters."""
    return docs(spark, sf_dir).select("doc_id", text.truncated_summary(F.col("text")).alias("summary"))


@listing.add("SELECT doc_id, 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || chr(10) || text AS content FROM documents")
def content_full(spark, sf_dir):
    """Texts under a header of sorted metadata lines."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return d.select("doc_id", text.content_full(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"), F.col("text")).alias("content"))


@listing.add(r"""WITH s AS (SELECT doc_id, CASE WHEN len(regexp_split_to_array(text, '\n[ \t]*\n')) > 1 THEN list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(x) <> '')
  ELSE list_filter([substr(text, 1, ceil(length(text) / 2.0)::INTEGER), substr(text, ceil(length(text) / 2.0)::INTEGER + 1)], lambda x: x <> '') END AS p FROM documents WHERE strpos(text, chr(10) || '## ') = 0)
SELECT doc_id, generate_subscripts(p, 1)::INTEGER - 1 AS ordinal, unnest(p) AS section FROM s""")
def heading_split(spark, sf_dir):
    """Sections of every text. The twin leaves out texts with headings, which the driver's tables don't have; those are tested against brute force."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.headed_sections(F.col("text"))).alias("ordinal", "section"))


#: Every third text gets headings at its lines.
LEVELLED = "CASE WHEN n_chars % 3 = 0 THEN replace(coalesce(text, ''), chr(10), concat(chr(10), '## ')) ELSE coalesce(text, '') END"
_CUT = "list_filter(list_transform(string_split(t, {0}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {0} || x END), lambda x: x <> '')"
_LEVELS = {1: ("chr(10) || '## '", "'## '"), 2: ("chr(10) || chr(10)", "chr(10)")}


@listing.add(f"""WITH d AS (SELECT doc_id, {LEVELLED} AS t FROM documents), g AS (SELECT *, unnest([0, 1, 2]) AS granularity FROM d),
p AS (SELECT doc_id, granularity, CASE WHEN granularity = 0 OR t = '' THEN [t] {" ".join(f"WHEN granularity = {k} AND contains(t, {x}) AND len({_CUT.format(x)}) > 1 THEN {_CUT.format(x)}" for k, v in _LEVELS.items() for x in v)}
  ELSE list_filter([substr(t, 1, greatest(length(t) // 2, 1)), substr(t, greatest(length(t) // 2, 1) + 1)], lambda x: x <> '') END AS p FROM g)
SELECT doc_id, granularity, generate_subscripts(p, 1)::INTEGER - 1 AS ordinal, sha256(unnest(p)) AS digest FROM p""")
def level_parts(spark, sf_dir):
    """Parts of every whole text at its three levels of detail; joined, they are the text again."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select("doc_id", F.expr(LEVELLED).alias("t"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("granularity"))
    return d.select("doc_id", "granularity", F.posexplode(text.level_parts(F.col("t"), F.col("granularity"))).alias("ordinal", "part")).select("doc_id", "granularity", "ordinal", F.sha2("part", 256).alias("digest"))


#: A key and a value as the text has them: its first word, and its first letters, which may run over a line.
HEADED = {"k": "CASE WHEN n_chars % 2 = 0 THEN lower(split_part(coalesce(text, ''), ' ', 1)) ELSE split_part(coalesce(text, ''), ' ', 1) END", "v": "substr(text, 1, 40)"}


@listing.add(f"""WITH d AS (SELECT doc_id, lang, source, text, {HEADED["k"]} AS k, {HEADED["v"]} AS v FROM documents), l AS (SELECT *, list_sort([{{'k': 'lang', 'v': lang}}, {{'k': 'source', 'v': source}}, {{'k': k, 'v': v}}]) AS h FROM d),
s AS (SELECT *, len(list_filter(h, lambda e: regexp_full_match(e.k, '[a-z][a-z0-9_.-]{{0,63}}') AND e.v IS NOT NULL AND NOT contains(e.v, chr(10)) AND NOT contains(e.v, chr(13)) AND NOT contains(e.v, chr(0)))) = 3 AS fits FROM l)
SELECT doc_id, CASE WHEN fits THEN 'valid' ELSE 'invalid' END AS state, CASE WHEN fits THEN sha256(array_to_string(list_transform(h, lambda e: e.k || ': ' || e.v), chr(10)) || chr(10) || chr(10) || coalesce(text, '')) END AS digest FROM s""")
def content_headers(spark, sf_dir):
    """Whole texts under headers whose keys are of the closed form and whose values stay on their line; others are refused."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"{x} AS {k}" for k, x in HEADED.items()])
    header = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.col("k"), F.col("v"))
    d = d.select("doc_id", text.header_valid(header).alias("fits"), text.content_full(header, F.coalesce("text", F.lit(""))).alias("content"))
    return d.select("doc_id", F.when(F.col("fits"), "valid").otherwise("invalid").alias("state"), F.when(F.col("fits"), F.sha2("content", 256)).alias("digest"))


@listing.add()
def sentence_split(spark, sf_dir):
    """Sentences of every text, in order; tested against Python's regex."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("ordinal", "sentence"))


SENTENCES = r"""lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS ordinal, unnest(string_split(text, chr(10))) AS line FROM documents),
spans AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM lines)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document as byte spans."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0).cast("long")))


@listing.add(f"""WITH {SENTENCES}, s AS (SELECT *, start_byte + strlen(line) AS end_byte, lag(start_byte + strlen(line)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before FROM spans)
SELECT s.doc_id, count(*) AS n, bool_and(CASE WHEN before IS NULL THEN start_byte = 0 ELSE start_byte = before + 1 END) AND max(end_byte) = max(strlen(text)) AS covered FROM s JOIN documents d ON s.doc_id = d.doc_id GROUP BY s.doc_id""")
def span_partition_check(spark, sf_dir):
    """Whether each text's line spans follow each other without gaps and reach its end."""
    s = spans(spark, sf_dir).withColumn("end_byte", F.col("start_byte") + F.octet_length("line"))
    s = s.withColumn("before", F.lag("end_byte").over(Window.partitionBy("doc_id").orderBy("ordinal")))
    good = F.when(F.col("before").isNull(), F.col("start_byte") == 0).otherwise(F.col("start_byte") == F.col("before") + 1)
    held = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("g"), F.max("end_byte").alias("e"))
    sizes = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.octet_length("text").alias("size"))
    return held.join(sizes, "doc_id").select("doc_id", "n", (F.col("g") & (F.col("e") == F.col("size"))).alias("covered"))


@listing.add("SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def ordinal_check(spark, sf_dir):
    """Whether the turns of each conversation count on from 0."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn")
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("n") == F.col("turn")).alias("contiguous"))


@listing.add(f"WITH {SENTENCES} SELECT doc_id, ordinal, line FROM spans")
def byte_slice(spark, sf_dir):
    """Every line, cut from the text by its byte span."""
    cut = spans(spark, sf_dir).select("doc_id", "ordinal", "start_byte", (F.col("start_byte") + F.octet_length("line")).alias("end_byte"))
    return cut.join(docs(spark, sf_dir), "doc_id").select("doc_id", "ordinal", text.byte_slice(F.col("text"), F.col("start_byte").cast("int"), F.col("end_byte").cast("int")).alias("line"))


BLOCKS = f"""{SENTENCES},
blocks AS (SELECT doc_id, 0 AS granularity, 0 AS block_id, text AS body FROM documents UNION ALL SELECT doc_id, 2, ordinal, line FROM lines WHERE trim(line) <> '')"""


def blocks(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """The root and the lines of every document as blocks, with the document's columns ``also``."""
    d = docs(spark, sf_dir, *also)
    root = d.select("doc_id", F.lit(0).alias("granularity"), F.lit(0).alias("block_id"), F.col("text").alias("body"), *also)
    lines = d.select("doc_id", *also, F.posexplode(F.split("text", "\n")).alias("block_id", "body")).where(F.trim("body") != "")
    return root.unionByName(lines.select("doc_id", F.lit(2).alias("granularity"), "block_id", "body", *also))


@listing.add(f"WITH {BLOCKS} SELECT doc_id, count(*) FILTER (WHERE granularity = 0) AS g0, count(*) FILTER (WHERE granularity = 2) AS g2, bool_or(granularity = 0) AS has_g0, string_agg(DISTINCT granularity::VARCHAR, ',' ORDER BY granularity::VARCHAR) AS layers FROM blocks GROUP BY doc_id")
def granularity_histogram(spark, sf_dir):
    """Blocks of each layer, per document."""
    g = F.col("granularity")
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.count_if(g == 0).alias("g0"), F.count_if(g == 2).alias("g2"), F.bool_or(g == 0).alias("has_g0"), F.array_join(F.array_sort(F.collect_set(g.cast("string"))), ",").alias("layers"))


@listing.add(f"""WITH {BLOCKS}, s AS (SELECT doc_id, granularity, block_id FROM blocks WHERE (doc_id + block_id) % 9 <> 0 UNION ALL SELECT doc_id, 1, 0 FROM documents WHERE doc_id % 50 = 0)
SELECT coalesce(b.doc_id, s.doc_id) AS doc_id, count(*) FILTER (WHERE s.doc_id IS NULL) AS missing, count(*) FILTER (WHERE b.doc_id IS NULL) AS extra
FROM blocks b FULL JOIN s ON b.doc_id = s.doc_id AND b.granularity = s.granularity AND b.block_id = s.block_id GROUP BY 1""")
def summary_alignment(spark, sf_dir):
    """Blocks without a summary and summaries without a block."""
    key = ["doc_id", "granularity", "block_id"]
    b = blocks(spark, sf_dir).select(*key)
    s = b.where("(doc_id + block_id) % 9 <> 0").unionByName(docs(spark, sf_dir).where("doc_id % 50 = 0").select("doc_id", F.lit(1).alias("granularity"), F.lit(0).alias("block_id")))
    both = b.withColumn("b", F.lit(1)).join(s.withColumn("s", F.lit(1)), key, "full_outer")
    return both.groupBy("doc_id").agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"))


@listing.add("SELECT doc_id, sha256('{\"text\":\"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '\"}') AS digest FROM documents")
def text_digest(spark, sf_dir):
    """Digests of texts as canonical JSON."""
    return docs(spark, sf_dir).select("doc_id", text.text_digest(F.col("text")).alias("digest"))


URLS = "SELECT page_id * 3 AS id, url FROM pages UNION ALL SELECT page_id * 3 + 1, 'HTTPS://user:pw@Host.Example.:443' || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/A?b#c' END FROM pages UNION ALL SELECT page_id * 3 + 2, 'not a url ' || page_id FROM pages"


@listing.add(rf"""WITH u AS ({URLS}), p AS (SELECT id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+?)\.?(:\d+)?(/[^?#]*)?(\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'r', 'q', 'f']) AS u FROM u)
SELECT id, sha256(CASE WHEN u.s = '' THEN url ELSE lower(u.s) || '://' || lower(u.h) || CASE WHEN (lower(u.s) = 'https' AND u.p = ':443') OR (lower(u.s) = 'http' AND u.p = ':80') THEN '' ELSE coalesce(u.p, '') END
  || CASE WHEN coalesce(u.r, '') = '' THEN '/' ELSE u.r END || CASE WHEN coalesce(u.q, '') = '?' THEN '' ELSE coalesce(u.q, '') END END) AS identity FROM p""")
def url_identity(spark, sf_dir):
    """Digests of normalised URLs: those of all pages, odd spellings, and what isn't a URL."""
    p = pages(spark, sf_dir, "url")
    i, odd = F.col("page_id") * 3, F.concat(F.lit("HTTPS://user:pw@Host.Example.:443"), F.when(F.col("page_id") % 2 == 0, "").otherwise("/A?b#c"))
    every = p.select(i.alias("id"), "url").unionByName(p.select((i + 1).alias("id"), odd.alias("url"))).unionByName(p.select((i + 2).alias("id"), F.concat(F.lit("not a url "), F.col("page_id").cast("string")).alias("url")))
    return every.select("id", arrow.url_identity("url").alias("identity"))


#: Contents by doc_id: their bytes in hex, before the text's own, and their type.
SNIFFED = (("255044462D312E34", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FFE0", "image/jpeg"), ("474946383961", "image/gif"), ("524946460000000057454250", "image/webp"), ("FFFE", "application/octet-stream"), ("EFBBBF", "text/plain"), ("3C70203E", "text/html"), ("", "text/plain"))
KIND = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(SNIFFED)) + " WHEN 9 THEN 'application/json' ELSE 'text/plain' END"
DECLARED = "CASE WHEN doc_id % 4 = 0 THEN 'application/pdf' WHEN doc_id % 4 = 1 THEN 'text/plain' ELSE NULL END"


@listing.add(f"""SELECT doc_id, declared, detected, coalesce(NOT ((regexp_matches(coalesce(declared, ''), '^(application/pdf|image/)') OR regexp_matches(detected, '^(application/pdf|image/)')) AND declared IS DISTINCT FROM detected), false) AS verified
FROM (SELECT doc_id, {DECLARED} AS declared, {KIND} AS detected FROM documents)""")
def representation_sniff(spark, sf_dir):
    """Types of contents of every kind, against what is declared of them."""
    i, body = F.col("doc_id") % 11, F.encode(F.regexp_replace("text", r"[<{\[]", ""), "UTF-8")
    content = body
    for k, (head, _) in enumerate(SNIFFED):
        content = F.when(i == k, F.concat(F.unhex(F.lit(head)), body)).otherwise(content)
    content = F.when(i == 9, F.encode(F.to_json(F.struct("text")), "UTF-8")).when(i == 10, F.encode(F.concat(F.lit('{"a": '), F.regexp_replace("text", r"[<{\[}]", "")), "UTF-8")).otherwise(content)
    d = docs(spark, sf_dir).withColumn("declared", F.expr(DECLARED)).withColumn("detected", text.media_type(content))
    return d.select("doc_id", "declared", "detected", text.media_verified(F.col("declared"), F.col("detected")).alias("verified"))


def pages(spark: SparkSession, sf_dir: str, column: str = "html") -> DataFrame:
    workers_import(spark)
    return table(spark, sf_dir, "pages", "page_id", column)


@listing.add()
def html_text(spark, sf_dir):
    """Readable text of every page."""
    c = pages(spark, sf_dir).withColumn("c", arrow.html_text("html"))
    return c.select("page_id", "c.text", F.to_json("c.removed").alias("removed"))


@listing.add()
def html_sanitise(spark, sf_dir):
    """Safe markup of every page."""
    c = pages(spark, sf_dir).withColumn("c", arrow.html_sanitised("html"))
    return c.select("page_id", F.col("c.text").alias("html"), F.to_json("c.removed").alias("removed"), F.to_json("c.bare").alias("bare"))


@listing.add()
def web_clean(spark, sf_dir):
    """Pages sanitised and read, with those left empty marked."""
    c = pages(spark, sf_dir).withColumn("c", arrow.web_clean("html"))
    return c.select("page_id", "c.text", F.col("c.text").isNull().alias("quarantined"))


@listing.add("SELECT doc_id, nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS canonical FROM documents")
def nfc_text(spark, sf_dir):
    """Canonical text of every document."""
    return docs(spark, sf_dir).select("doc_id", arrow.canonical_text("text").alias("canonical"))


@listing.add(r"""SELECT doc_id, nfc_normalize(replace(replace(CASE WHEN doc_id % 2 = 1 THEN 'first' || chr(10) ELSE '' END || text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text, (1 + doc_id % 3)::INTEGER AS pages FROM documents WHERE text <> ''""")
def pdf_text(spark, sf_dir):
    """Text layers and page counts of PDFs made of every document, some as single strings, some as arrays; empty ones have no layer."""
    body = F.regexp_replace("text", r"([()\\])", r"\\$1")
    shown = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("("), body, F.lit(") Tj"))).otherwise(F.concat(F.lit("[("), F.replace(body, F.lit("]"), F.lit("\\135")), F.lit(")] TJ (first) '")))
    made = docs(spark, sf_dir).select("doc_id", F.encode(F.concat(F.lit("%PDF-1.4\n"), F.repeat(F.lit("<< /Type /Page >>\n"), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("<< /Type /Pages >> BT "), shown, F.lit(" ET")), "UTF-8").alias("raw"))
    return made.select("doc_id", arrow.pdf_text("raw").alias("text"), arrow.pdf_page_count("raw").alias("pages")).where("text is not null and text <> 'first'")


@listing.add(f"WITH {SENTENCES}, k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal)::INTEGER - 1 AS ordinal FROM lines WHERE line <> '') SELECT doc_id, count(*) AS n, sum(strlen(line))::BIGINT AS bytes FROM k GROUP BY doc_id")
def anchor_adopt(spark, sf_dir):
    """Lines found again in their texts as byte spans, counted and summed per document."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    found = docs(spark, sf_dir).select("doc_id", F.explode(arrow.anchors(F.col("text"), lines)).alias("a"))
    return found.where("a.start is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a.end") - F.col("a.start")).alias("bytes"))


@listing.add("SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS digest FROM events")
def canonical_json(spark, sf_dir):
    """Digests of canonical JSON."""
    workers_import(spark)
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", arrow.stable_digest(F.col("props")).alias("digest"))


@listing.add()
def embed_batches(spark, sf_dir):
    """Batches of conversation turns under a budget of 16,000 letters; a sequential sum, so no SQL twin."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("chars", F.length("text"))
    return ledger.budget_batches(c, "conv_id", "turn", "chars", 16_000)


def envelopes(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    """Documents as provider envelopes: of none, one or two records."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    i = F.concat(F.lit(" K"), F.col("doc_id").cast("string"))
    n, mod = F.col("doc_id"), lambda k: F.col("doc_id") % k
    if provider == "tax":
        one = F.struct(i.alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("label"), F.lit("发布").alias("pubName"), F.when(mod(5) == 0, "全文失效").when(mod(5) < 4, "全文有效").alias("xxgk_aging"))
        list_ = F.to_json(F.struct(F.struct(F.array(one, one.withField("id", F.concat(i, F.lit("b")))).alias("searchTotal")).alias("searchResultAll")))
        body = F.when(mod(7) == 0, F.lit('{"searchResultAll":{}}')).when(mod(7) == 1, list_).otherwise(F.to_json(F.struct(F.struct(one.alias("searchTotal")).alias("searchResultAll"))))
    elif provider == "agency":
        one = F.struct(n.alias("id"), F.col("source").alias("headline"), F.col("text").alias("description"), F.when(mod(3) == 0, "live").otherwise("sold").alias("status"), F.col("lang").alias("saleMode"), F.when(mod(2) == 0, 3.0).alias("bedrooms"), F.when(mod(2) == 0, F.array(F.lit("house"))).alias("propertyTypes"))
        body = F.to_json(F.array(one))
    else:
        one = F.struct(i.alias("listingId"), F.col("source").alias("title"), F.col("text").alias("description"), F.struct(F.when(mod(4) == 0, "Sold").alias("type")).alias("status"), F.lit("house").alias("propertyType"), F.when(mod(9) == 0, "withdrawn").otherwise("buy").alias("channel"))
        body = F.to_json(F.struct(F.array(F.struct(F.array(one).alias("results"))).alias("tieredResults")))
    return d.select(F.col("doc_id").alias("envelope_id"), body.alias("payload"))


Q = "CASE WHEN {0} IS NULL THEN 'null' ELSE to_json({0})::VARCHAR END"
TRIMMED = r"nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')"
#: Per provider: the canonical JSON of its content and of its metadata, in SQL.
FACTS = {
    "tax": (f"'{{\"description\":' || {Q.format(TRIMMED)} || ',\"publish_date\":null,\"publisher\":\"发布\",\"title\":' || {Q.format('source')} || '}}'", "'{\"effective_description\":null,\"effective_status\":' || CASE WHEN doc_id % 5 = 0 THEN '\"全文失效\"' WHEN doc_id % 5 < 4 THEN '\"全文有效\"' ELSE 'null' END || '}'"),
    "agency": (f"'{{\"description\":' || {Q.format('text')} || ',\"features\":\"' || CASE WHEN doc_id % 2 = 0 THEN '3.0' ELSE '' END || '\",\"headline\":' || {Q.format('source')} || '}}'", f"'{{\"price\":null,\"sale_mode\":' || {Q.format('lang')} || ',\"status\":\"' || CASE WHEN doc_id % 3 = 0 THEN 'live' ELSE 'sold' END || '\"}}'"),
    "listing": (f"'{{\"description\":' || {Q.format('text')} || ',\"title\":' || {Q.format('source')} || '}}'", "'{\"price\":null,\"status\":null}'"),
}
#: Per provider: rows of the envelopes, key, whether active, facets and tags, in SQL.
MEMBERS = {
    "tax": ("(SELECT *, 0 AS ordinal FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT *, 1 FROM documents WHERE doc_id % 7 = 1)", "'k' || doc_id || CASE WHEN ordinal = 1 THEN 'b' ELSE '' END", "doc_id % 5 BETWEEN 1 AND 3",
        "'realm=tax_china;type=' || lang || ';channel=unknown;source_name=chinatax.gov.cn'", "'发布单位: 发布' || CASE WHEN doc_id % 5 = 0 THEN '|文件时效: 全文失效' WHEN doc_id % 5 < 4 THEN '|文件时效: 全文有效' ELSE '' END"),
    "agency": ("(SELECT *, 0 AS ordinal FROM documents)", "doc_id::VARCHAR", "true",
        "'realm=realestate_on_market;type=' || lang || ';channel=' || CASE WHEN doc_id % 2 = 0 THEN 'house' ELSE 'Unknown' END || ';source_name=Domain Generic Agency (0)'", "CASE WHEN doc_id % 2 = 0 THEN '3.0 bedrooms|house' ELSE '' END"),
    "listing": ("(SELECT *, 0 AS ordinal FROM documents)", "'k' || doc_id", "doc_id % 4 <> 0 AND doc_id % 9 <> 0", "'realm=realestate;type=listing;channel=' || CASE WHEN doc_id % 9 = 0 THEN 'withdrawn' ELSE 'buy' END || ';source_name=Unknown Agency'", "'Property Type: house'"),
}


def _provider(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = providers.mapped(providers.members(envelopes(spark, sf_dir, name), name), name)
        return flat.select("envelope_id", "ordinal", "key", "title", "is_active", "facets", F.array_join("tags", "|").alias("tags"), F.sha2("clean_text", 256).alias("clean_digest"), "content_digest", "meta_digest", F.array_join(F.transform("semantic_tuples", lambda t: F.concat(t["name"], F.lit("="), t["value"])), ";").alias("tuples"))

    run.__doc__ = f"Members of {name} envelopes."
    return run


for _name, (_rows, _key, _active, _facets, _tags) in MEMBERS.items():
    _body = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    listing.add(f"SELECT doc_id AS envelope_id, ordinal, {_key} AS key, source AS title, {_active} AS is_active, {_facets} AS facets, {_tags} AS tags, sha256(CASE WHEN {_body} <> '' THEN source || chr(10) || chr(10) || {_body} ELSE source END) AS clean_digest, sha256({FACTS[_name][0]}) AS content_digest, sha256({FACTS[_name][1]}) AS meta_digest, {_facets} || ';title=' || source || ';tags=' || {_tags} AS tuples FROM {_rows}", f"provider_map_{_name}")(_provider(_name))


@listing.add("SELECT doc_id AS envelope_id, 'k' || doc_id % 10 AS key, count(*) AS n FROM (SELECT doc_id % 50 AS doc_id, doc_id % 4 AS k FROM documents) GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    """Keys that stand more than once in an envelope."""
    d = table(spark, sf_dir, "documents", "doc_id").select((F.col("doc_id") % 50).alias("envelope_id"))
    return providers.repeated_keys(d.withColumn("key", F.concat(F.lit("k"), F.col("envelope_id") % 10)))


ENVELOPED = {"envelope_id": "CASE WHEN l_linenumber <= 2 THEN -1 ELSE l_suppkey * 10 + l_linenumber END", "key": "CASE WHEN l_quantity = 50 THEN NULL WHEN l_tax > 0.04 THEN concat(' K', l_partkey) ELSE concat('k', l_partkey) END"}


@listing.add(f"""WITH e AS (SELECT {", ".join(f"{v} AS {k}" for k, v in ENVELOPED.items())} FROM lineitem)
SELECT envelope_id, count(*) AS n, CASE WHEN count(*) > 10000 THEN 'too_many' WHEN count(key) < count(*) THEN 'invalid_record' WHEN count(DISTINCT lower(trim(key))) < count(*) THEN 'repeated' ELSE 'ok' END AS state FROM e GROUP BY envelope_id""")
def envelope_states(spark, sf_dir):
    """Envelopes that may be taken in: not too many records, all with keys, no key twice."""
    e = table(spark, sf_dir, "lineitem", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_partkey")
    return providers.envelope_states(e.selectExpr(*[f"{v} AS {k}" for k, v in ENVELOPED.items()]))


#: Replies written around turns: fenced, within prose, twice, cut short, or prose alone, as the text's digest has it.
REPLY = """CASE substr(h, 1, 1) WHEN '0' THEN concat('```json', chr(10), o, chr(10), '```') WHEN '1' THEN concat('```', chr(10), o, '```', chr(10)) WHEN '2' THEN concat('Here it is: ', o, ' as asked') WHEN '3' THEN concat(o, ' ', o) WHEN '4' THEN substr(o, 1, length(o) - 2)
  WHEN '5' THEN text WHEN '6' THEN '' WHEN '7' THEN concat('"', text, '"') ELSE concat('  ', o, chr(10)) END"""
OBJECT = "concat('{\"turn\":', turn, ', \"text\" : ', q, ',\"role\": \"', role, '\"}')"


@listing.add(f"""WITH r AS (SELECT *, {REPLY} AS reply FROM (SELECT *, {OBJECT} AS o FROM (SELECT conv_id, turn, role, text, sha256(text) AS h, to_json(text)::VARCHAR AS q FROM conversations))),
b AS (SELECT conv_id, turn, substr(reply, strpos(reply, '{{'), length(reply) - strpos(reverse(reply), '}}') - strpos(reply, '{{') + 2) AS body, contains(reply, '{{') AND contains(reply, '}}') AS found FROM r),
v AS (SELECT *, CASE WHEN found AND json_valid(body) THEN body END::JSON AS j FROM b)
SELECT conv_id, turn, CASE WHEN j IS NOT NULL THEN '{{"role": ' || to_json(json_extract_string(j, '$.role')) || ', "text": ' || to_json(json_extract_string(j, '$.text')) || ', "turn": ' || json_extract_string(j, '$.turn') || '}}' END AS object FROM v""")
def fenced_json(spark, sf_dir):
    """The one JSON object of replies with and without code fences and prose; two objects or half of one are none."""
    workers_import(spark)
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("h", F.sha2("text", 256)).withColumn("q", text.json_text(F.col("text")))
    return c.withColumn("o", F.expr(OBJECT)).select("conv_id", "turn", arrow.fenced_json(F.expr(REPLY)).alias("object"))


DECODED = """CASE media WHEN 'application/json' THEN '{"a":' || doc_id || ',"b":"x"}' WHEN 'image/png' THEN '' WHEN 'application/zip' THEN NULL ELSE nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END"""
MEDIA = "CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/json' WHEN 3 THEN 'image/png' ELSE 'application/zip' END"


@listing.add(f"SELECT doc_id, media, {DECODED} AS decoded, CASE WHEN media = 'application/zip' THEN 'unsupported' ELSE 'decoded' END AS state FROM (SELECT *, {MEDIA} AS media FROM documents)")
def decode_dispatch(spark, sf_dir):
    """Representations decoded by their media type."""
    raw = F.when(F.col("media") == "application/json", F.concat(F.lit('{"b": "x", "a": '), F.col("doc_id"), F.lit("}"))).otherwise(F.col("text"))
    d = docs(spark, sf_dir).withColumn("media", F.expr(MEDIA)).withColumn("raw", F.encode(raw, "UTF-8"))
    return dispatch.decoded(d).select("doc_id", "media", "decoded", "state")


CAPABILITY = "CASE doc_id % 7 WHEN 0 THEN 'clean.map.registered_api' WHEN 1 THEN 'clean.extract.pdf_text' WHEN 2 THEN 'clean.ocr.local' WHEN 3 THEN 'clean.extract.web' WHEN 4 THEN 'clean.deterministic' WHEN 5 THEN 'clean.extract.pdf_llm' ELSE 'clean.other' END"
CLEAN_MEDIA = "CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' ELSE 'image/png' END"


@listing.add(f"""SELECT doc_id, CASE WHEN capability = 'clean.other' THEN 'unsupported' WHEN capability = 'clean.map.registered_api' THEN 'api' WHEN capability IN ('clean.extract.pdf_text', 'clean.extract.pdf_llm') OR media = 'application/pdf' THEN 'pdf'
  WHEN capability = 'clean.ocr.local' OR media = 'image/png' THEN 'doc' WHEN capability = 'clean.extract.web' OR source_kind = 'http_resource' THEN 'web' ELSE 'doc' END AS channel FROM (SELECT doc_id, {CAPABILITY} AS capability, {CLEAN_MEDIA} AS media, CASE WHEN doc_id % 2 = 0 THEN 'http_resource' ELSE 'inline' END AS source_kind FROM documents)""")
def clean_dispatch(spark, sf_dir):
    """The channel that cleans each representation: PDF and image win over how it was fetched."""
    d = table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.expr(CAPABILITY).alias("capability"), F.expr(CLEAN_MEDIA).alias("media"), F.when(F.col("doc_id") % 2 == 0, "http_resource").otherwise("inline").alias("source_kind"))
    return d.select("doc_id", dispatch.clean_channel(F.col("capability"), F.col("media"), F.col("source_kind")).alias("channel"))


@listing.add()
def document_clean(spark, sf_dir):
    """Pages and texts cleaned deterministically by media type; tested against fixed cases."""
    texts = docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", F.when(F.col("doc_id") % 9 == 0, "image/png").otherwise("text/plain").alias("media"))
    html = pages(spark, sf_dir).select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"), F.lit("text/html").alias("media"))
    return dispatch.cleaned(texts.unionByName(html)).select("id", "clean", "state")
