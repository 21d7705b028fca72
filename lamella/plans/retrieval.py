"""Queries of vectors, the serving fence and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import vector
from lamella.operators import fence as fences
from lamella.operators import retrieve
from lamella.operators.search import search
from lamella.plans.base import Listing
from lamella.sources import ledgers
from lamella.sources.shared import settled
from lamella.sources.tables import table

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql

BUCKETS = r"""
tokens AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS token FROM documents),
weights AS (
  SELECT doc_id, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 64)::INTEGER AS bucket, 1.0::DOUBLE AS w FROM tokens
  UNION ALL SELECT doc_id, (('0x' || substr(sha256(token), 9, 8))::BIGINT % 64)::INTEGER, -0.25::DOUBLE FROM tokens
),
buckets AS (SELECT doc_id, bucket, sum(w) AS weight FROM weights GROUP BY doc_id, bucket)
"""
EMBEDDED = BUCKETS + """,
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM buckets GROUP BY doc_id),
grid AS (SELECT doc_id, i FROM (SELECT DISTINCT doc_id FROM documents), range(64) t(i)),
embedded AS (
  SELECT g.doc_id, list(CASE WHEN norm > 0 THEN coalesce(weight, 0) / norm WHEN i = 0 THEN 1.0 ELSE 0.0 END ORDER BY i) AS v
  FROM grid g LEFT JOIN buckets b ON g.doc_id = b.doc_id AND i = bucket LEFT JOIN norms n ON g.doc_id = n.doc_id GROUP BY g.doc_id
)
"""
MODEL = ("model", "model_key", "model_version", "adapter", "dimension")
SAME = " AND ".join(f"c.{c} = f.{c}" for c in ("team", "item", "revision", "namespace", "artifact", "artifact_type", *MODEL, "generation"))
FENCE = ledgers.CTE + """,
fence AS (
  SELECT r.vec_id, r.team, r.item, r.namespace, r.generation, r.unit, r.granularity, r.channel, s.source_kind, n.metric, f.proof, g.handle
  FROM records r JOIN namespaces n ON r.namespace = n.namespace JOIN pointers p ON r.team = p.team AND r.item = p.item AND r.namespace = p.namespace
  JOIN proofs f ON f.proof = p.last_proof JOIN items i ON r.team = i.team AND r.item = i.item
  LEFT JOIN sources s ON i.team = s.team AND i.source = s.source JOIN generations g ON r.team = g.team AND r.artifact = g.artifact
  WHERE {conditions}
)
"""
CONDITIONS = {
    "record_deleted": "r.deleted_at IS NULL", "record_state": "r.state = 'indexed'", "namespace_status": "n.status = 'active'", "namespace_deleted": "n.ns_deleted_at IS NULL",
    **{f"namespace_{c}": f"r.{c} = n.ns_{c}" for c in MODEL},
    "pointer_state": "p.pointer_state = 'active'", "pointer_generation": "p.active_generation = r.generation", "pointer_artifact": "p.artifact = r.artifact", "pointer_proof": "p.last_proof IS NOT NULL",
    "proof_type": "f.proof_type = 'publication'", "proof_version": "f.proof_version = 'v1'",
    **{f"proof_{c}": f"f.{c} = r.{c}" for c in ("team", "item", "revision", "namespace", "artifact", "artifact_type", "model_key", "adapter", "dimension", "generation", "model_version")},
    "expected_count": "f.expected_count = f.actual_count", "matched_count": "f.actual_count = f.matched_count",
    "complete_set": f"f.actual_count = (SELECT count(*) FROM records c WHERE {SAME} AND c.deleted_at IS NULL AND c.state = 'indexed')",
    "generation_type": "g.artifact_type = r.artifact_type", "generation_validation": "g.validation = 'full_valid'",
    "item_lifecycle": "i.lifecycle = 'active'", "item_deleted": "i.item_deleted_at IS NULL", "item_serving": "i.serving_revision IS NOT NULL", "item_revision": "i.serving_revision = r.revision",
}
#: A proof of other coordinates also has another complete set, so both guard; the variants without one leave out the other too.
BOTH = {f"proof_{c}" for c in ("team", "item", "revision", "namespace", "artifact", "artifact_type", "model_key", "model_version", "adapter", "dimension", "generation")}


def without(name: str) -> tuple[str, ...]:
    return (name, "complete_set") if name in BOTH else ("item_serving", "item_revision") if name == "item_serving" else (name,)


FENCE_ALL = FENCE.format(conditions=" AND ".join(CONDITIONS.values()))
SHOWN = ("vec_id", "team", "item", "namespace", "generation", "unit", "granularity", "channel", "source_kind", "metric", "proof", "handle")
DOT = "list_dot_product(q.v, r.v)"
SCORE = {
    "cosine": f"CASE WHEN list_dot_product(q.v, q.v) > 0 AND list_dot_product(r.v, r.v) > 0 THEN {DOT} / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v))) ELSE 0 END",
    "l2": "1 / (1 + list_distance(q.v, r.v))",
    "inner_product": DOT,
}


def built_fence(spark: SparkSession, sf_dir: str, skip: tuple[str, ...] = ()) -> DataFrame:
    own = (ledgers.records(spark, sf_dir), ledgers.namespaces(spark), ledgers.pointers(spark, sf_dir), ledgers.proofs(spark, sf_dir), ledgers.items(spark, sf_dir), ledgers.sources(spark), ledgers.generations(spark, sf_dir))
    return fences.serving_fence(*own, skip=skip)


@listing.add(f"WITH {BUCKETS} SELECT doc_id, bucket, round(weight, 6) AS weight FROM buckets")
def hash_embedding(spark, sf_dir):
    """Signed bucket sums of every document's tokens."""
    return vector.hash_buckets(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@listing.add("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM embeddings")
def vector_validity(spark, sf_dir):
    """Whether each stored vector has the dimension and finite components."""
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", vector.valid(F.col("embedding"), 64).alias("valid"))


def _topk_sql(metric: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, round({SCORE[metric]}, 6) AS score FROM e q, e r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE score >= 0)
SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 20"""


def _topk(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("namespace", F.lit(0).cast("long"))
        asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "namespace", F.col("embedding").alias("query_embedding"))
        return search(asked, e, spark.createDataFrame([(0, metric)], "namespace long, metric string"))

    run.__doc__ = f"The 20 best vectors by {metric} for every vector whose id is a multiple of 50."
    return run


for _name, _metric in (("cosine_topk", "cosine"), ("l2_topk", "l2"), ("ip_topk", "inner_product")):
    listing.add(_topk_sql(_metric), _name)(_topk(_metric))


@listing.add(r"""
WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'))) AS token FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'))) AS token FROM benchmark WHERE item_id % 50 = 0),
nd AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
met AS (SELECT item_id, doc_id, count(*) AS n FROM d JOIN b USING (token) GROUP BY item_id, doc_id),
scored AS (SELECT item_id, doc_id, round(met.n / sqrt(nd.n::DOUBLE * nb.n), 6) AS score FROM met JOIN nd USING (doc_id) JOIN nb USING (item_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 20""")
def token_similarity(spark, sf_dir):
    """The 20 documents whose token sets overlap most with each asked benchmark item (ids divisible by 50).

    An inverted join on the queries' tokens with counts summed before ranking; documents without a common token never meet a query.
    """
    sets = lambda df, key: df.select(key, F.explode(F.array_distinct(vector.tokens(F.col("text")))).alias("token"))
    asked = sets(table(spark, sf_dir, "benchmark", "item_id", "text").where("item_id % 50 = 0"), "item_id")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_distinct(vector.tokens(F.col("text"))).alias("t"))
    nb = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("nb"))
    met = docs.select("doc_id", F.size("t").alias("nd"), F.explode("t").alias("token")).join(asked, "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("nd").alias("nd"))
    scored = met.join(nb, "item_id").select("item_id", F.col("doc_id").alias("vec_id"), F.round(F.col("n") / F.sqrt(F.col("nd").cast("double") * F.col("nb")), 6).alias("score"))
    return retrieve.top_k(scored, 20, None, by="item_id").withColumnRenamed("vec_id", "doc_id")


@listing.add(f"WITH {FENCE_ALL} SELECT {', '.join(SHOWN)} FROM fence")
def serving_fence(spark, sf_dir):
    """Vector records that every condition lets through."""
    return built_fence(spark, sf_dir).select(*SHOWN)


def _tampered(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return built_fence(spark, sf_dir, without(name)).select(*SHOWN)

    run.__doc__ = f"The fence without its {name} condition."
    return run


for _name in CONDITIONS:
    listing.add(f"WITH {FENCE.format(conditions=' AND '.join(v for k, v in CONDITIONS.items() if k not in without(_name)))} SELECT {', '.join(SHOWN)} FROM fence", f"fence_tamper_{_name}")(_tampered(_name))


@listing.add(f"WITH {FENCE_ALL} SELECT {', '.join(SHOWN)} FROM fence WHERE source_kind IN ('web', 'api') AND channel = 'summary'")
def fence_filtered(spark, sf_dir):
    """The fence under closed filters: two source kinds and one channel."""
    return fences.filtered(built_fence(spark, sf_dir), source_kind=["web", "api"], channel="summary", item=None).select(*SHOWN)


@listing.add(f"WITH {FENCE_ALL} SELECT {', '.join(SHOWN)} FROM fence WHERE team = 1")
def fence_of_team(spark, sf_dir):
    """One team's fence, which fails rather than cut beyond its scan limit."""
    own = (ledgers.records(spark, sf_dir), ledgers.namespaces(spark), ledgers.pointers(spark, sf_dir), ledgers.proofs(spark, sf_dir), ledgers.items(spark, sf_dir), ledgers.sources(spark), ledgers.generations(spark, sf_dir))
    return fences.within(10_000_000, fences.serving_fence(*own, team=1).select(*SHOWN))


@listing.add(f"""WITH {ledgers.CTE}
SELECT r.vec_id, r.item, r.namespace, r.generation FROM records r JOIN namespaces n ON r.namespace = n.namespace AND n.status = 'active'
JOIN pointers p ON r.item = p.item AND r.namespace = p.namespace AND r.generation = p.active_generation AND p.pointer_state = 'active'
WHERE r.state = 'indexed' AND r.deleted_at IS NULL AND EXISTS (SELECT 1 FROM proofs f WHERE r.item = f.item AND r.namespace = f.namespace AND r.generation = f.generation)""")
def active_vectors(spark, sf_dir):
    """The weaker view of active vectors."""
    out = fences.active_vectors(ledgers.records(spark, sf_dir), ledgers.namespaces(spark), ledgers.pointers(spark, sf_dir), ledgers.proofs(spark, sf_dir))
    return out.select("vec_id", "item", "namespace", "generation")


CANDIDATES = """candidates AS (
  SELECT vec_id, item, CASE WHEN vec_id % 5 = 0 THEN revision + 1 ELSE revision END AS revision FROM records
  UNION ALL SELECT vec_id, item, revision FROM records WHERE vec_id % 7 = 0
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledgers.records(spark, sf_dir)
    first = r.select("vec_id", "item", F.when(F.col("vec_id") % 5 == 0, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))
    return first.unionByName(r.where("vec_id % 7 = 0").select("vec_id", "item", "revision"))


ELIGIBLE = """SELECT DISTINCT c.vec_id, c.item, c.revision FROM candidates c JOIN records r ON c.vec_id = r.vec_id AND c.item = r.item AND c.revision = r.revision
JOIN items i ON r.team = i.team AND r.item = i.item AND r.revision = i.serving_revision WHERE i.lifecycle = 'active' AND i.item_deleted_at IS NULL"""


@listing.add(f"WITH {ledgers.CTE}, {CANDIDATES} {ELIGIBLE}")
def fallback_eligible(spark, sf_dir):
    """Candidate triples that their items alone confirm."""
    return fences.fallback_eligible(candidates(spark, sf_dir), ledgers.records(spark, sf_dir), ledgers.items(spark, sf_dir))


@listing.add(f"WITH {ledgers.CTE}, {CANDIDATES} {ELIGIBLE} AND r.state = 'indexed' AND r.deleted_at IS NULL")
def eligible_candidates(spark, sf_dir):
    """Candidate triples that an indexed record and an active item confirm."""
    return fences.eligible(candidates(spark, sf_dir), ledgers.records(spark, sf_dir), ledgers.items(spark, sf_dir))


@listing.add(f"WITH {ledgers.CTE}, {CANDIDATES} SELECT vec_id, min(item) AS item, min(revision) AS revision FROM candidates GROUP BY vec_id HAVING count(DISTINCT (item, revision)) = 1")
def conflicting_candidates(spark, sf_dir):
    """Candidates left after ids at two coordinates are dropped."""
    return fences.unconflicted(candidates(spark, sf_dir))


@listing.add(f"WITH {FENCE_ALL} SELECT DISTINCT vec_id, item, namespace, generation FROM records SEMI JOIN fence USING (vec_id, item, namespace, generation)")
def fence_revalidate(spark, sf_dir):
    """Records that a fresh fence holds at exactly their coordinates."""
    mine = ledgers.records(spark, sf_dir).select("vec_id", "item", "namespace", "generation")
    return fences.revalidated(mine, built_fence(spark, sf_dir))


@listing.add(f"WITH {FENCE_ALL} SELECT vec_id, item, channel, round(1.0 / (1 + vec_id % 10), 6) AS score FROM fence WHERE vec_id % 3 <> 0")
def delegated_scores(spark, sf_dir):
    """Hits by the scores of another scorer, which leaves some ids out."""
    given = ledgers.records(spark, sf_dir).select("vec_id").where("vec_id % 3 <> 0").withColumn("score", F.round(1.0 / (1 + F.col("vec_id") % 10), 6))
    return retrieve.delegated(built_fence(spark, sf_dir), given).select("vec_id", "item", "channel", "score")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is a multiple of 50, as a query with its hash embedding."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("doc_id % 50 = 0")
    embedded = vector.hash_embedding(docs, "doc_id", "text").withColumnRenamed("embedding", "query_embedding")
    return docs.join(embedded, "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"), F.expr("doc_id div 50 % 3").alias("namespace"), "query_embedding")


def found(spark: SparkSession, sf_dir: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, fence, hits): queries and the narrow fence are settled once, since each is read several times; vectors are joined to what the fence holds."""
    asks, fence = settled(asked(spark, sf_dir), "asked"), settled(built_fence(spark, sf_dir), "fence")
    held = settled(ledgers.vectors(spark, sf_dir, fence.select("vec_id", "namespace")), "vectors")
    return asks, fence, search(asks, held, ledgers.namespaces(spark), retrieve.RECALL_K, threshold).join(fence, "vec_id")


def recalled(spark: SparkSession, sf_dir: str, threshold: float = 0.0) -> DataFrame:
    return found(spark, sf_dir, threshold)[2]


ASKED = EMBEDDED + f""",
{FENCE_ALL},
asked AS (SELECT d.doc_id AS query_id, d.text AS query_text, d.doc_id // 50 % 3 AS namespace, e.v FROM documents d JOIN embedded e USING (doc_id) WHERE d.doc_id % 50 = 0),
vectors AS (SELECT f.*, e.embedding::DOUBLE[] AS v FROM fence f JOIN embeddings e ON e.vec_id = f.vec_id % (SELECT count(*) FROM embeddings)),
scored AS (
  SELECT query_id, r.* EXCLUDE (v), round(CASE metric WHEN 'cosine' THEN {SCORE["cosine"]} WHEN 'l2' THEN {SCORE["l2"]} ELSE {SCORE["inner_product"]} END, 6) AS score
  FROM asked q JOIN vectors r USING (namespace)
),
recalled AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored WHERE score >= 0) WHERE rank <= {retrieve.RECALL_K}
),
originals AS (SELECT item, generation, unit, min(vec_id) AS original_vec FROM records WHERE channel = 'original' AND state = 'indexed' GROUP BY ALL),
traced AS (
  SELECT r.*, CASE WHEN channel = 'original' THEN 'not_needed' WHEN u.original IS NOT NULL THEN 'resolved' WHEN original_vec IS NOT NULL THEN 'degraded' ELSE 'failed' END AS trace,
    coalesce(u.original, CASE WHEN channel = 'summary' THEN u.summary END) AS text
  FROM recalled r LEFT JOIN units u USING (item, generation, unit) LEFT JOIN originals o USING (item, generation, unit)
),
kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item, generation, unit ORDER BY score DESC, trace = 'resolved' DESC, vec_id) AS _n FROM traced) WHERE _n = 1
),
placed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS position FROM kept) WHERE position <= {retrieve.RETURN_K}
),
roots AS (SELECT item, generation, arg_min(coalesce(original, summary), unit) AS body FROM units WHERE granularity = 0 GROUP BY item, generation),
firsts AS (
  SELECT p.*, body, min(CASE WHEN granularity <> 0 AND body IS NOT NULL THEN position END) OVER (PARTITION BY query_id, item, generation) AS f
  FROM placed p LEFT JOIN roots USING (item, generation)
),
inflated0 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY f NULLS LAST) AS nth FROM firsts),
inflated1 AS (
  SELECT *, CASE WHEN granularity = 0 THEN 'skipped' WHEN body IS NULL THEN 'missing' WHEN nth > {retrieve.ROOTS} THEN 'skipped'
    WHEN length(body) > {retrieve.ROOT_CHARS} THEN 'truncated' ELSE 'attached' END AS inflation FROM inflated0
),
inflated AS (SELECT * EXCLUDE (body), CASE WHEN inflation IN ('attached', 'truncated') THEN substr(body, 1, {retrieve.ROOT_CHARS}) END AS root_text FROM inflated1),
usable AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM inflated WHERE text IS NOT NULL) WHERE n <= {retrieve.PACK_HITS}
),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, item, generation, granularity = 0 OR root_text IS NOT NULL ORDER BY position) AS o FROM usable),
segments AS (
  SELECT query_id, n, 0 AS part, text AS body FROM once UNION ALL SELECT query_id, n, 1, root_text FROM once WHERE o = 1 AND root_text IS NOT NULL
),
budget AS (
  SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY query_id ORDER BY n, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM segments
),
clipped AS (SELECT *, greatest(0, least(length(body), {retrieve.PACK_CHARS} - before))::BIGINT AS kept FROM budget),
packed0 AS (
  SELECT query_id, coalesce(string_agg(substr(body, 1, kept), chr(10) || chr(10) ORDER BY n, part) FILTER (WHERE kept > 0), '') AS context,
    count(*) FILTER (WHERE part = 0 AND before < {retrieve.PACK_CHARS}) AS n_hits, count(*) FILTER (WHERE kept > 0) AS n_segments, sum(kept)::BIGINT AS n_chars, sum(kept) < sum(length(body)) AS clipped
  FROM clipped GROUP BY query_id
),
packed AS (
  SELECT query_id, coalesce(context, '') AS context, coalesce(n_hits, 0) AS n_hits, coalesce(n_segments, 0) AS n_segments, coalesce(n_chars, 0) AS n_chars, coalesce(clipped, false) OR coalesce(n_hits, 0) < every AS truncated
  FROM (SELECT query_id, count(*) AS every FROM inflated GROUP BY query_id) LEFT JOIN packed0 USING (query_id)
)
"""


@listing.add(f"WITH {ASKED} SELECT query_id, vec_id, item, generation, unit, channel, score, trace, length(text)::INTEGER AS text_chars FROM traced")
def traceback(spark, sf_dir):
    """How each recalled hit leads to original text."""
    hits = retrieve.traceback(recalled(spark, sf_dir), ledgers.units(spark, sf_dir), ledgers.records(spark, sf_dir))
    return hits.select("query_id", "vec_id", "item", "generation", "unit", "channel", "score", "trace", F.length("text").alias("text_chars"))


def kept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.deduped(retrieve.traceback(recalled(spark, sf_dir), ledgers.units(spark, sf_dir), ledgers.records(spark, sf_dir)))


def inflated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.inflate(retrieve.rerank(kept_hits(spark, sf_dir)), ledgers.units(spark, sf_dir))


@listing.add(f"WITH {ASKED} SELECT query_id, vec_id, item, generation, unit, score, trace FROM kept")
def dedupe_units(spark, sf_dir):
    """The best hit of each unit in a query."""
    return kept_hits(spark, sf_dir).select("query_id", "vec_id", "item", "generation", "unit", "score", "trace")


@listing.add(f"WITH {ASKED} SELECT query_id, position, vec_id, CASE WHEN granularity = 0 THEN 'document_root' ELSE 'focus_fragment' END AS tier, inflation, length(root_text)::INTEGER AS root_chars FROM inflated")
def inflate_roots(spark, sf_dir):
    """Roots attached to the returned hits."""
    return inflated_hits(spark, sf_dir).select("query_id", "position", "vec_id", retrieve.tier(F.col("granularity")).alias("tier"), "inflation", F.length("root_text").alias("root_chars"))


@listing.add(f"""WITH {ASKED},
again AS (SELECT query_id, vec_id, score, text, CASE WHEN count(*) OVER (PARTITION BY query_id) < 2 OR count(*) FILTER (WHERE text IS NULL) OVER (PARTITION BY query_id) > 0 THEN 'skipped' ELSE 'applied' END AS rerank_status FROM kept),
sorted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rerank_status = 'applied' THEN 1.0 / (1 + length(text)) ELSE score END DESC, vec_id)::INTEGER AS position FROM again)
SELECT query_id, vec_id, rerank_status, position FROM sorted WHERE position <= {retrieve.RETURN_K}""")
def rerank_hits(spark, sf_dir):
    """Hits reranked by a stand-in scorer that prefers short texts."""
    out = retrieve.rerank(kept_hits(spark, sf_dir), lambda df: df.withColumn("rerank_score", 1.0 / (1 + F.length("text"))))
    return out.select("query_id", "vec_id", "rerank_status", "position")


@listing.add(f"WITH {ASKED} SELECT query_id, sha256(context) AS context_digest, n_hits, n_segments, n_chars, truncated FROM packed")
def pack_context(spark, sf_dir):
    """Contexts by digest and size."""
    return retrieve.pack(inflated_hits(spark, sf_dir)).select("query_id", F.sha2("context", 256).alias("context_digest"), "n_hits", "n_segments", "n_chars", "truncated")


def _disposed(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    asks, fence, hits = found(spark, sf_dir, threshold)
    sizes = fence.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_scored"))
    kept = hits.where("channel = 'original'")
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    out = asks.select("query_id", "query_text", "namespace").join(sizes, "namespace", "left").join(count(hits, "n_recalled"), "query_id", "left").join(count(kept, "n_kept"), "query_id", "left")
    return out.na.fill(0, ["n_scored", "n_recalled", "n_kept"]).select("query_id", "n_scored", "n_recalled", "n_kept", retrieve.empty_reason().alias("disposition"))


DISPOSED = """SELECT q.query_id, coalesce(s.n, 0) AS n_scored, coalesce(r.n, 0) AS n_recalled, coalesce(k.n, 0) AS n_kept,
  CASE WHEN trim(coalesce(q.query_text, '')) = '' THEN 'blank_query' WHEN s.n IS NULL THEN 'no_hit' WHEN r.n IS NULL THEN 'below_threshold' WHEN k.n IS NULL THEN 'all_filtered' ELSE 'ok' END AS disposition
FROM asked q LEFT JOIN (SELECT query_id, count(*) AS n FROM scored GROUP BY 1) s USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM recalled GROUP BY 1) r USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM recalled WHERE channel = 'original' GROUP BY 1) k USING (query_id)"""


@listing.add(f"WITH {ASKED} {DISPOSED}")
def retrieval_diagnostics(spark, sf_dir):
    """Counts of each retrieval stage and why a query is empty."""
    return _disposed(spark, sf_dir, 0.0)


@listing.add(f"WITH {ASKED.replace('score >= 0)', 'score >= 0.2)')} {DISPOSED}")
def empty_disposition(spark, sf_dir):
    """The same under a higher threshold."""
    return _disposed(spark, sf_dir, 0.2)


@listing.add(f"""WITH {ASKED.replace("FROM recalled r LEFT JOIN units", "FROM (SELECT * FROM recalled WHERE channel = 'original') r LEFT JOIN units").replace("score >= 0)", "score >= 0.1)")},
disposed AS ({DISPOSED}), cut AS (SELECT query_id, bool_or(inflation = 'truncated') AS inflation_truncated FROM inflated GROUP BY query_id)
SELECT query_id, {retrieve.RECALL_K} AS recall_k, {retrieve.RETURN_K} AS return_k, 0.1::DOUBLE AS threshold_applied, n_recalled AS ann_hit_count, n_kept AS eligible_count, n_recalled - n_kept AS filtered_count, 'not_requested' AS rerank_status,
  coalesce(truncated, false) AS pack_truncated, coalesce(inflation_truncated, false) AS inflation_truncated, nullif(disposition, 'ok') AS empty_reason, 'channel=original' AS filters_echo
FROM disposed LEFT JOIN packed USING (query_id) LEFT JOIN cut USING (query_id)""")
def request_diagnostics(spark, sf_dir):
    """The report of each query whose hits must be originals: bounds, counts of each stage, what was cut, why it is empty."""
    asks, fence, hits = found(spark, sf_dir, 0.1)
    hits = settled(hits, "hits")
    kept = hits.where("channel = 'original'")
    units = ledgers.units(spark, sf_dir)
    back = retrieve.inflate(retrieve.rerank(retrieve.deduped(retrieve.traceback(kept, units, ledgers.records(spark, sf_dir)))), units)
    sizes = fence.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_scored"))
    return retrieve.diagnostics(asks, sizes, hits, kept, back, retrieve.pack(back), 0.1, {"channel": "original"})


@listing.add(f"WITH {ASKED} SELECT query_id, context, n_segments, n_chars, truncated FROM packed")
def retrieval_end_to_end(spark, sf_dir):
    """Fence, rank, trace back, dedupe, inflate and pack, for every query at once."""
    return retrieve.pack(inflated_hits(spark, sf_dir)).select("query_id", "context", "n_segments", "n_chars", "truncated")
