"""Retrieval over many queries at once: rank, trace back, inflate, dedupe, rerank, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECALL_K, RETURN_K, MOST_K = 20, 10, 100
PACK_HITS, PACK_CHARS = 5, 12_000
ROOTS, ROOT_CHARS = 3, 8_000
JOINER = "\n\n"


def top_k(hits: DataFrame, k: int = RECALL_K, threshold: float | None = 0.0, by: str = "query_id") -> DataFrame:
    """The k best hits of each query, score down, then id up; ``rank`` counts from 1.

    Spark prunes each map partition to k rows a query before the shuffle (window group limit), so no query gathers all its hits.
    """
    if not 0 < k <= MOST_K:
        raise ValueError(f"k must lie between 1 and {MOST_K}")
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    w = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def delegated(fence: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores given by another scorer (query_id, vec_id, score); ids it leaves out aren't hits."""
    return fence.join(scores, "vec_id")


def traceback(hits: DataFrame, units: DataFrame, records: DataFrame) -> DataFrame:
    """How a hit leads to original text: not_needed, resolved (body), degraded (only an original vector) or failed.

    ``text`` is the original if there is one, else for a summary hit the summary.
    """
    at = ["item", "generation", "unit"]
    originals = records.where("channel = 'original' and state = 'indexed'").groupBy(*at).agg(F.min("vec_id").alias("original_vec"))
    joined = hits.join(units.select(*at, "summary", "original"), at, "left").join(originals, at, "left")
    state = F.when(F.col("channel") == "original", "not_needed").when(F.col("original").isNotNull(), "resolved").when(F.col("original_vec").isNotNull(), "degraded").otherwise("failed")
    text = F.coalesce(F.col("original"), F.when(F.col("channel") == "summary", F.col("summary")))
    return joined.withColumn("trace", state).withColumn("text", text).drop("summary", "original", "original_vec")


def tier(granularity: Column) -> Column:
    return F.when(granularity == 0, "document_root").otherwise("focus_fragment")


def deduped(hits: DataFrame) -> DataFrame:
    """The best hit of each unit in a query: score down, resolved first, id up."""
    resolved = (F.col("trace") == "resolved").cast("int")
    w = Window.partitionBy("query_id", "item", "generation", "unit").orderBy(F.desc("score"), resolved.desc(), "vec_id")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, k: int = RETURN_K, requested: bool | None = None) -> DataFrame:
    """The first k of each query, by ``scorer``'s column rerank_score if given, and the status of the step.

    A query with fewer than two hits, or with a hit without text, is skipped; one whose scorer is missing though
    ``requested``, or gives a score that isn't finite, failed. Both keep their order.
    """
    q = Window.partitionBy("query_id")
    few = F.count(F.lit(1)).over(q) <= 1
    requested = scorer is not None if requested is None else requested
    if not requested or scorer is None:
        status = F.when(few, "skipped").otherwise("failed") if requested else F.lit("not_requested")
        out = hits.withColumn("rerank_status", status).withColumn("_s", F.col("score"))
    else:
        bare = F.count_if(F.col("text").isNull()).over(q) > 0
        finite = F.coalesce(~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf")), F.lit(False))
        status = F.when(few | bare, "skipped").when(F.count_if(~finite).over(q) > 0, "failed").otherwise("applied")
        out = scorer(hits).withColumn("rerank_status", status).withColumn("_s", F.when(F.col("rerank_status") == "applied", F.col("rerank_score")).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), "vec_id")
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("_s")


def inflate(hits: DataFrame, units: DataFrame, roots: int = ROOTS, chars: int = ROOT_CHARS) -> DataFrame:
    """Attach the root text of a hit's generation: attached, truncated, missing, or skipped (a root itself, or beyond ``roots``).

    Roots count in the order in which a query's hits first name them.
    """
    root = units.where("granularity = 0").groupBy("item", "generation").agg(F.min_by(F.coalesce("original", "summary"), "unit").alias("root_text"))
    joined = hits.join(root, ["item", "generation"], "left")
    inner = F.col("granularity") != 0
    found = inner & F.col("root_text").isNotNull()
    first = F.min(F.when(found, F.col("position"))).over(Window.partitionBy("query_id", "item", "generation"))
    nth = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_first")))
    out = joined.withColumn("_first", first).withColumn("_nth", nth)
    state = (
        F.when(~inner, "skipped").when(F.col("root_text").isNull(), "missing").when(F.col("_nth") > roots, "skipped")
        .when(F.length("root_text") > chars, "truncated").otherwise("attached")
    )
    out = out.withColumn("inflation", state)
    return out.withColumn("root_text", F.when(F.col("inflation").isin("attached", "truncated"), F.substring("root_text", 1, chars))).drop("_first", "_nth")


def segments(hits: DataFrame, most: int = PACK_HITS) -> DataFrame:
    """The texts to pack, in order: of the first ``most`` hits with text, each followed by its root.

    A root is packed once a query, and not at all after a hit that is that root itself.
    """
    usable = hits.where(F.col("text").isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("n") <= most)
    rooted = (F.col("granularity") == 0) | F.col("root_text").isNotNull()
    once = F.row_number().over(Window.partitionBy("query_id", "item", "generation", rooted).orderBy("position"))
    usable = usable.withColumn("_once", once)
    both = F.array(
        F.struct(F.lit(0).alias("part"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("part"), F.when(F.col("_once") == 1, F.col("root_text")).alias("body")),
    )
    return usable.select("query_id", "n", F.explode(both).alias("s")).select("query_id", "n", "s.part", "s.body").where("body is not null")


def pack(hits: DataFrame, most: int = PACK_HITS, chars: int = PACK_CHARS) -> DataFrame:
    """(query_id, context, n_hits, n_segments, n_chars, truncated): segments clipped by a running budget and joined by a blank line.

    ``truncated`` says that a text was clipped or that a hit was left out: for want of text, beyond ``most``, or beyond the budget.
    """
    w = Window.partitionBy("query_id").orderBy("n", "part").rowsBetween(Window.unboundedPreceding, -1)
    s = segments(hits, most).withColumn("before", F.coalesce(F.sum(F.length("body")).over(w), F.lit(0)))
    s = s.withColumn("kept", F.greatest(F.lit(0), F.least(F.length("body").cast("long"), chars - F.col("before"))))
    packed = s.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept") > 0, F.struct("n", "part", F.expr("substring(body, 1, int(kept))").alias("t"))))), lambda x: x["t"]), JOINER).alias("context"),
        F.count_if((F.col("part") == 0) & (F.col("before") < chars)).alias("n_hits"),
        F.count_if(F.col("kept") > 0).alias("n_segments"),
        F.sum("kept").alias("n_chars"),
        (F.sum("kept") < F.sum(F.length("body"))).alias("clipped"),
    )
    every = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("every")).join(packed, "query_id", "left").na.fill(0, ["n_hits", "n_segments", "n_chars"])
    return every.select("query_id", F.coalesce("context", F.lit("")).alias("context"), "n_hits", "n_segments", "n_chars", (F.coalesce("clipped", F.lit(False)) | (F.col("n_hits") < F.col("every"))).alias("truncated"))


def empty_reason() -> Column:
    """Why a query (query_text, n_scored, n_recalled, n_kept) came back empty, the first reason that holds; else ok."""
    return (
        F.when(F.trim(F.coalesce("query_text", F.lit(""))) == "", "blank_query").when(F.col("n_scored") == 0, "no_hit")
        .when(F.col("n_recalled") == 0, "below_threshold").when(F.col("n_kept") == 0, "all_filtered").otherwise("ok")
    )


def diagnostics(asks: DataFrame, scored: DataFrame, hits: DataFrame, eligible: DataFrame, returned: DataFrame, packed: DataFrame, threshold: float, filters: dict[str, str], recall_k: int = RECALL_K, return_k: int = RETURN_K) -> DataFrame:
    """What each query asked for and what became of it: bounds, threshold, counts by stage, rerank status, what was cut, why it is empty (else null), and its filters.

    ``asks`` (query_id, query_text, namespace) all stay; ``scored`` is (namespace, n_scored); ``hits`` are what was recalled, ``eligible`` those that filters left,
    ``returned`` hits with rerank_status and inflation, ``packed`` contexts. Each side is a row a query before it is joined.
    """
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    seen = returned.groupBy("query_id").agg(F.max("rerank_status").alias("rerank_status"), F.bool_or(F.col("inflation") == "truncated").alias("inflation_truncated"))
    out = asks.select("query_id", "query_text", "namespace").join(scored, "namespace", "left").join(count(hits, "n_recalled"), "query_id", "left").join(count(eligible, "n_kept"), "query_id", "left")
    out = out.join(seen, "query_id", "left").join(packed.select("query_id", F.col("truncated").alias("pack_truncated")), "query_id", "left").na.fill(0, ["n_scored", "n_recalled", "n_kept"])
    empty = empty_reason()
    return out.select(
        "query_id", F.lit(recall_k).alias("recall_k"), F.lit(return_k).alias("return_k"), F.lit(float(threshold)).alias("threshold_applied"), F.col("n_recalled").alias("ann_hit_count"), F.col("n_kept").alias("eligible_count"),
        (F.col("n_recalled") - F.col("n_kept")).alias("filtered_count"), F.coalesce("rerank_status", F.lit("not_requested")).alias("rerank_status"), F.coalesce("pack_truncated", F.lit(False)).alias("pack_truncated"),
        F.coalesce("inflation_truncated", F.lit(False)).alias("inflation_truncated"), F.when(empty != "ok", empty).alias("empty_reason"), F.lit(";".join(f"{k}={v}" for k, v in sorted(filters.items()))).alias("filters_echo"),
    )
