"""Mixing sources to target weights by Poisson replication (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import broadcast_if_small, table

#: Exponent of the default target weights: a source of n rows gets weight n ** ALPHA.
ALPHA = 0.5
#: Expected rows of the mixture, as a multiple of the input's rows.
EPOCHS = 1.0
#: A rate above CHUNK is drawn as a sum of equal independent Poisson draws, each of at most CHUNK.
CHUNK = 16
#: Terms of the distribution function kept for one draw; beyond them lies less than 1e-15.
TERMS = 80
#: Rows up to which the table of sources is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 100_000
SEED = "mix-1"
INNER = ("__source", "__rate", "__chunks", "__cdf", "__n")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """Per source the mean number of repetitions and the distribution function of one draw.

    ``weights`` (source, weight) gives target shares; sources it lacks, or with a null, negative, NaN or
    infinite weight, get none. Without it the weight of a source is its row count to the power ``alpha``.
    """
    counts = docs.groupBy(F.col("source").alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        weighed = counts.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("__given")).agg(F.sum(F.when(~F.isnan(F.col("weight").cast("double")) & (F.abs(F.col("weight").cast("double")) < float("inf")), F.col("weight"))).alias("__w"))
        weighed = counts.join(given, F.col("__source").eqNullSafe(F.col("__given")), "left").select("__source", "__n", F.greatest(F.coalesce(F.col("__w").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__w"))
    totals = weighed.agg(F.sum("__w").alias("__all_w"), F.sum("__n").alias("__all_n"))
    rated = weighed.crossJoin(F.broadcast(totals))  # totals is one row
    rate = F.when(F.col("__all_w") > 0, F.lit(float(epochs)) * F.col("__all_n") * (F.col("__w") / F.col("__all_w")) / F.col("__n")).otherwise(F.lit(0.0))
    rated = rated.withColumn("__rate", rate).withColumn("__chunks", F.greatest(F.ceil(F.col("__rate") / CHUNK), F.lit(1)).cast("int"))
    part = F.col("__rate") / F.col("__chunks")
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("c"), F.array(F.exp(-part)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * part / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return rated.select("__source", "__n", "__rate", "__chunks", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["cdf"].alias("__cdf"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Repeat every document by a Poisson count around its source's rate, in one global random order.

    Adds ``copy_no`` (from 0), ``n_copies``, ``rate`` and ``shuffle_key``, by which the rows are
    sorted; input columns of these names are replaced. A document's count depends on the seed, its
    doc_id and its source's rate alone: rows that repeat a doc_id get the same count, and any retry
    draws it again. A null source is a source of its own, a null doc_id counts as the text "null",
    texts are never looked at, and an empty table gives an empty one.
    """
    mine = ("copy_no", "n_copies", "rate", "shuffle_key", *INNER)
    docs = docs.drop(*mine)
    rates = broadcast_if_small(source_rates(docs.select("source"), weights, alpha, epochs), "rates", BROADCAST_ROWS)
    drawn = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("__chunks")), lambda i: F.struct(uniform(seed, F.col("doc_id"), i).alias("u"))),
        F.lit(0),
        lambda acc, x: acc + F.size(F.filter(F.col("__cdf"), lambda c: c <= x["u"])),
    )
    kept = docs.join(rates, docs["source"].eqNullSafe(rates["__source"])).withColumn("n_copies", drawn).filter("n_copies > 0").withColumnRenamed("__rate", "rate")
    out = kept.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1))).drop(*INNER)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("copy"), F.col("copy_no").cast("string")))
    return out.withColumn("shuffle_key", key).orderBy("shuffle_key")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents, whole rows, by square-root weights of the sources' sizes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return replicate(docs).withColumn("rate", F.round("rate", 6))


ORACLE_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(pow(n::DOUBLE, {ALPHA})) AS all_w, sum(n) AS all_n FROM counts),
rates AS (
  SELECT source, {EPOCHS} * all_n * (pow(n::DOUBLE, {ALPHA}) / all_w) / n AS rate FROM counts, totals
),
parts AS (SELECT source, rate, greatest(ceil(rate / {CHUNK}), 1)::INTEGER AS chunks FROM rates),
terms AS (
  SELECT source, k, exp(-rate / chunks + k * ln(rate / chunks) - lgamma(k + 1)) AS p
  FROM parts, range(0, {TERMS + 1}) t(k)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM terms),
draws AS (
  SELECT DISTINCT doc_id, d.source, i,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT / {float(2**52)} AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, 1000) t(i) WHERE i <= chunks
),
counted AS (
  SELECT doc_id, w.source, count(k) AS n_copies
  FROM draws w LEFT JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.c <= w.u GROUP BY doc_id, w.source
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, n_copies::INTEGER AS n_copies, round(rate, 6) AS rate,
  copy_no::INTEGER AS copy_no, md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':copy:' || copy_no) AS shuffle_key
FROM documents d
JOIN counted n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source
JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(0, 1000) t(copy_no)
WHERE copy_no < n_copies
"""
