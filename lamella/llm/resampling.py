"""Target-distribution importance resampling: hashed n-gram features, a gain for each bucket, Gumbel top-k draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import settle, table

#: Longest run of words that is a feature.
ORDER = 1
BUCKETS = 10_000
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of monotonically_increasing_id that count within a partition.
WITHIN = 33


def words(text: Column) -> Column:
    """Maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters, in order; none of a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), "")


def ngrams(found: Column, order: int) -> Column:
    """All runs of 1 to ``order`` consecutive words, joined by one space, repeats kept."""
    if order == 1:
        return found

    def runs(w: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(found), lambda w: F.concat(w, *[runs(w, n) for n in range(2, order + 1)]))[0]  # words are cut once


def _buckets(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; counted before anything is shuffled."""
    each = texts.select(words(F.col("text")).alias("w")).select(F.explode(ngrams(F.col("w"), order)).alias("f"))
    return each.groupBy((F.crc32("f") % buckets).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for the buckets of ``docs``: 1000 times the log ratio of smoothed shares in target and corpus, floored.

    At most ``buckets`` rows, whatever the corpus: this bounds the broadcast that follows.
    """
    own = settle(_buckets(docs, order, buckets).withColumnRenamed("n", "s"), "buckets")  # counted once, summed and joined below
    goal = settle(_buckets(target, order, buckets).select(F.col("bucket").alias("b"), F.col("n").alias("t")), "buckets")
    sums = own.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("big_s")), goal.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("big_t"))
    both = own.join(goal, own["bucket"] == goal["b"], "left").crossJoin(F.broadcast(sums[0])).crossJoin(F.broadcast(sums[1]))  # sums are one row each
    up = (F.coalesce("t", F.lit(0)) + 1).cast("double") * (F.col("big_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("big_t") + buckets).cast("double")
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("long").alias("gain"))


def scores(docs: DataFrame, gain: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, with the gains joined to exploded features and summed again by row.

    A row's features lie in one task, so that sums are nearly whole before they are shuffled, however long a text is.
    """
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    each = keyed.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.explode_outer(ngrams(F.col("w"), order)).alias("f"))
    hashed = each.select("doc_id", "row", "n_words", (F.crc32("f") % buckets).cast("int").alias("at"))
    joined = hashed.join(F.broadcast(gain), hashed["at"] == gain["bucket"], "left")  # at most `buckets` rows
    total = joined.groupBy("row", "doc_id", "n_words").agg(F.count("at").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    n = F.greatest(F.col("n_features"), F.lit(1))
    weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")  # an exact floor
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return total.select("doc_id", "n_words", "n_features", F.when(n > 0, weight).cast("long").alias("weight"), (weight + noise).cast("long").alias("score"))


def ranked(rows: DataFrame, tag: str, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in the given order, over all rows and without bringing them together.

    They are range-partitioned and sorted; a row's place in its partition is kept with it, and partitions' offsets are sums
    of the sizes of those before them: a table of one row a partition.
    """
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), tag)
    cut = placed.withColumn("__part", F.shiftright("__at", WITHIN))
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.selectExpr("__part AS __later", "sum(__size) OVER (ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS __before")  # one row a partition
    joined = cut.join(F.broadcast(before), cut["__part"] == before["__later"])
    return joined.withColumn("rank", (F.coalesce("__before", F.lit(0)) + F.expr(f"__at & {(1 << WITHIN) - 1}L") + 1).cast("long")).drop("__at", "__part", "__later", "__before")


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Importance resampling of ``docs`` (doc_id, text) towards ``target`` (text): every row with its weight, score and rank.

    Features are hashed runs of words. A bucket's gain compares its share in the target with that in the corpus; a row's weight
    is the floored mean of its features' gains, its score adds Gumbel noise hashed from seed and doc_id, and of the rows with at least
    ``least_words`` words the ``percent`` of highest score are drawn (ties: the smaller doc_id, nulls last). Undrawn rows have a null rank.
    Null and empty texts have no features and weight 0; a null doc_id hashes as an empty string; rows that repeat a doc_id are
    scored each; extra columns are left out; an empty target leaves the gains of its smoothing, and an empty table gives an empty one.
    """
    docs, target = docs.select("doc_id", "text"), target.select("text")
    scored = settle(scores(docs, gains(docs, target, order, buckets), order, buckets, seed), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).agg(F.floor(F.count(F.lit(1)) * percent / 100).alias("__k"))
    mine = ranked(scored.where(able), "ranked", F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"))
    mine = mine.crossJoin(F.broadcast(drawn)).withColumn("rank", F.when(F.col("rank") <= F.col("__k"), F.col("rank")))  # one row
    out = ("doc_id", "n_features", "weight", "score", "rank")
    return mine.select(*out).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*out))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words; every document's weight, score and rank."""
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


ORACLE_SQL = rf"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(n))
),
texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x, true AS own FROM documents
  UNION ALL SELECT NULL, translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), false FROM benchmark
),
each AS (SELECT own, doc_id, unnest(regexp_extract_all(x, '{WORD}')) AS f FROM texts),
coded AS (SELECT f, hex(encode(f)) AS hexed FROM (SELECT DISTINCT f FROM each)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT FOR i IN range(length(hexed) // 2)]),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM coded, crc_table
),
counted AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM each JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted
),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM each JOIN hashed USING (f) JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    ('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT AS h FROM documents d LEFT JOIN sums USING (doc_id)
),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
