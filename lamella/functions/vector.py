"""Vector functions as column expressions: hash embedding, validity, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores, after folding case.
TOKEN = r"[\p{L}\p{N}_]+"


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def _word(digest: Column, at: int, dimension: int) -> Column:
    """Four bytes of a token's SHA-256 in hex, big-endian, modulo the dimension."""
    return (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % dimension).cast("int")


def hash_buckets(docs: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """(key, bucket, weight): every token adds 1 to one bucket and takes a quarter from another.

    Tokens are hashed where their text is and summed by bucket, so at most ``dimension`` rows a document are shuffled, not its tokens.
    """
    hashed = docs.select(key, F.explode(tokens(F.col(text))).alias("token")).select(key, F.sha2("token", 256).alias("h"))
    pair = F.array(
        F.struct(_word(F.col("h"), 1, dimension).alias("bucket"), F.lit(1.0).alias("w")),
        F.struct(_word(F.col("h"), 9, dimension).alias("bucket"), F.lit(-0.25).alias("w")),
    )
    return hashed.select(key, F.explode(pair).alias("p")).groupBy(key, F.col("p.bucket").alias("bucket")).agg(F.sum("p.w").alias("weight"))


def hash_embedding(docs: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """(key, embedding): the buckets as a unit vector; a text without tokens (or that cancels out) is the first unit vector."""
    held = hash_buckets(docs, key, text, dimension).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("norm"))
    first = F.array(F.lit(1.0), *[F.lit(0.0)] * (dimension - 1))
    return docs.select(key).distinct().join(held, key, "left").select(key, F.when(F.col("norm") > 0, dense).otherwise(first).alias("embedding"))


def valid(v: Column, dimension: int) -> Column:
    """Right dimension and finite components only."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimension) & ~odd, F.lit(False))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero if either vector is."""
    norms = F.sqrt(inner(a, a)) * F.sqrt(inner(b, b))
    return F.when(norms > 0, inner(a, b) / norms).otherwise(0.0)


def l2_score(a: Column, b: Column) -> Column:
    """1 / (1 + distance): the higher, the nearer."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(squares))


def score(metric: Column, a: Column, b: Column) -> Column:
    """The score of a namespace's metric, rounded so that ranks don't hang on the order of summation."""
    return F.round(F.when(metric == "l2", l2_score(a, b)).when(metric == "inner_product", inner(a, b)).otherwise(cosine(a, b)), 6)


def token_similarity(a: Column, b: Column) -> Column:
    """Overlap of two token arrays over the geometric mean of their set sizes."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b).cast("double"))).otherwise(0.0)
