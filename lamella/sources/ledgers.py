"""Ledger tables derived from the driver's tables, as DataFrames and as the same CTEs for DuckDB.

Items stand for documents: every document has eight records, two generations of four, each with a vector of the
table of embeddings, which are dealt out in turn. An item's number ``d`` names the one field in which it deviates, so
that each condition of the serving fence has items that it alone keeps out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources.tables import table

KINDS = ("inline", "web", "document", "api")
METRICS = ("cosine", "l2", "inner_product")
DIMENSION = 64
#: Members that a generation must have, all of them fully valid.
MEMBERS = ("clean", "structure", "projection", "construction", "index", "proof")
#: Records of an item.
RECORDS = 8


def _if(d: int, odd: str, usual: str) -> str:
    return f"CASE WHEN d = {d} THEN {odd} ELSE {usual} END"


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" if k != v else k for k, v in columns.items())


BASE = f"SELECT doc_id * {RECORDS} + k AS vec_id, doc_id AS item, k // 4 + 1 AS generation, k % 4 AS slot FROM documents, range({RECORDS}) t(k)"
RECORD = {
    "vec_id": "vec_id", "item": "item", "d": "d", "team": "1 + item % 2", "generation": "generation", "deleted_at": "CASE WHEN d = 0 AND slot = 3 THEN 1 END",
    "namespace": "CASE WHEN d = 2 THEN 10 WHEN d = 3 THEN 11 ELSE item % 3 END", "state": "CASE WHEN vec_id % 13 = 0 THEN 'withdrawn' ELSE 'indexed' END",
    "model": _if(4, "'n'", "'m'"), "model_key": _if(5, "'l'", "'k'"), "model_version": _if(6, "'2'", "'1'"), "adapter": _if(7, "'remote'", "'local'"), "dimension": _if(8, "32", str(DIMENSION)),
    "artifact": "item * 10 + generation", "artifact_type": "'index'", "channel": "CASE WHEN slot <= 1 THEN 'summary' ELSE 'original' END",
    "unit": "CASE slot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END", "granularity": "CASE slot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END", "revision": "item * 10 + 1",
}
POINTER = {
    "item": "item", "team": "team", "namespace": "namespace", "active_generation": "g + " + _if(10, "1", "0"), "pointer_state": _if(9, "'withdrawn'", "'active'"),
    "artifact": "item * 10 + " + _if(11, "9", "g"), "last_proof": "CASE WHEN d = 12 THEN NULL WHEN d = 13 THEN -1 ELSE item * 10 + g END", "minutes": "(item * 37) % 180", "d": "d",
}
PROOF = {
    "proof": "item * 10 + generation", "proof_type": _if(14, "'other'", "'publication'"), "proof_version": _if(15, "'v0'", "'v1'"), "team": "team + " + _if(16, "1", "0"),
    "item": "item + " + _if(17, "1", "0"), "revision": "item * 10 + " + _if(18, "2", "1"), "namespace": "namespace + " + _if(19, "1", "0"), "artifact": "item * 10 + generation + " + _if(20, "5", "0"),
    "artifact_type": _if(21, "'other'", "'index'"), "model": "model", "model_key": _if(22, "'x'", "model_key"), "model_version": _if(23, "'x'", "model_version"), "adapter": _if(24, "'x'", "adapter"),
    "dimension": "dimension + " + _if(25, "1", "0"), "generation": "generation + " + _if(26, "1", "0"), "expected_count": "n + CASE WHEN d IN (27, 29) THEN 1 ELSE 0 END",
    "actual_count": "n + " + _if(29, "1", "0"), "matched_count": "n + CASE WHEN d IN (28, 29) THEN 1 ELSE 0 END",
}
GENERATION = {
    "artifact": "item * 10 + generation", "team": "team", "item": "item", "generation": "generation", "artifact_type": _if(30, "'draft'", "'index'"),
    "validation": _if(31, "'partial'", "'full_valid'"), "handle": "concat('generation-', item * 10 + generation)", "d": "d",
}
ITEM = {
    "item": "item", "team": "1 + item % 2", "source": "CASE WHEN d <> 37 THEN item % 4 END", "lifecycle": "CASE WHEN d = 32 THEN 'deactivated' WHEN d = 36 THEN 'deleted' ELSE 'active' END",
    "item_deleted_at": "CASE WHEN d = 33 THEN 1 END", "serving_revision": "CASE WHEN d = 34 THEN NULL WHEN d = 35 THEN item * 10 + 2 ELSE item * 10 + 1 END",
}
NAMESPACE_ROWS = [(k, m, "deleted" if k == 10 else "active", 1 if k == 11 else None) for k, m in [*enumerate(METRICS), (10, METRICS[0]), (11, METRICS[0])]]
NAMESPACE = "namespace long, metric string, status string, ns_deleted_at int"


def _rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id").selectExpr("doc_id AS item", "(doc_id * 7) % 64 AS d")
    return _rows(docs, ITEM)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, s, k) for t in (1, 2) for s, k in enumerate(KINDS)], "team long, source long, source_kind string")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records without their vectors."""
    base = table(spark, sf_dir, "documents", "doc_id").selectExpr("doc_id AS item", f"explode(sequence(0L, {RECORDS - 1}L)) AS k")
    base = base.selectExpr("item", f"item * {RECORDS} + k AS vec_id", "k div 4 + 1 AS generation", "k % 4 AS slot", "(item * 7) % 64 AS d")
    return _rows(base, RECORD)


def vectors(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    """Records with their vectors; the number of vectors is one row."""
    held = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("_e"), "embedding")
    n = held.agg(F.count(F.lit(1)).alias("_n"))
    return records.crossJoin(F.broadcast(n)).withColumn("_e", F.expr("vec_id % _n")).drop("_n").join(held, "_e").drop("_e")


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(records(spark, sf_dir).groupBy("item", "team", "namespace").agg({"generation": "max", "d": "min"}).selectExpr("item", "team", "namespace", "`max(generation)` AS g", "`min(d)` AS d"), POINTER)


GROUPED = ("item", "team", "namespace", "generation", "model", "model_key", "model_version", "adapter", "dimension", "d")


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = records(spark, sf_dir).selectExpr(*GROUPED, "CASE WHEN state = 'indexed' AND deleted_at IS NULL THEN 1 ELSE 0 END AS counts").groupBy(*GROUPED).agg({"counts": "sum"})
    return _rows(counted.withColumnRenamed("sum(counts)", "n"), PROOF)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(records(spark, sf_dir).select("item", "team", "generation", "d").distinct(), GENERATION)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, member, disposition): what each generation is made of."""
    every = generations(spark, sf_dir).selectExpr("artifact", "d", f"explode(array({', '.join(map(repr, MEMBERS))})) AS member")
    return every.where("NOT (d = 39 AND member = 'proof')").selectExpr("artifact", "member", "CASE WHEN d = 38 AND member = 'projection' THEN 'partial' ELSE 'full_valid' END AS disposition")


def namespaces(spark: SparkSession) -> DataFrame:
    base = spark.createDataFrame(NAMESPACE_ROWS, NAMESPACE)
    return base.selectExpr("*", "'m' AS ns_model", "'k' AS ns_model_key", "'1' AS ns_model_version", "'local' AS ns_adapter", f"{DIMENSION} AS ns_dimension")


HALF = "((length(text) + 1) {div} 2)"
UNIT = {
    "summary": f"concat('unit ', unit, ': ', CASE WHEN unit = 0 THEN substr(text, 1, 400) ELSE substr(text, CAST(1 + {HALF} * (unit - 1) AS INT), 400) END)",
    "original": f"CASE WHEN (item + unit) % 3 <> 2 THEN CASE WHEN unit = 0 THEN text ELSE substr(text, CAST(1 + {HALF} * (unit - 1) AS INT), CAST({HALF} AS INT)) END END",
}


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bodies of units: (item, generation, unit, granularity, summary, original). The root holds the whole text, the two others a half each; every third unit lacks its original."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    keys = records(spark, sf_dir).select("item", "generation", "unit", "granularity").distinct()
    bodies = [f"{v.format(div='div')} AS {k}" for k, v in UNIT.items()]
    return keys.join(docs, keys["item"] == docs["doc_id"]).selectExpr("item", "generation", "unit", "granularity", *bodies)


CTE = f"""
items AS (SELECT {_list(ITEM)} FROM (SELECT doc_id AS item, (doc_id * 7) % 64 AS d FROM documents)),
sources AS (SELECT * FROM (VALUES {", ".join(f"({t}, {s}, '{k}')" for t in (1, 2) for s, k in enumerate(KINDS))}) t(team, source, source_kind)),
records AS (SELECT {_list(RECORD)} FROM (SELECT *, (item * 7) % 64 AS d FROM ({BASE}))),
pointers AS (SELECT {_list(POINTER)} FROM (SELECT item, team, namespace, max(generation) AS g, min(d) AS d FROM records GROUP BY item, team, namespace)),
proofs AS (SELECT {_list(PROOF)} FROM (SELECT {", ".join(GROUPED)}, (count(*) FILTER (WHERE state = 'indexed' AND deleted_at IS NULL))::BIGINT AS n FROM records GROUP BY ALL)),
generations AS (SELECT {_list(GENERATION)} FROM (SELECT DISTINCT item, team, generation, d FROM records)),
members AS (SELECT artifact, member, CASE WHEN d = 38 AND member = 'projection' THEN 'partial' ELSE 'full_valid' END AS disposition
  FROM generations, (SELECT unnest([{", ".join(map(repr, MEMBERS))}]) AS member) WHERE NOT (d = 39 AND member = 'proof')),
namespaces AS (SELECT *, 'm' AS ns_model, 'k' AS ns_model_key, '1' AS ns_model_version, 'local' AS ns_adapter, {DIMENSION} AS ns_dimension
  FROM (VALUES {", ".join(f"({k}, '{m}', '{s}', {'NULL' if x is None else x})" for k, m, s, x in NAMESPACE_ROWS)}) t(namespace, metric, status, ns_deleted_at)),
units AS (
  SELECT k.*, {", ".join(f"{v.format(div='//')} AS {k}" for k, v in UNIT.items())}
  FROM (SELECT DISTINCT item, generation, unit, granularity FROM records) k JOIN documents ON item = doc_id
)
"""
