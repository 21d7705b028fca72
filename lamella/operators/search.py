"""Exact nearest records for many queries: blocks of queries against blocks of records, a matrix product each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.workers import workers_import
from lamella.operators.retrieve import top_k

#: Queries and records of a block.
QUERY_BLOCK, RECORD_BLOCK = 1024, 4096
#: Queries whose scores a worker holds at a time.
QUERIES = 128
#: Parts into which a namespace's record blocks are dealt, at most; query blocks are repeated for each.
SALTS = 64


def _blocks(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(namespace, blocks): how many blocks a namespace's vectors fill."""
    return df.where(F.col(vector).isNotNull()).groupBy("namespace").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("blocks"))


def _packed(df: DataFrame, key: str, vector: str, size: int, tag: str) -> DataFrame:
    """(namespace, block, ids, vectors) in blocks of about ``size`` rows, dealt by hash so that no namespace is one group."""
    rows = df.where(F.col(vector).isNotNull()).select("namespace", F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    dealt = rows.join(_blocks(df, vector, size), "namespace").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))

    def pack(key, batches: Iterator[pa.RecordBatch]):
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        by_size: dict[int, list[int]] = {}
        vectors = t.column("v").to_pylist()
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        ids = t.column("id").to_numpy()
        for d, rows in by_size.items():
            held = np.array([vectors[i] for i in rows], np.float64)
            yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], pa.int64()) for k in key], pa.array([d], pa.int32()), pa.array([ids[rows].astype("<i8").tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())], ["namespace", f"{tag}_block", "d", f"{tag}_ids", f"{tag}_vectors"])

    pack.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return dealt.select("namespace", "block", "id", "v").groupBy("namespace", "block").applyInArrow(pack, f"namespace long, {tag}_block long, d int, {tag}_ids binary, {tag}_vectors binary")


def scores(metric: str, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Scores of all queries against all records, in double precision."""
    if metric == "l2":
        squares = np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T, 0)
        return 1 / (1 + np.sqrt(squares))
    if metric == "inner_product":
        return q @ r.T
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None, :]
    return np.divide(q @ r.T, norms, out=np.zeros_like(norms), where=norms > 0)


def matched(b: pa.RecordBatch, k: int, threshold: float | None) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of pairs of blocks: the k best records of each query (and ties).

    Blocks are views into Spark's batch and queries are taken a few at a time, so a worker holds that batch and one small matrix of scores.
    """
    for row in range(b.num_rows):
        d, metric = b.column("d")[row].as_py(), b.column("metric")[row].as_py()
        every, r = (np.frombuffer(b.column(f"{t}_vectors")[row].as_buffer(), np.float64).reshape(-1, d) for t in "qr")
        ids, ri = (np.frombuffer(b.column(f"{t}_ids")[row].as_buffer(), "<i8") for t in "qr")
        for at in range(0, len(every), QUERIES):
            s, qi = scores(metric, every[at : at + QUERIES], r), ids[at : at + QUERIES]
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else s.min(axis=1)
            keep = s >= least[:, None] - 2e-6
            if threshold is not None:
                keep &= s >= threshold - 2e-6
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ri[j]), pa.array(s[i, j])], ["query_id", "vec_id", "score"])


def search(queries: DataFrame, records: DataFrame, namespaces: DataFrame, k: int = 20, threshold: float | None = 0.0) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best records of a query's namespace, score down, then id up.

    queries: (query_id, namespace, query_embedding); records: (vec_id, namespace, embedding). Only vectors of the same
    length are compared. A pair of blocks passes on k rows a query (and ties), so no pairs are materialised
    and no query gathers its candidates. Scores are rounded to six places before they are ranked.
    """

    def run(batches):
        for b in batches:
            yield from matched(b, k, threshold)

    workers_import(queries.sparkSession)
    # the metric joins the small query blocks; a namespace's record blocks are spread over salts, so that none is one task's work
    salts = _blocks(records, "embedding", RECORD_BLOCK).select("namespace", F.least("blocks", F.lit(SALTS)).alias("salts"))
    asked = _packed(queries, "query_id", "query_embedding", QUERY_BLOCK, "q").join(namespaces.select("namespace", "metric"), "namespace").join(salts, "namespace")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts", "q_block")
    held = _packed(records, "vec_id", "embedding", RECORD_BLOCK, "r").join(salts, "namespace").withColumn("salt", F.pmod("r_block", "salts")).drop("salts", "r_block")
    pairs = asked.join(held, ["namespace", "d", "salt"])
    found = pairs.select("metric", "d", "q_ids", "q_vectors", "r_ids", "r_vectors").mapInArrow(run, "query_id long, vec_id long, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), k, threshold)
