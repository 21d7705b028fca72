"""Folds along sorted streams: digests, replays and sequence numbers whose state is carried from row to row, never gathered."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamella.functions.workers import workers_import
from lamella.sources.shared import settled


def ordered_digest(df: DataFrame, keys: list[str], order: list[Column], item: Column, name: str = "digest") -> DataFrame:
    """(keys, digest, members): SHA-256 of the JSON list of each key's ``item`` texts in ``order``, nulls left out.

    Rows are sorted within partitions and streamed through the hash: a key of any number of rows takes one hash state of
    memory, and its sort spills. Keys without items have the digest of the empty list.
    """
    workers_import(df.sparkSession)
    named = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    rows = df.select(*keys, *named, item.alias("_item")).repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))]).select(*keys, "_item")
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        now, state, n, schema = None, None, 0, None

        def closed(done):
            columns = [pa.array(c, t) for c, t in zip(zip(*[d[0] for d in done]), schema)] if done else [pa.array([], t) for t in schema]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], [*keys, name, "members"])

        for b in batches:
            schema, done = [b.schema.field(k).type for k in keys], []
            for row in zip(zip(*[b.column(i).to_pylist() for i in range(len(keys))]), b.column(len(keys)).to_pylist()):
                if row[0] != now or state is None:
                    if state is not None:
                        state.update(b"]")
                        done.append((now, state.hexdigest(), n))
                    now, state, n = row[0], hashlib.sha256(b"["), 0
                if row[1] is not None:
                    state.update((b"," if n else b"") + row[1].encode())
                    n += 1
            if done:
                yield closed(done)
        if state is not None:
            state.update(b"]")
            yield closed([(now, state.hexdigest(), n)])

    return rows.mapInArrow(run, f"{fields}, `{name}` string, members long")


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """One output row for each row, from a state that runs along each key's rows in ``order``.

    ``step`` (state, row) changes the state in place and returns the output columns of ``schema``. A key's rows stream through one task with
    that one state of memory, however many they are; ``order`` should be total, so that a retry gives the same.
    """
    workers_import(df.sparkSession)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        now, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = [row[k] for k in keys]
                if state is None or key != now:
                    now, state = key, start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(run, schema)


#: Statuses of a task, and from which each event leads where. A restart begins the next generation.
MOVES = {
    "start": {"queued": "running"},
    "succeed": {"running": "succeeded"},
    "fail": {"running": "failed", "cancelling": "failed", "queued": "failed"},
    "cancel": {"queued": "cancelling", "running": "cancelling"},
    "cancelled": {"cancelling": "cancelled"},
    "restart": {"failed": "queued", "cancelled": "queued"},
}
REPLAYED = "task long, event long, kind string, was string, status string, verdict string, generation long, revision long"


def _queued() -> dict:
    return {"status": "queued", "generation": 1, "revision": 1, "root": None}


def _project(state: dict, row: dict) -> dict:
    was, kind = state["status"], row["kind"]
    target = MOVES.get(kind, {}).get(was)
    if row["expected_generation"] is not None and row["expected_generation"] != state["generation"]:
        verdict = "stale_generation"
    elif kind in ("succeed", "fail", "cancelled") and row["root"] is not None and state["root"] is not None and row["root"] != state["root"]:
        verdict = "stale_root"
    elif kind == "succeed" and row["proof"] is None:
        verdict = "proof_missing"
    elif target is None:
        verdict = "illegal"
    else:
        verdict = "applied"
        state["status"] = target
        state["revision"] += 1
        if kind == "start":
            state["root"] = row["root"]
        if kind == "restart":
            state["generation"] += 1
            state["root"] = None
    return {"task": row["task"], "event": row["event"], "kind": kind, "was": was, "status": state["status"], "verdict": verdict, "generation": state["generation"], "revision": state["revision"]}


def replayed(events: DataFrame) -> DataFrame:
    """A task's status after each of its events (task, event, kind, expected_generation, root, proof), in the order of ``event``.

    An event is stale if it names another generation than the current one, or, being terminal, another root than the run has; a success needs a
    proof; and a step that the status doesn't allow is illegal. None of these changes anything, so that later events meet
    the status as it was: which a comparison of neighbouring rows can't tell.
    """
    columns = ("task", "event", "kind", "expected_generation", "root", "proof")
    return fold(events.select(*columns), ["task"], ["event"], _queued, _project, REPLAYED)


def numbered(df: DataFrame, key: str, *order: str, name: str = "sequence") -> DataFrame:
    """Rows numbered 0, 1, 2... among those of equal ``key`` in ``order``, even where one key fills the table.

    Rows are range-partitioned by (key, order), so that a hot key spreads over many partitions; each is numbered within its
    partition, and a partition's first key goes on counting from the rows of that key in the partitions before: one small row a partition. Rows without a key have no number.
    """
    parts = settled(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    own = Window.partitionBy("_part", key).orderBy(*order)
    counts = parts.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"))
    edges = counts.groupBy("_part").agg(F.min(key).alias("_first"), F.max_by("_n", key).alias("_n"), F.max(key).alias("_last"))
    before = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = edges.withColumn("_sum", F.sum("_n").over(before)).select(F.col("_last").alias("_k"), F.col("_part").alias("_p"), "_sum")
    gone = edges.join(upto, (F.col("_first") == F.col("_k")) & (F.col("_p") < F.col("_part"))).groupBy("_part", F.col("_first").alias(key)).agg(F.max("_sum").alias("_gone"))
    place = (F.row_number().over(own) - 1 + F.coalesce("_gone", F.lit(0))).cast("long")
    return parts.join(gone, ["_part", key], "left").withColumn(name, F.when(F.col(key).isNotNull(), place)).drop("_part", "_gone")
