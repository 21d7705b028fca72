"""Ties that times and numbers leave open, and steps whose work must grow with the input only."""

import datetime

import pytest

from lamella.plans import catalogue


@pytest.fixture
def folder(spark, tmp_path):
    """A data folder of given tables: name to (rows, schema), each one file whose rows keep their order."""

    def made(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return made


def test_decisions_alike_in_time_and_number_come_in_the_order_of_their_table(spark, folder):
    day = datetime.datetime(1995, 1, 1)
    lines = [(gate, 1, flag, day) for gate, flags in ((1, "RN"), (4, "NR"), (7, "RNN"), (10, "NRR")) for flag in flags]
    sf = folder(
        orders=([(k, "O") for k in (1, 4, 7, 10)], "o_orderkey long, o_orderstatus string"),
        lineitem=(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp"),
    )
    out = {r.gate: r.state for r in catalogue.queries()["gate_decisions"](spark, sf).collect()}
    assert out == {1: "rejected", 4: "approved", 7: "rejected", 10: "approved"}


def test_a_part_of_a_batch_is_small_and_nothing_is_lost():
    import pyarrow as pa

    from lamella.functions.arrow import PART_BYTES, parts

    a = pa.array(["x" * 1000] * 5000 + [None, "y" * (3 * PART_BYTES)] + ["z"] * 10)
    cut = list(parts(a))
    assert pa.concat_arrays(cut).equals(a)
    assert all(len(p) == 1 or p.nbytes <= PART_BYTES for p in cut)


def test_requests_never_meet_the_workflows_of_a_key_one_by_one(spark):
    from lamella.operators import workflow

    requests = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "d")], "request long, key string")
    registry = spark.createDataFrame([(i, "b", 0) for i in range(50)] + [(100, "a", 1), (101, "c", 0)], "workflow long, key string, active_revision int")
    revisions = spark.createDataFrame([(i, r, f"d{i}-{r}") for i in (*range(50), 100, 101) for r in (0, 1)], "of long, revision int, digest string")
    df = workflow.resolved(requests, registry, revisions)
    assert {tuple(r) for r in df.collect()} == {(1, "a", None, None, "ambiguous"), (2, "b", None, None, "ambiguous"), (3, "c", 0, "d101-0", "resolved"), (4, "d", None, None, "missing")}
    last = df._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert last.count("Aggregate") >= 2  # both sides of the last join are counted first


def test_tokens_are_not_shuffled(spark):
    from lamella.functions import vector

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "k long, t string")
    plan = vector.hash_buckets(docs, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_refreshing_payloads_joins_nothing(spark):
    from pyspark.sql import functions as F

    from lamella.operators import construct

    blocks = spark.createDataFrame([(1, 0, 0, "body", "s"), (1, 2, 1, "line", None)], "doc_id long, granularity int, block_id long, body string, summary string")
    out = construct.refreshed(construct.stored(construct.summarised(blocks, F.create_map(F.lit("a"), F.lit("1")))), F.create_map(F.lit("revision"), F.lit("2")))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.granularity, r.original_full) for r in out.collect()] == [(0, "revision: 2\n\nbody")]


def test_requests_of_gates_are_shuffled_twice(spark):
    from pyspark.sql import functions as F

    from lamella.operators import decisions

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = spark.range(100).select(F.concat(F.lit("r"), "id").alias("request"), (F.col("id") % 7).alias("gate"), F.lit(1).alias("revision"), F.lit("approve").alias("action"), F.lit("k").alias("key"), F.lit("a").alias("actor"), F.col("id").alias("at"))
        gates = spark.range(7).selectExpr("id AS gate", "'open' AS status", "1 AS revision", "id AS execution")
        targets = spark.range(7).selectExpr("id AS gate", "'t' AS target_digest", """'{"allowed_actions":["approve"]}' AS review""")
        executions = spark.range(7).selectExpr("id AS execution", "'waiting' AS status", "id AS waiting_ref")
        out = decisions.gate_actions(requests, gates, targets, executions, requests.where("at < 0").select("gate", "key"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Range (0, 100") == 2  # the requests, and those recorded before
        assert {(r.request, r.state) for r in out.collect()} == {(f"r{i}", "accepted" if i < 7 else "repeated") for i in range(100)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_of_a_pair_of_blocks_are_taken_a_few_queries_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lamella.operators import search

    shapes, real = [], search.scores
    monkeypatch.setattr(search, "scores", lambda m, q, r: shapes.append((len(q), len(r))) or real(m, q, r))
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(300, 8)), rng.normal(size=(500, 8))
    b = pa.RecordBatch.from_pylist([{"metric": "inner_product", "d": 8, "q_ids": np.arange(300).astype("<i8").tobytes(), "q_vectors": q.tobytes(), "r_ids": np.arange(500).astype("<i8").tobytes(), "r_vectors": r.tobytes()}])
    got = {(x["query_id"], x["vec_id"]) for part in search.matched(b, 5, None) for x in part.to_pylist()}
    assert got == {(i, int(j)) for i, row in enumerate(q @ r.T) for j in np.argsort(-row)[:5]}
    assert max(n for n, _ in shapes) <= search.QUERIES and sum(n for n, _ in shapes) == 300


def test_changes_with_claims_are_written_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from pyspark.sql import functions as F

    from lamella.sources.versions import Store

    written, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: written.append(path) or real(self, path, *a, **k))
    s = Store(spark, str(tmp_path / "store"), {"t": ("k",)})
    s.commit({"t": spark.range(3).selectExpr("id AS k", "'a' AS x").withColumn("seen", F.lit(0).cast("long"))}, 0)
    s.commit({"t": s.snapshot("t").where("k = 1").select("k", F.lit("b").alias("x"), F.col("row_version").alias("seen"))}, 1)
    assert len(written) == 2
    assert sorted(tuple(r) for r in s.snapshot("t").collect()) == [(0, "a", 1), (1, "b", 2), (2, "a", 1)] and "seen" not in s.snapshot("t").columns
