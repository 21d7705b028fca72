"""The versioned store, cutover, retirement, folds and numbering."""

import hashlib
import json
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lamella.operators import cutover, folds
from lamella.sources.versions import Conflict, Store, put_if_absent


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="store-")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_one_writer_of_a_name(spark, root):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: put_if_absent(spark, f"{root}/x", str(i)), range(16)))
    assert sum(won) == 1 and open(f"{root}/x").read() == str(won.index(True))


def test_store_folds_snapshots_and_compacts(spark, root):
    s = Store(spark, root, {"t": ("k",), "u": ("k",)})
    make = lambda data: spark.createDataFrame(data, "k long, v string, op string")
    assert s.version() == 0
    with pytest.raises(ValueError):
        s.snapshot("t")
    assert s.commit({"t": make([(1, "a", "put"), (2, "b", "put")])}, 0) == 1
    assert s.commit({"t": make([(1, "a2", "put"), (2, None, "delete")]), "u": make([(9, "x", "put")])}, 1) == 2
    assert rows(s.snapshot("t", 1), "k", "v", "row_version") == [(1, "a", 1), (2, "b", 1)]
    assert rows(s.snapshot("t"), "k", "v", "row_version") == [(1, "a2", 2)] and rows(s.snapshot("u"), "k", "v") == [(9, "x")]
    assert s.compact() == 2
    assert s.commit({"t": make([(2, "again", "put")])}, 2) == 3
    assert [e["kind"] for e in s.entries()] == ["compact", "change"]
    assert rows(s.snapshot("t"), "k", "v", "row_version") == [(1, "a2", 2), (2, "again", 3)]
    assert rows(s.snapshot("t", 1), "k", "v") == [(1, "a"), (2, "b")] and rows(s.snapshot("t", 2), "k", "v") == [(1, "a2")]
    with pytest.raises(ValueError):
        s.commit({"t": make([(5, "x", "put"), (5, "y", "put")])}, 3)
    with pytest.raises(ValueError):
        s.snapshot("t", 7)


def test_claims_and_conflicts(spark, root):
    s = Store(spark, root, {"t": ("k",)})
    make = lambda data: spark.createDataFrame(data, "k long, v string, seen long")
    s.commit({"t": make([(1, "a", 0), (2, "b", None)])}, 0)
    with pytest.raises(Conflict):
        s.commit({"t": make([(1, "x", 0)])}, 1)  # it isn't absent
    with pytest.raises(Conflict):
        s.commit({"t": make([(3, "x", 1)])}, 1)  # it doesn't exist
    assert s.commit({"t": make([(1, "c", 1)])}, 1) == 2
    with pytest.raises(Conflict) as e:
        s.commit({"t": make([(1, "late", 1)])}, 1)  # based on version 1, changed by 2
    assert e.value.table == "t" and e.value.keys == [(1,)]
    assert s.commit({"t": make([(2, "other key", 1)])}, 1) == 3  # no conflict
    assert rows(s.snapshot("t"), "k", "v") == [(1, "c"), (2, "other key")] and s.version() == 3


def test_racing_writers(spark, root):
    s = Store(spark, root, {"t": ("k",)})
    s.commit({"t": spark.createDataFrame([(0, "start")], "k long, v string")}, 0)

    def write(i):
        try:
            return Store(spark, root, {"t": ("k",)}).commit({"t": spark.createDataFrame([(0, f"w{i}")], "k long, v string")}, 1)
        except Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(write, range(4)))
        apart = list(pool.map(lambda i: Store(spark, root, {"t": ("k",)}).commit({"t": spark.createDataFrame([(10 + i, "x")], "k long, v string")}, 1), range(4)))
    assert [n for n in out if n] == [2] and rows(s.snapshot("t"), "k", "v")[0] == (0, f"w{out.index(2)}")
    assert sorted(apart) == [3, 4, 5, 6] and s.snapshot("t").count() == 5


def filled(spark, root):
    """Three items: 1 sound, 2 with a wrong proof, 3 with a withdrawn pointer."""
    s = cutover.store(spark, root)
    records = [(10 * i + k, i, 0, 1, "summary" if k else "original", k, f"d{i}{k}", "indexed", None) for i in (1, 2, 3) for k in range(3)] + [(19, 1, 0, 1, "summary", 9, "d", "withdrawn", None)]
    df = spark.createDataFrame(records, "vec_id long, item long, namespace long, generation long, channel string, unit long, content_digest string, state string, deleted_at long")
    proofs = cutover.proven(cutover.live(df)).withColumn("members", F.when(F.col("item") == 2, F.col("members") + 1).otherwise(F.col("members")))
    pointers = spark.createDataFrame([(1, 0, 1, "active"), (2, 0, 1, "active"), (3, 0, 1, "withdrawn")], "item long, namespace long, active_generation long, pointer_state string")
    facets = df.select("vec_id", F.lit("lang").alias("facet"), F.concat(F.lit("l"), "unit").alias("value"))
    intents = spark.createDataFrame([], "item long, namespace long, generation long, due_at long, state string")
    s.commit({"records": df, "proofs": proofs, "pointers": pointers, "facets": facets, "intents": intents}, 0)
    return s


@pytest.mark.parametrize("step", ["planned", "cloned", "proven"])
def test_crash_leaves_the_old_generation(spark, root, step):
    s = filled(spark, root)
    before = rows(cutover.served(s), "vec_id", "generation")

    def crash(at):
        if at == step:
            raise RuntimeError(at)

    with pytest.raises(RuntimeError):
        cutover.rebuild(s, 100, between=crash)
    assert s.version() == 1 and rows(cutover.served(s), "vec_id", "generation") == before
    assert s.snapshot("records").count() == 10
    assert cutover.rebuild(s, 100) == 2  # and it can be done again


def test_cutover_retirement_and_purge(spark, root):
    s = filled(spark, root)
    cutover.rebuild(s, 100)
    assert rows(cutover.served(s), "vec_id", "item", "generation") == [(20, 2, 1), (21, 2, 1), (22, 2, 1), *((1_000_000_010 + k, 1, 2) for k in range(3))]
    assert rows(cutover.served(s, 1), "item", "generation") == [(1, 1)] * 3 + [(2, 1)] * 3  # the old snapshot stays
    assert rows(s.snapshot("intents"), "item", "generation", "due_at", "state") == [(1, 1, 160, "open")]
    want = json.dumps([[str(1_000_000_010 + k), f"d1{k}"] for k in range(3)], separators=(",", ":"))
    assert rows(s.snapshot("proofs").where("generation = 2"), "item", "members", "digest") == [(1, 3, hashlib.sha256(want.encode()).hexdigest())]
    assert rows(s.snapshot("facets").where("vec_id > 1000000000"), "vec_id", "value") == [(1_000_000_010 + k, f"l{k}") for k in range(3)]
    assert cutover.retire(s, 159) is None  # the frozen deadline
    assert cutover.retire(s, 160, held=spark.createDataFrame([(1,)], "item long")) is None
    assert cutover.purge(s, 999) is None

    def crash(at):
        raise RuntimeError(at)

    with pytest.raises(RuntimeError):
        cutover.retire(s, 160, between=crash)
    assert s.snapshot("records").where("deleted_at is not null").count() == 0
    assert cutover.retire(s, 160) == 3
    assert rows(s.snapshot("records").where("deleted_at is not null"), "vec_id", "deleted_at") == [(10, 160), (11, 160), (12, 160), (19, 160)]
    assert rows(cutover.served(s), "item", "generation") == [(1, 2)] * 3 + [(2, 1)] * 3
    assert cutover.purge(s, 159) is None and cutover.purge(s, 160) == 4
    assert s.snapshot("records").where("item = 1 and generation = 1").count() == 0 and s.snapshot("facets").where("vec_id < 20").count() == 0
    assert rows(s.snapshot("intents"), "state") == [("purged",)] and cutover.rebuild(s, 500) == 5


def test_cutover_conflicts_with_a_moved_pointer(spark, root):
    s = filled(spark, root)

    def move(at):
        if at == "proven":
            s.commit({"pointers": spark.createDataFrame([(1, 0, 1, "withdrawn")], "item long, namespace long, active_generation long, pointer_state string")}, 1)

    with pytest.raises(Conflict):
        cutover.rebuild(s, 100, between=move)
    assert s.version() == 2 and rows(cutover.served(s), "item") == [(2,)] * 3


def test_purge_leaves_generations_that_others_touched(spark, root):
    s = filled(spark, root)
    cutover.rebuild(s, 100)
    cutover.retire(s, 200)
    v = s.version()
    s.commit({"records": s.snapshot("records", v).where("vec_id = 10").withColumn("deleted_at", F.lit(None).cast("long")).drop("row_version")}, v)
    assert cutover.purge(s, 999) is None and s.snapshot("records").where("generation = 1 and item = 1").count() == 4


def test_ordered_digest_streams_a_hot_group(spark):
    df = spark.range(0, 200_000, 1, 16).select((F.col("id") % 50 == 0).cast("long").alias("k"), F.col("id"))
    out = {r.k: r for r in folds.ordered_digest(df, ["k"], [F.col("id").cast("string")], F.col("id").cast("string")).collect()}
    for k, keep in ((0, lambda i: i % 50), (1, lambda i: i % 50 == 0)):
        ids = sorted(str(i) for i in range(200_000) if keep(i))
        assert out[k].digest == hashlib.sha256(("[" + ",".join(ids) + "]").encode()).hexdigest() and out[k].members == len(ids)
    empty = folds.ordered_digest(df.limit(0), ["k"], [F.col("id")], F.col("id").cast("string"))
    assert empty.count() == 0


def test_replay_does_not_advance_on_illegal_steps(spark):
    events = [("succeed", None, None, "p"), ("start", None, "r1", None), ("start", None, "r2", None), ("succeed", None, "r2", "p"), ("succeed", None, "r1", None), ("succeed", 1, "r1", "p"), ("cancel", None, None, None), ("fail", None, None, None), ("restart", None, None, None)]
    late = [("start", None, "a", None), ("cancel", None, None, None), ("succeed", None, "a", "p"), ("cancelled", None, "a", None), ("restart", None, None, None), ("start", 1, "b", None), ("start", 2, "b", None), ("fail", 2, "b", None)]
    data = [(t, 10 * t + i, *e) for t, es in ((1, events), (2, late)) for i, e in enumerate(es)]
    df = spark.createDataFrame(data, "task long, event long, kind string, expected_generation long, root string, proof string").repartition(5)
    out = rows(folds.replayed(df), "event", "was", "status", "verdict", "generation", "revision")
    assert [r[1:] for r in out[:9]] == [("queued", "queued", "illegal", 1, 1), ("queued", "running", "applied", 1, 2), ("running", "running", "illegal", 1, 2), ("running", "running", "stale_root", 1, 2), ("running", "running", "proof_missing", 1, 2), ("running", "succeeded", "applied", 1, 3), *[("succeeded", "succeeded", "illegal", 1, 3)] * 3]
    assert [r[3] for r in out[9:]] == ["applied", "applied", "illegal", "applied", "applied", "stale_generation", "applied", "applied"] and out[-1][4:] == (2, 7)
    assert folds.replayed(df.limit(0)).count() == 0


def test_numbers_of_a_hot_key(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 5).when(F.col("id") < 4003, 7).when(F.col("id") >= 5990, None).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 6007).alias("o"))
    out = folds.numbered(df.repartition(7), "k", "o").collect()
    by = {}
    for r in out:
        by.setdefault(r.k, []).append((r.o, r.sequence))
    assert {n for _, n in by.pop(None)} == {None}
    for k, pairs in by.items():
        assert [n for _, n in sorted(pairs)] == list(range(len(pairs))), k
