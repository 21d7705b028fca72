"""The outbox supervisor across crashes, and leases with timers; the structure sweep on trees that break each rule; repair."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from lamella.operators import construct
from lamella.streaming import outbox


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="outbox-")


def wait(query, seconds=120):
    if not query.awaitTermination(seconds):
        query.stop()
        raise AssertionError("the stream didn't end")


def test_supervisor_survives_a_kill(spark, folder):
    rows = [(1, f"k{i % 50}", "wake", f"p{i}", 10 if i % 50 != 49 else 500) for i in range(60)]
    spark.createDataFrame(rows, outbox.MESSAGE).coalesce(1).write.parquet(f"{folder}/in")
    s, seen = outbox.store(spark, f"{folder}/store"), []

    def deliver(df):
        keys = [r.dedupe_key for r in df.collect()]
        assert len(keys) <= 20
        seen.append(keys)
        if len(seen) == 2:
            raise RuntimeError("killed")
        return df.withColumn("answer", F.when(F.col("dedupe_key") != "k7", F.concat(F.lit("a-"), "dedupe_key")))

    stream = lambda: spark.readStream.schema(outbox.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    now = iter(range(100, 10_000, 100))
    with pytest.raises(Exception):
        wait(outbox.supervised(stream(), s, deliver, f"{folder}/checkpoint", lambda: next(now), 20, 2))
    stuck = s.snapshot("outbox").where("status = 'in_flight'").count()
    assert 0 < stuck <= 20 and s.snapshot("delivered").count() < 49
    wait(outbox.supervised(stream(), s, deliver, f"{folder}/checkpoint", lambda: next(now), 20, 2))
    held = {r.dedupe_key: r for r in s.snapshot("outbox").collect()}
    assert len(held) == 50 and held["k7"].status == "dead" and held["k7"].attempts == 2
    while outbox.tick(s, 1_000, deliver, 20, attempts=2):
        pass
    done = {r.dedupe_key: r.answer for r in s.snapshot("delivered").collect()}
    assert done == {f"k{i}": f"a-k{i}" for i in range(50) if i != 7}
    assert {r.status for r in s.snapshot("outbox").collect()} == {"delivered", "dead"}


def test_two_supervisors_never_hold_one_message(spark, folder):
    s = outbox.store(spark, folder)
    outbox.taken(s, spark.createDataFrame([(1, f"k{i}", "wake", "p", 0) for i in range(5)], outbox.MESSAGE), 0)
    assert outbox.taken(s, spark.createDataFrame([(1, "other", "wake", "p", 0)], outbox.MESSAGE), 0) == s.version()  # a replayed batch
    got = []

    def nested(df):
        got.append(df.count())
        assert outbox.tick(s, 10, lambda x: x.withColumn("answer", F.lit("b")), 5) == 0  # all are held
        return df.withColumn("answer", F.lit("a"))

    assert outbox.tick(s, 10, nested, 5) == 5 and got == [5]
    assert {r.answer for r in s.snapshot("delivered").collect()} == {"a"} and outbox.tick(s, 10, nested, 5) == 0


def test_leases_extend_deny_and_expire(spark, folder):
    beats = "key string, owner string, lease_ms long"
    put = lambda rows: spark.createDataFrame(rows, beats).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    put([("a", "x", 600_000), ("b", "x", 1)])
    query = outbox.leased(spark.readStream.schema(beats).parquet(f"{folder}/in")).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        def until(n):
            end = time.time() + 90
            while time.time() < end:
                out = sorted(tuple(r) for r in spark.sql("select key, owner, state from leases").collect())
                if len(out) >= n:
                    return out
                time.sleep(0.5)
            raise AssertionError(out)

        assert until(2)[0] == ("a", "x", "taken")
        put([("a", "y", 600_000), ("a", "x", 600_000), ("c", "z", 1)])
        out = until(6)
        assert ("a", "y", "denied") in out and ("a", "x", "extended") in out and ("b", "x", "expired") in out
    finally:
        query.stop()


NODE = "doc_id long, granularity int, block_id long, start_byte long, end_byte long"


@pytest.mark.parametrize("nodes,verdict", [
    ([(0, 0, 0, 10), (1, 0, 0, 4), (1, 1, 4, 10)], "valid"),
    ([(0, 0, 0, 10), (1, 0, 0, 10), (2, 0, 0, 10)], "valid"),
    ([(0, 0, 0, 10), (1, 0, 0, 4), (2, 0, 0, 2), (2, 1, 2, 4), (1, 1, 4, 10), (5, 0, 4, 5), (5, 1, 5, 10)], "valid"),
    ([(0, 0, 0, 10), (1, 0, 0, 4), (1, 1, 5, 10)], "coverage"),
    ([(0, 0, 0, 10), (1, 0, 0, 4), (1, 1, 4, 9)], "coverage"),
    ([(0, 0, 0, 10), (1, 0, 1, 10)], "coverage"),
    ([(0, 0, 0, 10), (1, 0, 0, 6), (2, 0, 4, 8)], "crossing"),
    ([(0, 0, 0, 10), (1, 0, 0, 5), (1, 1, 5, 11)], "crossing"),
    ([(0, 0, 0, 10), (1, 0, 0, 10), (0, 1, 10, 12)], "root"),
    ([(0, 0, 0, 9)], "coverage"),
    ([(0, 0, 0, 10), (1, 0, 0, 10), (2, 0, 0, 11)], "crossing"),
])
def test_structure_verdicts(spark, nodes, verdict):
    df = spark.createDataFrame([(1, *n) for n in nodes], NODE).repartition(3)
    assert [r.verdict for r in construct.structure_verdict(df, spark.createDataFrame([(1, "0123456789")], "doc_id long, text string")).collect()] == [verdict]


def test_structure_sweep_orders_siblings(spark):
    nodes = [(0, 0, 0, 12), (1, 0, 0, 6), (2, 0, 0, 3), (2, 1, 3, 6), (1, 1, 6, 12), (2, 2, 6, 12)]
    out = {(r.granularity, r.block_id): (r.parent, r.depth, r.sibling, r.reading) for r in construct.swept(spark.createDataFrame([(1, *n) for n in nodes], NODE)).collect()}
    assert out == {(0, 0): (None, 0, 0, 0), (1, 0): ("g0b0", 1, 0, 1), (2, 0): ("g1b0", 2, 0, 2), (2, 1): ("g1b0", 2, 1, 3), (1, 1): ("g0b0", 1, 1, 4), (2, 2): ("g1b1", 2, 0, 5)}


def test_plans_never_cut(spark):
    units = spark.createDataFrame([(1, 0, 0, "c0", "body " * 5000, "sum"), (1, 2, 0, "c1", "x" * 30_000, "s"), (2, 0, 0, "c2", "body", "s"), (2, 2, 0, "c3", " ", "s")], "doc_id long, granularity int, block_id long, coordinate string, body string, summary string")
    units = units.withColumn("original_full", F.col("body")).withColumn("summary_full", F.col("summary"))
    out = {(r.doc_id, r.coordinate, r.channel): (r.state, r.text, r.place) for r in construct.planned(units).collect()}
    assert out[1, "c1", "original"] == ("planned", "x" * 30_000, 1) and out[2, "c3", "original"] == ("skipped", None, None) and (1, "c0", "original") not in out
    assert {r.state for r in construct.planned(units, 20_000).where("doc_id = 1").collect()} == {"over_budget"}
    assert {r.state for r in construct.planned(units.withColumn("body", F.lit(None).cast("string"))).where("doc_id = 2").collect()} == {"root_original_missing"}
