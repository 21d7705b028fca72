"""A bounded outbox supervisor and leases: state that outlives the query, in a versioned store or in the stream's own state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lamella.functions.workers import workers_import
from lamella.sources.shared import settled
from lamella.sources.versions import SEEN, VERSION, Conflict, Store

#: Messages that one tick delivers at most, and attempts after which a message is dead.
MOST, ATTEMPTS = 32, 8
#: Units of the caller's clock for which a claimed message is kept from other supervisors.
LEASE = 30
KEYS = {"outbox": ("team", "dedupe_key"), "delivered": ("team", "dedupe_key"), "batches": ("batch",)}
MESSAGE = "team long, dedupe_key string, kind string, payload string, available_at long"
Deliver = Callable[[DataFrame], DataFrame]


def store(spark: SparkSession, root: str) -> Store:
    """The outbox (team, dedupe_key, kind, payload, available_at, status, attempts, lease_until), what was delivered, and which batches were taken."""
    s = Store(spark, root, KEYS)
    if not s.version():
        outbox = spark.createDataFrame([], f"{MESSAGE}, status string, attempts int, lease_until long")
        s.commit({"outbox": outbox, "delivered": spark.createDataFrame([], "team long, dedupe_key string, answer string"), "batches": spark.createDataFrame([], "batch long")}, 0)
    return s


def taken(s: Store, messages: DataFrame, batch: int) -> int:
    """Put a batch's messages into the outbox, each key once for good, and remember the batch in the same commit: one that is replayed after a restart changes nothing."""
    v = s.version()
    if not s.snapshot("batches", v).where(f"batch = {int(batch)}").isEmpty():
        return v
    new = messages.dropDuplicates(["team", "dedupe_key"]).join(s.snapshot("outbox", v).select("team", "dedupe_key"), ["team", "dedupe_key"], "left_anti")
    fresh = new.select("team", "dedupe_key", "kind", "payload", "available_at", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("lease_until"))
    return s.commit({"outbox": fresh.withColumn(SEEN, F.lit(0).cast("long")), "batches": s.spark.createDataFrame([(batch,)], "batch long")}, v)


def tick(s: Store, now: int, deliver: Deliver, most: int = MOST, lease: int = LEASE, attempts: int = ATTEMPTS) -> int:
    """Claim at most ``most`` due messages, deliver them and settle their fate; returns how many were claimed.

    Due is what is pending, or in flight under a lease that is over, in the order of (available_at, team, key). Claims are a commit of their own,
    so that two supervisors never hold one message. ``deliver`` maps claimed messages to (team, dedupe_key, answer), an answer being null where it failed; the answers
    and the new states are one commit, so that a crash before it only lets the lease run out. A failed message becomes pending
    again until its attempts are used up, then dead.
    """
    v = s.version()
    due = s.snapshot("outbox", v).where((F.col("status") == "pending") | ((F.col("status") == "in_flight") & (F.col("lease_until") <= now))).where(F.col("available_at") <= now)
    claimed = settled(due.orderBy("available_at", "team", "dedupe_key").limit(most), "claimed")
    n = claimed.count()
    if not n:
        return 0
    held = claimed.withColumn("status", F.lit("in_flight")).withColumn("attempts", F.col("attempts") + 1).withColumn("lease_until", F.lit(now + lease).cast("long"))
    try:
        mine = s.commit({"outbox": held.withColumn(SEEN, F.col(VERSION)).drop(VERSION)}, v)
    except Conflict:  # another supervisor was first
        return 0
    answers = settled(deliver(held.drop(VERSION)).select("team", "dedupe_key", "answer"), "answers")
    done = held.drop(VERSION).join(answers, ["team", "dedupe_key"], "left")
    status = F.when(F.col("answer").isNotNull(), "delivered").when(F.col("attempts") >= attempts, "dead").otherwise("pending")
    after = done.withColumn("status", status).withColumn("lease_until", F.lit(None).cast("long")).drop("answer").withColumn(SEEN, F.lit(mine).cast("long"))
    s.commit({"outbox": after, "delivered": answers.where("answer is not null")}, mine)
    return n


def supervised(messages: DataFrame, s: Store, deliver: Deliver, checkpoint: str, clock: Callable[[], int] = lambda: int(time.time()), most: int = MOST, attempts: int = ATTEMPTS) -> StreamingQuery:
    """A stream of messages (MESSAGE) into the outbox, delivered by bounded ticks after each micro-batch until none is due.

    Killed at any point and started again from ``checkpoint``, it delivers every message, and what it stores counts each once.
    """

    def run(batch: DataFrame, number: int) -> None:
        taken(s, batch, number)
        now = clock()
        while tick(s, now, deliver, most, attempts=attempts):
            pass

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Leases(StatefulProcessor):
    """One lease a key: beats (owner, lease_ms) take or extend it, a processing-time timer ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # beyond the timer, state that no timer reached goes by itself
        self.held = handle.getValueState("held", StructType().add("owner", "string").add("until", "long"), ttlDurationMs=24 * 3_600_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for frame in rows:
            for beat in frame.itertuples(index=False):
                held = self.held.get() if self.held.exists() else None
                live = held is not None and held[1] > now
                if live and held[0] != beat.owner:
                    out.append((key[0], beat.owner, "denied"))
                    continue
                state = "extended" if live else "taken" if held is None else "recovered"
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                until = now + int(beat.lease_ms)
                self.held.update((beat.owner, until))
                self.handle.registerTimer(until)
                out.append((key[0], beat.owner, state))
        yield pd.DataFrame(out, columns=["key", "owner", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        if held is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield pd.DataFrame([(key[0], held[0], "expired")], columns=["key", "owner", "state"])

    def close(self) -> None:
        pass


def leased(beats: DataFrame) -> DataFrame:
    """What becomes of leases under a stream of beats (key, owner, lease_ms): taken, extended, denied to another owner, expired. Needs the RocksDB state store."""
    spark = beats.sparkSession
    workers_import(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return beats.groupBy("key").transformWithStateInPandas(Leases(), StructType.fromDDL("key string, owner string, state string"), "Append", "ProcessingTime")
