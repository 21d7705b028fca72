"""Operators over ledgers: latest rows, pages, anti-joins, queues, covers, digests, transitions, budgets."""

from __future__ import annotations

import base64
import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.text import json_text
from lamella.functions.workers import workers_import


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; Spark keeps one row a key and task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keyset_page(df: DataFrame, time: str, key: str, limit: int, after: tuple | None = None, ascending: bool = False) -> DataFrame:
    """One page in the order of (time, key), from behind ``after``; limit + 1 rows, so the caller sees whether more follow."""
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        past = (F.col(time) > t) | ((F.col(time) == t) & (F.col(key) > k)) if ascending else (F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k))
        df = df.where(past)
    order = [F.asc(time), F.asc(key)] if ascending else [F.desc(time), F.desc(key)]
    return df.orderBy(*order).limit(limit + 1)


def encode_cursor(time, key, filters: dict) -> str:
    """An opaque cursor that holds its position and a digest of the filters it belongs to."""
    digest = hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([str(time), key, digest]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, filters: dict) -> tuple[str, object]:
    try:
        time, key, digest = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if encode_cursor(time, key, filters) != cursor:
        raise ValueError("the cursor belongs to other filters")
    return time, key


def conjunction(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every value given; a value of None is no condition."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def orphans(objects: DataFrame, references: DataFrame, on: str) -> DataFrame:
    """Objects without a live reference."""
    return objects.join(references.select(on).distinct(), on, "left_anti")


def unbound(owners: DataFrame, *ties: DataFrame, on: str) -> DataFrame:
    """Owners that none of several ledgers ties down."""
    for t in ties:
        owners = orphans(owners, t, on)
    return owners


#: Seconds of the first back-off, and retries after which none follows.
BACK_OFF, RETRIES = 5, 3


def retries(failed: DataFrame, now: Column) -> DataFrame:
    """Failed rows (created_at, retries) with ``ceiling_s``, which doubles, ``due_at`` by it, and ``class``: exhausted, due or waiting. A jitter below the ceiling is the caller's."""
    out = failed.withColumn("ceiling_s", BACK_OFF * F.pow(F.lit(2.0), F.col("retries"))).withColumn("due_at", F.col("created_at") + F.make_dt_interval(secs=F.col("ceiling_s").cast("decimal(18,6)")))
    return out.withColumn("class", F.when(F.col("retries") >= RETRIES, "exhausted").when(F.col("due_at") <= now, "due").otherwise("waiting"))


#: Longest ceiling of a delay in seconds.
MOST_DELAY = 60.0


def delayed(failed: DataFrame, seed: str, first: float = BACK_OFF, most: float = MOST_DELAY) -> DataFrame:
    """Failed rows (id, attempt, created_at) with ``delay_us``, spread evenly below a ceiling that doubles with each attempt up to ``most`` seconds, and ``due_at``.

    The spread is drawn from the digest of seed, id and attempt, so a lost task draws it again.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.col("attempt").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    ceiling = F.least(F.lit(float(first)) * F.pow(F.lit(2.0), F.col("attempt")), F.lit(float(most)))
    out = failed.withColumn("delay_us", F.floor(u * ceiling * 1_000_000).cast("long"))
    return out.withColumn("due_at", F.col("created_at") + F.make_dt_interval(secs=(F.col("delay_us").cast("decimal(18,6)") / 1_000_000).cast("decimal(18,6)")))


#: Rows that a worker takes from a due queue at once.
TAKEN = 32


def due_queue(rows: DataFrame, at: str, key: str, now: Column, most: int = TAKEN) -> DataFrame:
    """The rows whose time ``at`` has come, oldest first, ties by ``key``, at most ``most``; those without a time aren't due. Each partition keeps its own first rows, so the queue is never sorted whole."""
    return rows.where(F.col(at) <= now).orderBy(F.asc(at), F.asc(key)).limit(most)


def appended_once(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` to append so that every key stands once: insert-or-ignore."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def set_digest(df: DataFrame, keys: list[str], member: Column, name: str = "digest") -> DataFrame:
    """Digest of each key's members, whatever the order of rows: the digest of the digests of their buckets.

    A member's bucket is the first digit pair of its own digest, so that no task gathers all members of a key.
    """
    rows = df.select(*keys, member.alias("_m")).withColumn("_b", F.substring(F.sha2("_m", 256), 1, 2))
    buckets = rows.groupBy(*keys, "_b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_m")), "\n"), 256).alias("_d"), F.count(F.lit(1)).alias("_n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: F.concat_ws(":", x["_b"], x["_d"])), "\n")
    return buckets.groupBy(*keys).agg(F.sha2(whole, 256).alias(name), F.sum("_n").alias("members"))


def integrity_digest(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "digest") -> DataFrame:
    """Digest of each key's rows in ``order``, each a JSON list of its columns: numbers plain, texts quoted, nulls as null. Groups are those of one generation."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(json_text(F.col(c)) if kinds[c] == "string" else F.col(c).cast("string"), F.lit("null"))
    row = F.concat(F.lit("["), F.concat_ws(",", *map(cell, columns)), F.lit("]"))
    held = df.select(*keys, F.struct(*order, row.alias("_row")).alias("_x")).groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    return held.select(*keys, F.sha2(F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["_row"]), ","), F.lit("]")), 256).alias(name), F.size("_l").alias("members"))


def exact_cover(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys expected once and found otherwise: missing, unexpected or repeated."""
    e, a = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((expected, "n_expected"), (actual, "n_actual")))
    both = e.join(a, keys, "full_outer").na.fill(0, ["n_expected", "n_actual"])
    state = F.when(F.col("n_actual") == 0, "missing").when(F.col("n_expected") == 0, "unexpected").otherwise("repeated")
    return both.where("n_expected <> n_actual").withColumn("state", state)


#: Most waiting rows of the pools that choose by their queues.
LOCAL_CAP, REMOTE_CAP = 6, 4


def pool_choice(kind: Column, priority: Column, channel: Column, local_queued: Column, remote_queued: Column, local_free: Column, quota: Column, over_budget: Column) -> Column:
    """Pool of a row (local-inference, non-interactive, embed), or null: it waits or has none.

    An explicit channel is taken or waited for. Urgent and high work goes to the remote pool only, low work to the local
    one only; normal work goes to the local pool and overflows to the remote one, at once if over budget.
    """
    local = F.when(local_free & (local_queued < LOCAL_CAP), "local-inference")
    remote = F.when(quota & (remote_queued < REMOTE_CAP), "non-interactive")
    lane = F.when(priority.isin("urgent", "high"), remote).when(priority == "normal", F.when(over_budget, remote).otherwise(F.coalesce(local, remote))).when(priority == "low", local)
    named = F.when(channel == "local-inference", local).when(channel == "non-interactive", remote)
    return F.when(kind == "embed", "embed").when(kind == "generate", F.when(channel.isNotNull(), named).otherwise(lane))


def admitted(waiting: DataFrame, free: dict[str, int], order: list[str]) -> DataFrame:
    """The first rows of each pool's queue that its free slots admit."""
    slots = F.coalesce(*[F.when(F.col("pool") == p, n) for p, n in free.items()], F.lit(0))
    w = Window.partitionBy("pool").orderBy(*order)
    # the literal bound lets every task keep that many rows a pool before the shuffle
    return waiting.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(free.values(), default=0)).where(F.col("place") <= slots)


def sampled(df: DataFrame, keys: list[str], order: list[str], key: str, first: int) -> DataFrame:
    """The first rows of each class in detail (keys, kind, ``key``, n), and one summary of how many more there were.

    Each task keeps ``first`` rows a class before the shuffle, and the summary is a plain count, so that a class of any number of rows costs no task its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    detail = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first).select(*keys, F.lit("detail").alias("kind"), key, F.lit(1).cast("long").alias("n"))
    more = df.groupBy(*keys).agg((F.count(F.lit(1)) - first).alias("n")).where("n > 0")
    return detail.unionByName(more.select(*keys, F.lit("summary").alias("kind"), F.lit(None).cast(df.schema[key].dataType).alias(key), "n"))


def evidence(entries: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Entries (key, event_id, ts) with the reports (key, report, ts) under them, one row each with its ``place``; an entry without reports stays with nulls.

    A report belongs to the key's last entry at or before it, one before all entries to none. Both are sorted together by time and the last entry is carried
    along, so that neither pairs are made nor lists gathered.
    """
    both = entries.select(key, "ts", "event_id", F.lit(None).cast("long").alias("report")).unionByName(reports.select(key, "ts", F.lit(None).cast("long").alias("event_id"), "report"))
    w = Window.partitionBy(key).orderBy("ts", F.asc_nulls_first("report"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    tied = both.withColumn("_e", F.last("event_id", True).over(w)).where("report is not null and _e is not null").select(F.col("_e").alias("event_id"), "report", F.col("ts").alias("_ts"))
    placed = tied.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy("_ts", "report"))).drop("_ts")
    return entries.select("event_id", "ts").join(placed, "event_id", "left").select("event_id", "ts", "report", "place")


def terminal_outcome(status: Column) -> Column:
    """Outcome of a group: any failed, else any cancelled, else succeeded if all are, else running."""
    return F.when(F.max(status == "failed"), "failed").when(F.max(status == "cancelled"), "cancelled").when(F.min(status == "succeeded"), "succeeded").otherwise("running")


def transitions(rows: DataFrame, legal: list[tuple[str, str]], old: str, new: str) -> DataFrame:
    """Rows with whether their (old, new) pair is legal; the table of pairs is a constant of the caller."""
    table = rows.sparkSession.createDataFrame(legal, f"{old} string, {new} string").withColumn("legal", F.lit(True))
    return rows.join(F.broadcast(table), [old, new], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


def admission_overflow(waiting: DataFrame, slots: list[tuple[str, int]]) -> DataFrame:
    """Sequential admission of one team's queue over several pools: each row (team, key, priority, pool) takes its own pool's slot, else the first free one.

    While any slot is free every row takes one, so the first rows up to the number of all slots decide; each task keeps
    that many a team before the shuffle, and the fold over them has one counter a pool.
    """
    names = [p for p, _ in slots]
    w = Window.partitionBy("team").orderBy("priority", "key", "pool")
    waiting = waiting.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sum(n for _, n in slots)).drop("_n")
    state = F.struct(*[F.lit(n).alias(p) for p, n in slots], F.array().cast("array<struct<key:bigint,pool:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.coalesce(*[F.when((x["pool"] == p) & (acc[p] > 0), p) for p in names])
        got = F.coalesce(own, *[F.when(acc[p] > 0, p) for p in names])
        left = [(acc[p] - F.coalesce((got == p).cast("int"), F.lit(0))).alias(p) for p in names]
        return F.struct(*left, F.when(got.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(x["key"].alias("key"), got.alias("pool"))))).alias("out"))

    queues = waiting.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("priority", "key", "pool"))).alias("q"))
    return queues.select("team", F.explode(F.aggregate("q", state, step)["out"]).alias("e")).select("team", "e.key", "e.pool")


def budget_batches(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Batch numbers within each group such that sizes add up to at most ``budget``; a larger row is a batch alone.

    A running sum that starts anew, over rows in order within a partition: a group's rows stream through
    one task with two counters of state, and are never gathered. Rows of one order are taken by size.
    """
    workers_import(df.sparkSession)
    rows = df.select(F.col(group), F.col(order).cast("long").alias(order), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("_size")).repartition(group).sortWithinPartitions(group, order, "_size")
    kind = rows.schema[group].dataType.simpleString()

    def number(batches):
        now, batch, used = object(), -1, 0
        for b in batches:
            out = []
            for g, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if g != now:
                    now, batch, used = g, 0, n
                elif used + n > budget:
                    batch, used = batch + 1, n
                else:
                    used += n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], [group, order, "batch"])

    return rows.mapInArrow(number, f"`{group}` {kind}, `{order}` long, batch int")


def current_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row_revision of each key of an append-only table."""
    return latest(versions, keys, [F.desc("row_revision")])


def applied(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Compare-and-set: new versions for changes whose expected_revision is the current one, and the conflicts.

    Returns the changes with row_revision (null for a conflict) and state applied, conflict or missing.
    """
    held = current.select(*keys, F.col("row_revision").alias("_now"))
    out = changes.join(held, keys, "left")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("expected_revision"), "applied").otherwise("conflict")
    return out.withColumn("state", state).withColumn("row_revision", F.when(F.col("state") == "applied", F.col("_now") + 1)).drop("_now")


def metric_lines(samples: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Text exposition of counters (name, label, value): sums of samples the catalogue knows, one line each."""
    kept = samples.join(catalogue.select("name").distinct(), "name", "left_semi").groupBy("name", "label").agg(F.sum("value").alias("value"))
    return kept.select(F.concat("name", F.lit('{label="'), "label", F.lit('"} '), F.col("value").cast("string")).alias("line"))


def frozen_config(defaults: dict[str, str], layers: list[dict[str, Column]], caps: dict[str, int]) -> Column:
    """One configuration as ``key=value`` by key: each later layer's values stand above those before it where they aren't null, and caps bound numbers from whatever layer.

    Layers may only name keys that the defaults have.
    """
    if unknown := {k for layer in layers for k in layer} - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    parts = []
    for key in sorted(defaults):
        value = F.coalesce(*[layer[key] for layer in reversed(layers) if key in layer], F.lit(defaults[key]))
        if key in caps:
            value = F.least(value.cast("long"), F.lit(caps[key]).cast("long")).cast("string")
        parts.append(F.concat(F.lit(f"{key}="), value))
    return F.concat_ws(";", *parts)
