"""Operational queries: queues, pages, latest rows, covers, repair, retention, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.operators import ledger
from lamella.plans.base import Listing
from lamella.sources.tables import table

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql

POOLS = ("local", "remote", "embed")
FREE = {"local": 40, "remote": 25, "embed": 60}
STATUS = {"view": "ready", "click": "running", "error": "failed", "purchase": "succeeded", "signup": "waiting"}
CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
#: Processes stand for events: status by type, pool by id, priority by the JSON field k.
PROCESSES = f"""processes AS (
  SELECT event_id AS process, user_id AS team, ts AS created_at, ts + to_microseconds(CAST(value * 1000000 AS BIGINT)) AS available_at, {CASE} AS status,
    CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' ELSE 'embed' END AS pool,
    json_extract_string(props, '$.k')::INTEGER % 5 AS priority, json_extract_string(props, '$.k')::INTEGER AS k, value
  FROM events
)"""
NOW = "(SELECT max(ts) FROM events)"


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("process"), F.col("user_id").alias("team"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, cast(cast(round(value * 1000000) as bigint) / 1000000 as decimal(18, 6)))")).alias("available_at"),
        status.alias("status"),
        F.when(F.col("event_id") % 3 == 0, "local").when(F.col("event_id") % 3 == 1, "remote").otherwise("embed").alias("pool"),
        (k % 5).alias("priority"), k.alias("k"), "value",
    )


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the latest event's time, for the clock of a snapshot."""
    return table(spark, sf_dir, "events", "ts").agg(F.max("ts").alias("now"))


def timed(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.crossJoin(F.broadcast(now(spark, sf_dir)))  # one row


@listing.add(f"""WITH {PROCESSES}, pools AS (SELECT unnest(['local', 'remote', 'embed']) AS pool)
SELECT pool, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status IN ('ready', 'waiting')) AS queued FROM pools LEFT JOIN processes USING (pool) GROUP BY pool""")
def pool_occupancy(spark, sf_dir):
    """Running and queued processes of the fixed pools, zeros included."""
    counts = processes(spark, sf_dir).groupBy("pool").agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status").isin("ready", "waiting")).alias("queued"))
    return spark.createDataFrame([(p,) for p in POOLS], "pool string").join(counts, "pool", "left").na.fill(0)


LANES = ("urgent", "high", "normal", "low")


@listing.add(f"""WITH {PROCESSES}, c AS (SELECT process, CASE k % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS lane, CASE process % 7 WHEN 0 THEN 'embed' WHEN 1 THEN 'unpooled' ELSE 'generate' END AS kind,
  CASE process % 11 WHEN 0 THEN 'local-inference' WHEN 1 THEN 'non-interactive' WHEN 2 THEN 'other' END AS channel, CASE WHEN process % 3 > 0 AND k % 8 < 6 THEN 'local-inference' END AS l, CASE WHEN process % 5 > 0 AND k % 6 < 4 THEN 'non-interactive' END AS r, value > 80 AS rich FROM processes)
SELECT process, CASE WHEN kind = 'embed' THEN 'embed' WHEN kind = 'unpooled' THEN NULL WHEN channel = 'local-inference' THEN l WHEN channel = 'non-interactive' THEN r WHEN channel IS NOT NULL THEN NULL
  WHEN lane IN ('urgent', 'high') THEN r WHEN lane = 'low' THEN l WHEN rich THEN r ELSE coalesce(l, r) END AS choice FROM c""")
def pool_choice(spark, sf_dir):
    """Pool of each process by kind, lane, channel, queues, quota and budget."""
    k, i = F.col("k"), F.col("process")
    lane = F.element_at(F.array(*map(F.lit, LANES)), (k % 4 + 1).cast("int"))
    kind = F.when(i % 7 == 0, "embed").when(i % 7 == 1, "unpooled").otherwise("generate")
    channel = F.when(i % 11 == 0, "local-inference").when(i % 11 == 1, "non-interactive").when(i % 11 == 2, "other")
    return processes(spark, sf_dir).select("process", ledger.pool_choice(kind, lane, channel, k % 8, k % 6, i % 3 > 0, i % 5 > 0, F.col("value") > 80).alias("choice"))


@listing.add(f"""WITH {PROCESSES}, q AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority NULLS LAST, available_at, process) AS n FROM processes WHERE status = 'ready' AND available_at <= {NOW})
SELECT pool, process, priority, available_at FROM q WHERE n = 1""")
def claim_next(spark, sf_dir):
    """The next claimable process of each pool."""
    due = timed(processes(spark, sf_dir).where("status = 'ready'"), spark, sf_dir).where("available_at <= now")
    return ledger.latest(due, ["pool"], [F.asc_nulls_last("priority"), F.asc("available_at"), F.asc("process")]).select("pool", "process", "priority", "available_at")


@listing.add(f"""WITH {PROCESSES}, q AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority, created_at, process)::INTEGER AS place FROM processes WHERE status = 'waiting')
SELECT pool, process, place FROM q WHERE place <= CASE pool WHEN 'local' THEN 40 WHEN 'remote' THEN 25 ELSE 60 END""")
def admit_waiting(spark, sf_dir):
    """Waiting processes that the free slots of their pools admit."""
    return ledger.admitted(processes(spark, sf_dir).where("status = 'waiting'"), FREE, ["priority", "created_at", "process"]).select("pool", "process", "place")


@listing.add()
def admit_overflow(spark, sf_dir):
    """Admission per team where a full pool's work spills into the next one: sequential, so no SQL twin."""
    waiting = processes(spark, sf_dir).where("status = 'waiting'").select("team", F.col("process").alias("key"), "priority", "pool")
    return ledger.admission_overflow(waiting, [("local", 2), ("remote", 2), ("embed", 3)])


@listing.add("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished_n, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending_n
FROM orders GROUP BY o_custkey""")
def execution_counts(spark, sf_dir):
    """Executions (orders) of each task (customer) by status, as columns."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    n = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return o.groupBy("o_custkey").agg(n("O", "open_n"), n("F", "finished_n"), n("P", "pending_n"))


MEMBER = "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'cancelled' WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'running' END"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "cancelled").when(F.col("l_linestatus") == "F", "succeeded").otherwise("running")
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus").withColumn("status", status)


@listing.add(f"SELECT l_orderkey, l_quantity > 25 AS required, {MEMBER} AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def member_counts(spark, sf_dir):
    """Members (line items) of each execution by requiredness and status."""
    return members(spark, sf_dir).groupBy("l_orderkey", (F.col("l_quantity") > 25).alias("required"), "status").agg(F.count(F.lit(1)).alias("n"))


@listing.add(f"""WITH m AS (SELECT l_orderkey, {MEMBER} AS status FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'cancelled') THEN 'cancelled' WHEN bool_and(status = 'succeeded') THEN 'succeeded' ELSE 'running' END AS outcome, count(*) AS members
FROM m GROUP BY l_orderkey""")
def fan_in_status(spark, sf_dir):
    """Outcome of the barrier over each execution's members."""
    return members(spark, sf_dir).groupBy("l_orderkey").agg(ledger.terminal_outcome(F.col("status")).alias("outcome"), F.count(F.lit(1)).alias("members"))


@listing.add("""WITH e AS (SELECT o_orderkey AS k, count(*) AS n_expected FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1), a AS (SELECT l_orderkey AS k, count(*) AS n_actual FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
b AS (SELECT coalesce(e.k, a.k) AS k, coalesce(n_expected, 0) AS n_expected, coalesce(n_actual, 0) AS n_actual FROM e FULL JOIN a ON e.k = a.k)
SELECT *, CASE WHEN n_actual = 0 THEN 'missing' WHEN n_expected = 0 THEN 'unexpected' ELSE 'repeated' END AS state FROM b WHERE n_expected <> n_actual""")
def exact_cover(spark, sf_dir):
    """Expected executions that their first members don't cover one to one."""
    expected = table(spark, sf_dir, "orders", "o_orderkey").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"))
    actual = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return ledger.exact_cover(expected, actual, ["k"])


@listing.add("SELECT event_id, ts, event_type FROM events WHERE (ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 500)) ORDER BY ts DESC, event_id DESC LIMIT 51")
def timeline_page(spark, sf_dir):
    """A page of the timeline, newest first, behind a cursor."""
    import datetime

    return ledger.keyset_page(table(spark, sf_dir, "events", "event_id", "ts", "event_type"), "ts", "event_id", 50, (datetime.datetime(2024, 1, 15), 500))


@listing.add("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def task_page(spark, sf_dir):
    """The first page of open tasks."""
    o = ledger.conjunction(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus"), o_orderstatus="O")
    return ledger.keyset_page(o, "o_orderdate", "o_orderkey", 20)


@listing.add("SELECT conv_id, turn, role FROM conversations WHERE conv_id > 3 OR (conv_id = 3 AND turn > 0) ORDER BY conv_id, turn LIMIT 31")
def ordinal_page(spark, sf_dir):
    """A page of turns in ascending order."""
    return ledger.keyset_page(table(spark, sf_dir, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", 30, (3, 0), ascending=True)


@listing.add("SELECT event_id, ts, value FROM events WHERE event_type = 'error' AND value > 20 ORDER BY ts DESC, event_id DESC LIMIT 51")
def dead_letter_page(spark, sf_dir):
    """The newest dead letters."""
    return ledger.keyset_page(table(spark, sf_dir, "events", "event_id", "ts", "value", "event_type").where("event_type = 'error' and value > 20").drop("event_type"), "ts", "event_id", 50)


@listing.add("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'")
def time_range_filter(spark, sf_dir):
    """Events of an inclusive time range; the bounds reach the Parquet scan."""
    return table(spark, sf_dir, "events", "event_id", "ts").where("ts between timestamp'2024-01-03' and timestamp'2024-01-09'")


@listing.add("SELECT l_orderkey, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS l_linenumber, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey")
def latest_child(spark, sf_dir):
    """The latest child of each execution."""
    return ledger.latest(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber")])


@listing.add("""WITH v AS (SELECT p_brand AS prompt, p_partkey, (p_size % 3) || '.' || (p_size % 12) || '.' || (p_partkey % 20) AS version FROM part)
SELECT prompt, version, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY list_transform(string_split(version, '.'), lambda x: x::INTEGER) DESC, p_partkey) AS n FROM v) WHERE n = 1""")
def latest_prompt(spark, sf_dir):
    """The latest version of each prompt, its parts compared as numbers."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    v = p.select(F.col("p_brand").alias("prompt"), "p_partkey", F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 12).cast("string"), (F.col("p_partkey") % 20).cast("string")).alias("version"))
    return ledger.latest(v, ["prompt"], [F.desc(F.transform(F.split("version", r"\."), lambda x: x.cast("int"))), F.asc("p_partkey")]).select("prompt", "version", "p_partkey")


@listing.add("""WITH b AS (SELECT s_suppkey, s_nationkey, s_suppkey % 4 = 0 AS own, s_suppkey % 7 AS priority FROM supplier)
SELECT s_nationkey, s_suppkey, own, priority FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY own DESC, priority DESC, s_suppkey) AS n FROM b) WHERE n = 1""")
def binding_pick(spark, sf_dir):
    """The binding of each capability: the tenant's own before global ones, then by priority."""
    b = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 4 == 0).alias("own"), (F.col("s_suppkey") % 7).alias("priority"))
    return ledger.latest(b, ["s_nationkey"], [F.desc("own"), F.desc("priority"), F.asc("s_suppkey")])


ROUTES = [(1, "1-URGENT", "express"), (2, "2-HIGH", "fast"), (2, "1-URGENT", "fast"), (9, None, "default")]


@listing.add(f"""WITH routes AS (SELECT * FROM (VALUES {", ".join(f"({a}, {'NULL' if b is None else repr(b)}, {c!r})" for a, b, c in ROUTES)}) t(priority, fact, target)),
m AS (SELECT o_orderkey, target, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority) AS n FROM orders JOIN routes ON fact IS NULL OR fact = o_orderpriority)
SELECT o_orderkey, target FROM m WHERE n = 1""")
def route_pick(spark, sf_dir):
    """The first route in priority order whose guard matches; a route without guard always does."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    guard = lambda fact: F.lit(True) if fact is None else F.coalesce(F.col("o_orderpriority") == fact, F.lit(False))
    return o.select("o_orderkey", F.coalesce(*[F.when(guard(fact), target) for _, fact, target in sorted(ROUTES, key=lambda r: r[0])]).alias("target"))


@listing.add(f"""WITH {PROCESSES} SELECT team, k % 10 AS binding, arg_max(process, (created_at, process)) AS process FROM processes WHERE status = 'succeeded' GROUP BY ALL""")
def manifest_pick(spark, sf_dir):
    """The most recently completed producer of each declared input."""
    done = processes(spark, sf_dir).where("status = 'succeeded'").withColumn("binding", F.col("k") % 10)
    return done.groupBy("team", "binding").agg(F.max_by("process", F.struct("created_at", "process")).alias("process"))


@listing.add("""SELECT DISTINCT 'conversation' AS kind, conv_id::VARCHAR AS node FROM conversations UNION ALL SELECT DISTINCT 'turn', conv_id || ':' || turn FROM conversations""")
def lineage_nodes(spark, sf_dir):
    """Nodes of the lineage graph, each once."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn")
    roots = c.select(F.lit("conversation").alias("kind"), F.col("conv_id").cast("string").alias("node"))
    turns = c.select(F.lit("turn").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("node"))
    return roots.unionByName(turns).dropDuplicates(["kind", "node"])


@listing.add("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT CASE WHEN before IS NULL THEN conv_id::VARCHAR ELSE conv_id || ':' || before END AS source, conv_id || ':' || turn AS target FROM p""")
def lineage_edges(spark, sf_dir):
    """Edges from each conversation to its first turn and from turn to turn."""
    t = table(spark, sf_dir, "conversations", "conv_id", "turn").distinct()
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("before", before).select(F.when(F.col("before").isNull(), F.col("conv_id").cast("string")).otherwise(F.concat_ws(":", "conv_id", "before")).alias("source"), F.concat_ws(":", "conv_id", "turn").alias("target"))


@listing.add(f"SELECT event_id, ts FROM events WHERE ts >= {NOW} - CASE event_type WHEN 'error' THEN INTERVAL 90 DAY WHEN 'view' THEN INTERVAL 14 DAY ELSE INTERVAL 180 DAY END")
def retention_survivors(spark, sf_dir):
    """Events that retention by class leaves."""
    days = F.when(F.col("event_type") == "error", F.expr("interval 90 days")).when(F.col("event_type") == "view", F.expr("interval 14 days")).otherwise(F.expr("interval 180 days"))
    return timed(table(spark, sf_dir, "events", "event_id", "ts", "event_type"), spark, sf_dir).where(F.col("ts") >= F.col("now") - days).select("event_id", "ts")


@listing.add(f"WITH {PROCESSES} SELECT process, CASE WHEN k % 3 = 0 THEN 'fail' ELSE 'recover' END AS action FROM processes WHERE status = 'running' AND created_at + INTERVAL 60 SECOND < {NOW} - INTERVAL 10 DAY")
def lease_expired(spark, sf_dir):
    """Running processes whose lease is over, and what happens to them."""
    p = timed(processes(spark, sf_dir).where("status = 'running'"), spark, sf_dir).where("created_at + interval 60 seconds < now - interval 10 days")
    return p.select("process", F.when(F.col("k") % 3 == 0, "fail").otherwise("recover").alias("action"))


@listing.add(f"""WITH {PROCESSES}, r AS (SELECT process, k % 4 AS retries, 5 * pow(2, k % 4)::DOUBLE AS ceiling_s, created_at + to_seconds((5 * pow(2, k % 4))::BIGINT) AS due_at FROM processes WHERE status = 'failed')
SELECT process, retries, ceiling_s, due_at, CASE WHEN retries >= 3 THEN 'exhausted' WHEN due_at <= {NOW} - INTERVAL 1 DAY THEN 'due' ELSE 'waiting' END AS class FROM r""")
def retry_due(spark, sf_dir):
    """Failed processes with the ceiling of their back-off, when they are due by it, and whether they are, a day before the last event."""
    p = timed(processes(spark, sf_dir).where("status = 'failed'"), spark, sf_dir)
    return ledger.retries(p.withColumn("retries", F.col("k") % 4), F.col("now") - F.expr("interval 1 day")).select("process", "retries", "ceiling_s", "due_at", "class")


@listing.add(f"WITH {PROCESSES} SELECT process, team, available_at FROM processes WHERE status IN ('waiting', 'failed') AND available_at <= {NOW} - INTERVAL 5 DAY ORDER BY available_at, process LIMIT 32")
def due_queue(spark, sf_dir):
    """What a worker takes next: the 32 waiting or failed processes that have been due longest, five days before the last event."""
    p = timed(processes(spark, sf_dir).where("status in ('waiting', 'failed')"), spark, sf_dir)
    return ledger.due_queue(p, "available_at", "process", F.col("now") - F.expr("interval 5 days")).select("process", "team", "available_at")


@listing.add(f"""WITH {PROCESSES}, f AS (SELECT process AS id, k % 7 AS attempt, created_at FROM processes WHERE status = 'failed'),
d AS (SELECT *, floor(('0x' || substr(md5('retry:' || id || ':' || attempt), 1, 13))::BIGINT / {float(2**52)} * least(5 * pow(2, attempt), 60.0)::DOUBLE * 1000000)::BIGINT AS delay_us FROM f)
SELECT id, attempt, delay_us, created_at + to_microseconds(delay_us) AS due_at FROM d""")
def retry_delays(spark, sf_dir):
    """When each failed process is tried again: at a point below a ceiling that doubles up to a minute, drawn from its digest."""
    p = processes(spark, sf_dir).where("status = 'failed'").select(F.col("process").alias("id"), (F.col("k") % 7).alias("attempt"), "created_at")
    return ledger.delayed(p, "retry").select("id", "attempt", "delay_us", "due_at")


@listing.add(f"""WITH {PROCESSES}, teams AS (SELECT DISTINCT team FROM processes)
SELECT team FROM teams t WHERE NOT EXISTS (SELECT 1 FROM processes p WHERE p.team = t.team AND status = 'running' AND created_at > {NOW} - INTERVAL 3 DAY)
AND NOT EXISTS (SELECT 1 FROM processes p WHERE p.team = t.team AND available_at > {NOW}) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = t.team AND o_orderstatus = 'P')""")
def cleanup_eligible(spark, sf_dir):
    """Teams without a recent active process, a live lease or a pending message."""
    p = timed(processes(spark, sf_dir), spark, sf_dir)
    messages = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("team"))
    return ledger.unbound(p.select("team").distinct(), p.where("status = 'running' and created_at > now - interval 3 days"), p.where("available_at > now"), messages, on="team")


@listing.add(f"""WITH {PROCESSES} SELECT process, team FROM processes r WHERE status = 'ready' AND NOT EXISTS (SELECT 1 FROM processes a WHERE a.team = r.team AND a.status = 'running' AND a.k = r.k)""")
def stalled(spark, sf_dir):
    """Ready work that no running process of its team attends to."""
    p = processes(spark, sf_dir)
    return p.where("status = 'ready'").join(p.where("status = 'running'").select("team", "k").distinct(), ["team", "k"], "left_anti").select("process", "team")


@listing.add("SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_windows(spark, sf_dir):
    """Minutes in which a user sent more than one event."""
    e = table(spark, sf_dir, "events", "user_id", "ts")
    return e.groupBy("user_id", F.window("ts", "60 seconds")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("user_id", F.col("window.start").alias("window_start"), "n")


@listing.add("""WITH r AS (SELECT event_id, event_type, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'signup'))
SELECT event_type, h, 'detail' AS kind, event_id, 1::BIGINT AS n FROM r WHERE n <= 3 UNION ALL SELECT event_type, h, 'summary', NULL, count(*) FROM r WHERE n > 3 GROUP BY event_type, h""")
def denial_sampling(spark, sf_dir):
    """The first three denials of each class and hour in detail, and one summary of the others."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "ts").where("event_type in ('error', 'signup')").withColumn("h", F.date_trunc("hour", "ts"))
    return ledger.sampled(e, ["event_type", "h"], ["ts", "event_id"], "event_id", 3)


@listing.add("""SELECT o_custkey, o_orderkey, row_number() OVER w::INTEGER AS ordinal, lag(o_orderkey) OVER w AS predecessor FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def revision_chain(spark, sf_dir):
    """Revisions of each item with ordinal and predecessor."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("ordinal"), F.lag("o_orderkey").over(w).alias("predecessor"))


@listing.add("SELECT event_type, round(avg(CASE WHEN json_extract_string(props, '$.k')::INTEGER % 9 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing FROM events GROUP BY event_type")
def missing_trace_ratio(spark, sf_dir):
    """Share of events without a trace, by type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events", "event_type", "props").groupBy("event_type").agg(F.round(F.avg(F.when(k % 9 == 0, 1.0).otherwise(0.0)), 6).alias("missing"))


@listing.add("SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INTEGER % 10 >= 8 THEN 'dead' WHEN event_id % 23 = 0 THEN 'poisoned' ELSE 'deliver' END AS state FROM events")
def outbox_poison(spark, sf_dir):
    """Messages by fate: too many attempts, a broken payload, or to deliver."""
    payload = F.when(F.col("event_id") % 23 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.when(F.get_json_object("props", "$.k").cast("int") % 10 >= 8, "dead").when(F.try_parse_json(payload).isNull(), "poisoned").otherwise("deliver").alias("state"))


LEGAL = [("ready", "running"), ("running", "succeeded"), ("running", "failed"), ("failed", "ready"), ("waiting", "ready")]


@listing.add(f"""WITH {PROCESSES}, steps AS (SELECT team, process, lag(status) OVER (PARTITION BY team ORDER BY created_at, process) AS old, status AS new FROM processes),
legal AS (SELECT * FROM (VALUES {", ".join(map(str, LEGAL))}) t(old, new))
SELECT s.old, s.new, l.old IS NOT NULL AS legal, count(*) AS n FROM steps s LEFT JOIN legal l ON s.old = l.old AND s.new = l.new WHERE s.old IS NOT NULL GROUP BY ALL""")
def status_transitions(spark, sf_dir):
    """Status changes in each team's ledger, counted by legality."""
    p = processes(spark, sf_dir)
    steps = p.select(F.lag("status").over(Window.partitionBy("team").orderBy("created_at", "process")).alias("old"), F.col("status").alias("new")).where("old is not null")
    return ledger.transitions(steps, LEGAL, "old", "new").groupBy("old", "new", "legal").agg(F.count(F.lit(1)).alias("n"))


@listing.add("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderdate, o_orderkey)::INTEGER AS step FROM orders")
def cancellation_order(spark, sf_dir):
    """Children before the root, in the order in which a cancellation reaches them."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") == "O", "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("step"))


@listing.add("""WITH s AS (SELECT 'events_' || event_type AS name, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS label FROM events)
SELECT name || '{label="' || label || '"} ' || count(*) AS line FROM s WHERE name <> 'events_signup' GROUP BY name, label""")
def metrics_exposition(spark, sf_dir):
    """Counters as exposition text; names the catalogue lacks are left out."""
    e = table(spark, sf_dir, "events", "event_type", "value")
    samples = e.select(F.concat(F.lit("events_"), "event_type").alias("name"), F.when(F.col("value") > 10, "high").otherwise("low").alias("label"), F.lit(1).cast("long").alias("value"))
    return ledger.metric_lines(samples, spark.createDataFrame([(f"events_{t}",) for t in ("view", "click", "error", "purchase")], "name string"))


@listing.add("""WITH c AS (SELECT o_orderkey, o_orderkey % 3 AS row_revision, o_orderkey % 2 AS expected_revision FROM orders WHERE o_orderkey % 13 <> 0),
r AS (SELECT o_orderkey, o_orderkey % 2 AS expected_revision FROM orders)
SELECT r.o_orderkey, CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN c.row_revision = r.expected_revision THEN 'applied' ELSE 'conflict' END AS state, CASE WHEN c.row_revision = r.expected_revision THEN c.row_revision + 1 END AS row_revision
FROM r LEFT JOIN c ON r.o_orderkey = c.o_orderkey""")
def compare_and_set(spark, sf_dir):
    """Changes applied only where the revision they expect is the current one."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    versions = o.where("o_orderkey % 13 <> 0").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)).alias("row_revision"))
    return ledger.applied(ledger.current_versions(versions, ["o_orderkey"]), o.withColumn("expected_revision", F.col("o_orderkey") % 2), ["o_orderkey"]).select("o_orderkey", "state", "row_revision")


@listing.add("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 AND user_id % 4 <> 0")
def insert_or_ignore(spark, sf_dir):
    """The rows that an idempotent append adds: one a key, and none whose key stands already."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    first = ledger.latest(e, ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")])
    return ledger.appended_once(e.where("user_id % 4 = 0").select("user_id", "event_type").distinct(), first, ["user_id", "event_type"]).select("event_id")


@listing.add("""WITH entries AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'signup'), r AS (SELECT event_id AS report, ts, user_id FROM events WHERE event_type = 'error' AND value > 10),
tied AS (SELECT e.event_id, r.report, r.ts FROM r ASOF JOIN entries e ON r.user_id = e.user_id AND r.ts >= e.ts)
SELECT e.event_id, e.ts, t.report, CASE WHEN t.report IS NOT NULL THEN row_number() OVER (PARTITION BY e.event_id ORDER BY t.ts, t.report)::INTEGER END AS place FROM entries e LEFT JOIN tied t USING (event_id)""")
def timeline_evidence(spark, sf_dir):
    """Timeline entries with the reports under them, a row each: a report belongs to its user's last entry before it."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return ledger.evidence(e.where("event_type = 'signup'").select("user_id", "event_id", "ts"), e.where("event_type = 'error' and value > 10").select("user_id", F.col("event_id").alias("report"), "ts"), "user_id")
