"""Queries over versioned tables, cutovers, replays, numbering and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.arrow import redacted_json
from lamella.functions.workers import workers_import
from lamella.operators import cutover, folds, workflow
from lamella.plans.base import Listing
from lamella.plans.lifecycle import CONTENT, contents
from lamella.sources import ledgers
from lamella.sources.shared import shared_path
from lamella.sources.tables import table
from lamella.sources.versions import Store

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql


@listing.add("""WITH r AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) AS every FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o_orderkey, o_orderstatus, n, every FROM orders LEFT JOIN r ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN every IS NULL THEN 'empty' WHEN n > 0 AND o_orderstatus = 'O' THEN 'returned' ELSE o_orderstatus END AS status, CASE WHEN every IS NULL THEN 3 WHEN n > 0 AND o_orderstatus = 'O' THEN 2 ELSE 1 END::BIGINT AS row_version
FROM v WHERE NOT coalesce(n = every, false)""")
def versioned_orders(spark, sf_dir):
    """Orders after four commits to a versioned table: all of them, open ones with a return changed by compare-and-set, ones without lines marked after a compaction, and those returned whole deleted."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "status")
    r = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count(F.lit(1)).alias("every"))
    s = Store(spark, shared_path(spark, "orders"), {"orders": ("o_orderkey",)})
    first = s.commit({"orders": o.withColumn("seen", F.lit(0).cast("long"))}, 0)
    now = s.snapshot("orders", first)
    seen = F.col("row_version").alias("seen")
    second = s.commit({"orders": now.where("status = 'O'").join(r.where("n > 0"), "o_orderkey", "left_semi").select("o_orderkey", F.lit("returned").alias("status"), seen)}, first)
    s.compact()
    third = s.commit({"orders": s.snapshot("orders", second).join(r, "o_orderkey", "left_anti").select("o_orderkey", F.lit("empty").alias("status"), seen)}, second)
    s.commit({"orders": s.snapshot("orders", third).join(r.where("n = every"), "o_orderkey", "left_semi").select("o_orderkey", "status", F.lit("delete").alias("op"), seen)}, third)
    return s.snapshot("orders")


def filled(spark: SparkSession, sf_dir: str) -> cutover.Store:
    """A store of all documents' records: the pointer of each serves its last generation, and one in 64 has a proof that counts another number."""
    r = contents(spark, sf_dir).select("vec_id", "item", "namespace", "generation", "channel", "unit", "content_digest", "state", F.col("deleted_at").cast("long").alias("deleted_at"), "d")
    p = ledgers.pointers(spark, sf_dir).select("item", "namespace", F.col("active_generation").cast("long"), "pointer_state")
    proofs = cutover.proven(cutover.live(r)).withColumn("members", F.col("members") + ((F.col("item") * 7) % 64 == 27).cast("long"))
    facets = r.select("vec_id", F.lit("channel").alias("facet"), F.col("channel").alias("value"))
    s = cutover.store(spark, shared_path(spark, "cutover"))
    intents = spark.createDataFrame([], "item long, namespace long, generation long, due_at long, state string")
    s.commit({"records": r.drop("d"), "pointers": p, "proofs": proofs, "facets": facets, "intents": intents}, 0)
    return s


MOVED = f"""WITH {ledgers.CTE},
live AS (SELECT r.* FROM records r WHERE state = 'indexed' AND deleted_at IS NULL),
served AS (SELECT l.*, p.pointer_state FROM live l JOIN pointers p ON l.item = p.item AND l.namespace = p.namespace AND l.generation = p.active_generation WHERE p.pointer_state = 'active'),
moved AS (SELECT *, generation + 1 AS next, vec_id + 1000000000 AS new_vec FROM served WHERE d <> 27)"""


@listing.add(f"{MOVED} SELECT item, namespace, generation, vec_id, sha256({CONTENT}) AS content_digest FROM served WHERE d = 27 UNION ALL SELECT item, namespace, next, new_vec, sha256({CONTENT}) FROM moved")
def cutover_served(spark, sf_dir):
    """What is served after every sound generation was rebuilt, proven again and cut over in one commit; those whose proof doesn't hold stay."""
    s = filled(spark, sf_dir)
    cutover.rebuild(s, 100)
    return cutover.served(s).select("item", "namespace", "generation", "vec_id", "content_digest")


@listing.add(f"""{MOVED}, gone AS (SELECT DISTINCT item, namespace, generation FROM moved),
held AS (SELECT item FROM items WHERE lifecycle <> 'active')
SELECT r.item, r.generation, count(*) AS records, sum(CASE WHEN g.item IS NOT NULL AND h.item IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS waiting FROM records r LEFT JOIN gone g ON r.item = g.item AND r.namespace = g.namespace AND r.generation = g.generation LEFT JOIN held h ON r.item = h.item
WHERE g.item IS NULL OR h.item IS NOT NULL GROUP BY ALL
UNION ALL SELECT item, next, count(*), 0 FROM moved GROUP BY item, next""")
def cutover_purged(spark, sf_dir):
    """Records by item and generation after a cutover, the retirement of what it left (but for items that aren't active) and a purge."""
    s = filled(spark, sf_dir)
    cutover.rebuild(s, 100)
    cutover.retire(s, 160, ledgers.items(spark, sf_dir).where("lifecycle <> 'active'").select("item"))
    cutover.purge(s, 160)
    open_ = s.snapshot("intents").where("state = 'open'").select("item", "namespace", "generation", F.lit(1).alias("w"))
    return s.snapshot("records").join(open_, cutover.GENERATION, "left").groupBy("item", "generation").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("w"), F.lit(0)).alias("waiting"))


KIND = "CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'cancel' ELSE 'cancelled' END ELSE 'restart' END"
TASK = {"task": "user_id", "event": "event_id", "kind": KIND, "expected_generation": "CASE WHEN k % 6 = 0 THEN 2 + k % 4 END", "root": "CASE WHEN k % 3 = 0 THEN concat('root-', user_id) WHEN k % 11 = 0 THEN 'root-other' END", "proof": "CASE WHEN value >= 5 THEN concat('proof-', event_id) END"}
NEXT = " ".join(f"WHEN '{kind}:{was}' THEN '{to}'" for kind, moves in folds.MOVES.items() for was, to in moves.items())


@listing.add(f"""WITH RECURSIVE e AS (SELECT {", ".join(f"{v} AS {k}" for k, v in TASK.items())}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
runs AS (
  SELECT task, 0::BIGINT AS n, 0::BIGINT AS event, '' AS kind, '' AS was, 'queued' AS status, '' AS verdict, 1::BIGINT AS generation, 1::BIGINT AS revision, NULL::VARCHAR AS run FROM (SELECT DISTINCT task FROM e)
  UNION ALL
  SELECT task, n, event, kind, was, CASE WHEN verdict = 'applied' THEN target ELSE was END, verdict, generation + CASE WHEN verdict = 'applied' AND kind = 'restart' THEN 1 ELSE 0 END, revision + CASE WHEN verdict = 'applied' THEN 1 ELSE 0 END,
    CASE WHEN verdict = 'applied' AND kind = 'start' THEN root WHEN verdict = 'applied' AND kind = 'restart' THEN NULL ELSE run END
  FROM (SELECT *, CASE WHEN expected_generation IS NOT NULL AND expected_generation <> generation THEN 'stale_generation' WHEN kind IN ('succeed', 'fail', 'cancelled') AND root IS NOT NULL AND run IS NOT NULL AND root <> run THEN 'stale_root'
      WHEN kind = 'succeed' AND proof IS NULL THEN 'proof_missing' WHEN target IS NULL THEN 'illegal' ELSE 'applied' END AS verdict
    FROM (SELECT r.task, e.n, e.event, e.kind, r.status AS was, r.generation, r.revision, r.run, e.expected_generation, e.root, e.proof, CASE e.kind || ':' || r.status {NEXT} END AS target FROM runs r JOIN e ON e.task = r.task AND e.n = r.n + 1))
)
SELECT task, event, kind, was, status, verdict, generation, revision FROM runs WHERE n > 0""")
def status_replay(spark, sf_dir):
    """Each task's status after each of its events: steps that are illegal, stale or without a proof change nothing, so later ones meet the status as it was."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return folds.replayed(e.selectExpr(*[f"{v} AS {k}" for k, v in TASK.items()]))


@listing.add("""SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 1) AS head, true AS shaped FROM (
  SELECT event_id, lpad(lower(to_hex(ms)), 12, '0') || '7' || lpad(lower(to_hex(n >> 18)), 3, '0') || ['8', '9', 'a', 'b'][((n >> 16) & 3) + 1] || lpad(lower(to_hex(n & 65535)), 4, '0') AS h FROM (
    SELECT event_id, epoch_ms(date_trunc('hour', ts)) AS ms, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) - 1 AS n FROM events))""")
def uuid7(spark, sf_dir):
    """Time-ordered identifiers of events taken by the hour, so that many share a millisecond: a counter keeps these in strict order. Shown without their random digits."""
    e = table(spark, sf_dir, "events", "event_id", "ts").select("event_id", F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")).alias("ms"))
    u = workflow.uuid7(e, "ms", "event_id")
    return u.select("event_id", F.substring("uuid", 1, 25).alias("head"), F.regexp_like("uuid", F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("shaped"))


NESTED = """concat('{"user": {"name": "', source, '", "Api-Key": {"a": ["', lang, '"]}}, "calls": [{"note": "see /srv/', doc_id, '/x", "headers": [{"authorization": "', source, '"}, "token=', n_chars, ' end"]}, [["bearer ', lang, '.', doc_id, '"], ', n_chars, ', null, true]], "lang": "', lang, '"', {close})"""
SAFE = """concat('{"user":{"name":"', source, '","Api-Key":"[REDACTED]"},"calls":[{"note":"see [REDACTED_PATH]","headers":[{"authorization":"[REDACTED]"},"[REDACTED] end"]},[["Bearer [REDACTED]"],', n_chars, ',null,true]],"lang":"', lang, '"}')"""
CLOSE = "CASE WHEN n_chars % 10 = 0 THEN '' ELSE '}' END"


@listing.add(f"SELECT doc_id, CASE WHEN n_chars % 10 <> 0 THEN {SAFE} END AS safe FROM documents")
def secret_json(spark, sf_dir):
    """Nested JSON without secrets, at whatever depth their keys or values stand; what can't be read isn't shown."""
    workers_import(spark)
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return d.select("doc_id", redacted_json(F.expr(NESTED.replace("{close}", CLOSE))).alias("safe"))


EXECUTION = {
    "team": "o_custkey", "execution": "o_orderkey", "manifest": "CAST(floor(o_totalprice) AS BIGINT) % 3",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'running' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'created' WHEN '2' THEN 'ready' WHEN '3' THEN 'running' WHEN '4' THEN 'waiting' ELSE 'cancelling' END END",
}
PROCESS = {
    "execution": "l_orderkey", "process": "l_orderkey * 10 + l_linenumber", "ordinal": "l_linenumber", "fence": "CAST(l_quantity AS BIGINT) % 4", "available_at": "l_shipdate", "attempts": "CAST(round(l_tax * 100) AS BIGINT)", "most": "4",
    "status": "CASE concat(l_returnflag, l_linestatus) WHEN 'NO' THEN 'ready' WHEN 'NF' THEN 'retry_wait' WHEN 'AO' THEN 'running' WHEN 'AF' THEN 'succeeded' WHEN 'RO' THEN 'ready' ELSE 'failed' END",
    "pool": "CASE WHEN l_suppkey % 4 = 0 THEN 'embed' WHEN l_suppkey % 4 = 1 THEN 'local-inference' WHEN l_suppkey % 4 = 2 THEN 'non-interactive' END", "admitted": "l_discount < 0.09", "rank": "CAST(l_quantity AS BIGINT) % 3", "created_at": "l_partkey", "deadline_at": "CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END",
}
GATE = {"gate": "o_orderkey", "execution": "o_orderkey", "gate_status": "CASE WHEN floor(o_totalprice) % 5 < 2 THEN 'released' WHEN floor(o_totalprice) % 5 < 4 THEN 'rejected' ELSE 'open' END"}
DECISION = {"team": "o_custkey", "gate": "o_orderkey", "decision": "o_orderkey * 3 + 1", "verdict": "CASE WHEN floor(o_totalprice) % 2 = 0 THEN 'approve' ELSE 'reject' END"}
SENT = (
    ("SELECT o_custkey AS team, concat('repair-wake-process:', l_orderkey * 10 + l_linenumber, ':', CAST(l_quantity AS BIGINT) % 4) AS dedupe_key, 'delivered' AS status FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey WHERE l_discount >= 0.05"),
    ("SELECT o_custkey, concat('repair-wake-execution:', o_orderkey, ':', CAST(floor(o_totalprice) AS BIGINT) % 4), 'pending' FROM {orders}"),
    ("SELECT o_custkey, concat(CASE WHEN floor(o_totalprice) % 7 = 1 THEN 'repair-' ELSE '' END, 'gate-decision:', o_orderkey * 3 + 1), CASE WHEN floor(o_totalprice) % 7 < 2 THEN 'in_flight' ELSE 'delivered' END FROM {orders} WHERE floor(o_totalprice) % 7 < 4"),
)
_listed = lambda columns: ", ".join(f"{v} AS {k}" for k, v in columns.items())
FLOW = f"""executions AS (SELECT {_listed(EXECUTION)} FROM orders),
processes AS (SELECT e.team, p.*, CASE WHEN p.status = 'running' THEN p.available_at + INTERVAL 30 DAY END AS lease_until FROM (SELECT {_listed(PROCESS)} FROM lineitem) p JOIN executions e USING (execution)),
gates AS (SELECT {_listed(GATE)} FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority LIKE '3%'), decisions AS (SELECT {_listed(DECISION)} FROM orders WHERE floor(o_totalprice) % 3 <> 0),
outbox AS ({" UNION ALL ".join(SENT).format(lineitem="lineitem", orders="orders")}), clock AS (SELECT max(l_shipdate) - INTERVAL 400 DAY AS now FROM lineitem)"""


def flow(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda df, columns: df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])
    executions = pick(o, EXECUTION)
    clock = l.agg((F.max("l_shipdate") - F.expr("INTERVAL 400 DAY")).alias("now"))
    own = pick(l, PROCESS).join(executions.select("team", "execution"), "execution").withColumn("lease_until", F.when(F.col("status") == "running", F.col("available_at") + F.expr("INTERVAL 30 DAY")))
    both = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    floor = F.floor("o_totalprice").cast("long")
    sent = both.where("l_discount >= 0.05").selectExpr("o_custkey AS team", "concat('repair-wake-process:', l_orderkey * 10 + l_linenumber, ':', CAST(l_quantity AS BIGINT) % 4) AS dedupe_key", "'delivered' AS status")
    sent = sent.unionAll(o.select("o_custkey", F.concat(F.lit("repair-wake-execution:"), "o_orderkey", F.lit(":"), floor % 4), F.lit("pending")))
    sent = sent.unionAll(o.where(floor % 7 < 4).select("o_custkey", F.concat(F.when(floor % 7 == 1, "repair-").otherwise(""), F.lit("gate-decision:"), F.col("o_orderkey") * 3 + 1), F.when(floor % 7 < 2, "in_flight").otherwise("delivered")))
    return {
        "executions": executions, "processes": own.crossJoin(F.broadcast(clock)), "outbox": sent, "decisions": pick(o.where(floor % 3 != 0), DECISION),  # the clock is one row
        "gates": pick(o.where("o_orderstatus = 'P' or o_orderpriority like '3%'"), GATE),
    }


@listing.add(f"""WITH {FLOW},
last AS (SELECT execution, bool_or(status IN ('ready', 'claimed', 'running', 'retry_wait', 'cancelling')) AS active, arg_max(status, (ordinal, process, status)) AS last FROM processes GROUP BY execution),
decided AS (SELECT d.*, g.execution, gate_status FROM decisions d JOIN gates g USING (gate)),
e AS (SELECT e.*, active, last, EXISTS (SELECT 1 FROM decided d WHERE d.execution = e.execution) AS explained FROM executions e LEFT JOIN last USING (execution)),
a AS (
  SELECT team, 'cancel_tree' AS action, execution AS id, NULL AS dedupe_key FROM e WHERE status = 'cancelling'
  UNION ALL SELECT team, 'repair_transition', execution, NULL FROM e WHERE status NOT IN ('waiting', 'cancelling', 'succeeded', 'failed', 'cancelled') AND last IN ('succeeded', 'failed', 'cancelled') AND NOT explained
  UNION ALL SELECT team, 'promote_retry', process, NULL FROM processes, clock WHERE status = 'retry_wait' AND available_at <= now
  UNION ALL SELECT team, CASE WHEN attempts < most THEN 'recover_lease' ELSE 'fail_lease' END, process, NULL FROM processes, clock WHERE status = 'running' AND lease_until < now
  UNION ALL SELECT * FROM (SELECT p.team, 'wake_process', process, 'repair-wake-process:' || process || ':' || fence AS k FROM processes p JOIN executions x USING (execution) WHERE p.status = 'ready' AND x.status NOT IN ('succeeded', 'failed', 'cancelled', 'cancelling')) w WHERE NOT EXISTS (SELECT 1 FROM outbox o WHERE o.team = w.team AND o.dedupe_key = k)
  UNION ALL SELECT * FROM (SELECT team, 'wake_execution', execution, 'repair-wake-execution:' || execution || ':' || manifest AS k FROM e WHERE status IN ('created', 'ready') AND NOT coalesce(active, false)) w WHERE NOT EXISTS (SELECT 1 FROM outbox o WHERE o.team = w.team AND o.dedupe_key = k)
  UNION ALL SELECT team, 'redeliver_decision', decision, 'repair-gate-decision:' || decision FROM decided d WHERE ((verdict = 'approve' AND gate_status = 'released') OR (verdict = 'reject' AND gate_status = 'rejected'))
    AND NOT EXISTS (SELECT 1 FROM outbox o WHERE o.team = d.team AND o.dedupe_key IN ('gate-decision:' || decision, 'repair-gate-decision:' || decision) AND o.status IN ('pending', 'in_flight'))
) SELECT team, action, id, dedupe_key FROM a""")
def repair_sweep(spark, sf_dir):
    """What a repair has to do about executions, processes, gates and leases, without repeating a message."""
    f = flow(spark, sf_dir)
    return workflow.repair_actions(f["executions"], f["processes"], f["gates"], f["decisions"], f["outbox"], F.col("now"))


@listing.add(f"""WITH {FLOW}, r AS (SELECT p.* FROM processes p JOIN executions e USING (execution), clock WHERE p.status = 'ready' AND admitted AND available_at <= now AND e.status IN ('ready', 'running')),
em AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY available_at, created_at, process) AS n FROM r WHERE pool = 'embed'),
ot AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY rank DESC, available_at, deadline_at NULLS LAST, created_at, process) AS n FROM r WHERE pool IS NULL OR pool = 'local-inference'),
b AS (SELECT * FROM em WHERE n = 1 UNION ALL SELECT * FROM ot WHERE n = 1)
SELECT team, process, pool FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY available_at, created_at, process) AS m FROM b) WHERE m = 1""")
def claim_lanes(spark, sf_dir):
    """The next process that each team may claim, from two lanes, while the remote pool is full."""
    f = flow(spark, sf_dir)
    return workflow.claimable(f["processes"], f["executions"], F.col("now"), {"local-inference": True, "non-interactive": False})
