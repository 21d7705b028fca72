"""Queries of workflow ledgers: gates, restarts, scatter facts, registrations, transitions, readiness, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import ledger, workflow
from lamella.plans.base import Listing
from lamella.plans.operations import PROCESSES, processes
from lamella.sources.tables import table

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql

#: Gates stand for events, tasks for their users; executions for orders; the expressions below hold in both engines.
GATES = {"gate": "event_id", "team": "user_id % 3", "task": "user_id", "execution": "event_id % 500", "opened_at": "ts", "status": "CASE WHEN event_type IN ('view', 'click') THEN 'open' WHEN event_type = 'error' THEN 'rejected' ELSE 'released' END"}
STATUS = "CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'cancelling' ELSE 'running' END WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'succeeded' END ELSE 'cancelled' END"
EXECUTIONS = {"execution": "o_orderkey", "root": "CASE WHEN o_orderkey % 8 >= 5 THEN o_orderkey - o_orderkey % 8 ELSE o_orderkey END", "task": "o_custkey", "team": "o_custkey % 3", "generation": "o_orderkey % 5", "status": STATUS}
CHILD = "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_linenumber % 2 = 0 THEN 'running' ELSE 'succeeded' END"


def _sql(name: str, columns: dict[str, str], source: str, where: str = "true") -> str:
    return f"{name} AS (SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {source} WHERE {where})"


def _df(spark: SparkSession, sf_dir: str, columns: dict[str, str], source: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, source).where(where).selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


TARGETS = {"team": "user_id % 3", "gate": "event_id", "target": "concat('t', event_id)"}


@listing.add(f"""WITH {_sql("gates", GATES, "events")}, {_sql("targets", TARGETS, "events", "event_id % 2 = 0")}, o AS (SELECT *, row_number() OVER (PARTITION BY team, task ORDER BY opened_at DESC, gate DESC) AS n, count(*) OVER (PARTITION BY team, task) AS open_gates FROM gates WHERE status = 'open')
SELECT o.team, task, o.gate, target, open_gates FROM o LEFT JOIN targets t ON o.team = t.team AND o.gate = t.gate WHERE n = 1""")
def open_gate(spark, sf_dir):
    """The newest open gate of each task."""
    return workflow.open_gates(_df(spark, sf_dir, GATES, "events"), _df(spark, sf_dir, TARGETS, "events", "event_id % 2 = 0")).select("team", "task", "gate", "target", "open_gates")


RESTARTS = {"team": "o_custkey % 3", "restart": "o_orderkey", "restart_task": "o_orderkey % 200"}
TASKS = {"team": "c_custkey % 3", "task": "c_custkey", "status": "CASE c_custkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'cancelled' END", "generation": "c_custkey % 7"}


@listing.add(f"WITH {_sql('restarts', RESTARTS, 'orders')}, {_sql('tasks', TASKS, 'customer')} SELECT r.team, restart, restart_task, t.status AS target_status, t.generation AS target_generation FROM restarts r LEFT JOIN tasks t ON r.team = t.team AND restart_task = task")
def restart_listing(spark, sf_dir):
    """Restarts with the tasks they made."""
    return workflow.restart_listing(_df(spark, sf_dir, RESTARTS, "orders"), _df(spark, sf_dir, TASKS, "customer"))


ARTIFACTS = {"artifact": "l_orderkey * 10 + l_linenumber", "team": "l_partkey % 3", "execution": "l_orderkey"}


@listing.add(f"WITH {_sql('artifacts', ARTIFACTS | {'kind': 'l_returnflag'}, 'lineitem')}, {_sql('executions', EXECUTIONS, 'orders')} SELECT artifact, kind, a.execution, task, status FROM artifacts a JOIN executions e ON a.team = e.team AND a.execution = e.execution")
def artifact_listing(spark, sf_dir):
    """Artifacts with the executions of their team that made them."""
    return workflow.artifact_listing(_df(spark, sf_dir, ARTIFACTS | {"kind": "l_returnflag"}, "lineitem"), _df(spark, sf_dir, EXECUTIONS, "orders")).select("artifact", "kind", "execution", "task", "status")


OUTBOX = {"kind": "CASE WHEN event_id % 2 = 0 THEN 'gate_decision' ELSE 'other' END", "status": "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_flight' ELSE 'delivered' END", "payload": "concat('{\"decision\": ', event_id, '}')"}
DECISIONS = {"decision": "event_id", "gate": "event_id % 700"}


@listing.add(f"WITH {_sql('decisions', DECISIONS, 'events')} SELECT DISTINCT gate FROM decisions WHERE decision IN (SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_type IN ('view', 'click'))")
def pending_decisions(spark, sf_dir):
    """Gates whose decision is still in the outbox, found by a field of its payload."""
    return workflow.pending_decisions(_df(spark, sf_dir, OUTBOX, "events"), _df(spark, sf_dir, DECISIONS, "events"))


@listing.add(f"WITH {_sql('tasks', TASKS, 'customer')} SELECT task, status, EXISTS (SELECT 1 FROM orders WHERE o_custkey = task AND o_orderstatus = 'F') AS publication_ready FROM tasks")
def publication_ready(spark, sf_dir):
    """Tasks and whether anything of theirs is published."""
    published = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("withdrawn").alias("status"))
    return workflow.with_publication(_df(spark, sf_dir, TASKS, "customer").select("task", "status"), published)


MEMBERSHIPS = {"snapshot": "l_orderkey", "ordinal": "l_linenumber", "item": "CASE WHEN l_partkey % 97 > 0 THEN l_partkey END", "revision": "l_suppkey", "decision": "CASE WHEN l_orderkey % 19 = 0 AND l_linenumber = 1 THEN 'rejected' ELSE 'accepted' END", "required": "l_quantity > 10"}
FACTS = {"snapshot": "l_orderkey", "ordinal": "l_linenumber", "item": "l_partkey", "revision": "CASE WHEN l_orderkey % 23 = 0 AND l_linenumber = 2 THEN l_suppkey + 1 ELSE l_suppkey END"}
FACT_ROWS = "l_quantity > 10 AND NOT (l_orderkey % 29 = 0 AND l_linenumber = 1)"


@listing.add(f"""WITH {_sql('m', MEMBERSHIPS, 'lineitem')}, {_sql('f', FACTS, 'lineitem', FACT_ROWS)}, e AS (SELECT snapshot, ordinal, item, revision, count(*) AS e FROM m WHERE required GROUP BY ALL), a AS (SELECT snapshot, ordinal, item, revision, count(*) AS a FROM f GROUP BY ALL),
b AS (SELECT coalesce(e.snapshot, a.snapshot) AS snapshot, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM e FULL JOIN a ON e.snapshot = a.snapshot AND e.ordinal IS NOT DISTINCT FROM a.ordinal AND e.item IS NOT DISTINCT FROM a.item AND e.revision IS NOT DISTINCT FROM a.revision),
x AS (SELECT DISTINCT snapshot FROM m WHERE required AND (decision <> 'accepted' OR item IS NULL OR revision IS NULL))
SELECT b.snapshot, sum(e)::BIGINT AS required, sum(a)::BIGINT AS facts, bool_and(e = 1 AND a = 1) AND bool_and(x.snapshot IS NULL) AS intact FROM b LEFT JOIN x ON b.snapshot = x.snapshot GROUP BY b.snapshot""")
def scatter_facts(spark, sf_dir):
    """Snapshots whose accepted facts are exactly their required members."""
    return workflow.scatter_facts(_df(spark, sf_dir, MEMBERSHIPS, "lineitem"), _df(spark, sf_dir, FACTS, "lineitem", FACT_ROWS))


REGISTRY = {"workflow": "s_suppkey", "key": "concat('w', s_suppkey % 40)", "active_revision": "s_suppkey % 3"}


@listing.add(f"""WITH {_sql('registry', REGISTRY, 'supplier')}, revisions AS (SELECT s_suppkey AS "of", n AS revision, concat('d', s_suppkey, '-', n) AS digest FROM supplier, (SELECT unnest([0, 1]) AS n)),
a AS (SELECT key, revision, digest FROM registry JOIN revisions ON workflow = "of" AND active_revision = revision), q AS (SELECT c_custkey AS request, concat('w', c_custkey % 50) AS key FROM customer),
f AS (SELECT request, q.key, count(revision) AS n, min(revision) AS revision, min(digest) AS digest FROM q LEFT JOIN a ON q.key = a.key GROUP BY ALL)
SELECT request, key, CASE WHEN n = 1 THEN revision END AS revision, CASE WHEN n = 1 THEN digest END AS digest, CASE WHEN n = 1 THEN 'resolved' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS state FROM f""")
def workflow_resolve(spark, sf_dir):
    """Requests with the one active revision of their workflow."""
    revisions = table(spark, sf_dir, "supplier", "s_suppkey").selectExpr("s_suppkey AS of", "explode(array(0, 1)) AS revision").selectExpr("*", "concat('d', of, '-', revision) AS digest")
    requests = table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS request", "concat('w', c_custkey % 50) AS key")
    return workflow.resolved(requests, _df(spark, sf_dir, REGISTRY, "supplier"), revisions)


NEW = {"key": "concat('w', o_custkey)", "revision": "o_orderkey % 6", "digest": "concat('d', o_orderkey % 2)", "compiled": "concat('c', o_orderkey % 4)"}
HELD = {"key": "concat('w', c_custkey)", "revision": "c_custkey % 6", "digest": "concat('d', c_custkey % 2)", "compiled": "concat('c', c_custkey % 4)"}


@listing.add(f"WITH {_sql('new', NEW, 'orders')}, {_sql('held', HELD, 'customer')} SELECT new.key, new.revision, CASE WHEN held.digest IS NULL THEN 'inserted' WHEN new.digest = held.digest AND new.compiled = held.compiled THEN 'verified' ELSE 'conflict' END AS state FROM new LEFT JOIN held ON new.key = held.key AND new.revision = held.revision")
def workflow_register(spark, sf_dir):
    """Registrations that add a revision, repeat one, or contradict it."""
    return workflow.registered(_df(spark, sf_dir, NEW, "orders"), _df(spark, sf_dir, HELD, "customer")).select("key", "revision", "state")


HEADS = "SELECT process, available_at, created_at FROM processes WHERE status = 'ready' AND pool {} 'embed' ORDER BY available_at, created_at, process LIMIT 1"


@listing.add(f"WITH {PROCESSES}, a AS ({HEADS.format('=')}), b AS ({HEADS.format('<>')}) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY available_at, created_at, process LIMIT 1")
def heads_merged(spark, sf_dir):
    """The earlier of the heads of the embedding queue and of the others."""
    p = processes(spark, sf_dir).where("status = 'ready'").select("process", "available_at", "created_at", "pool")
    return workflow.heads_merged(p.where("pool = 'embed'").drop("pool"), p.where("pool <> 'embed'").drop("pool"))


@listing.add(f"""WITH {_sql('e', EXECUTIONS, 'orders')}, p AS (SELECT event_id % 2000 AS execution, CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'failed' WHEN 'error' THEN 'running' ELSE 'cancelled' END AS status FROM events)
SELECT e.execution, root, coalesce(a.n, 0) AS active, coalesce(d.n, 0) AS descendants, coalesce(a.n, 0) = 0 AND (root <> e.execution OR coalesce(d.n, 0) = 0) AS converged
FROM e LEFT JOIN (SELECT execution, count(*) AS n FROM p WHERE status = 'running' GROUP BY 1) a ON e.execution = a.execution
LEFT JOIN (SELECT root AS execution, count(*) AS n FROM e WHERE root <> execution AND status NOT IN ('succeeded', 'failed', 'cancelled') GROUP BY 1) d ON e.execution = d.execution WHERE status = 'cancelling'""")
def cancellation_convergence(spark, sf_dir):
    """Cancelling executions and what they still wait for."""
    p = table(spark, sf_dir, "events", "event_id", "event_type").selectExpr("event_id % 2000 AS execution", "CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'failed' WHEN 'error' THEN 'running' ELSE 'cancelled' END AS status")
    return workflow.convergence(_df(spark, sf_dir, EXECUTIONS, "orders"), p)


EXPECTED = ("view", "click", "checkout")


@listing.add("SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS models, 'checkout,structured_generate' AS lacking, false AS ready")
def registry_readiness(spark, sf_dir):
    """What the registry lacks."""
    e = table(spark, sf_dir, "events", "event_type")
    models = table(spark, sf_dir, "supplier", "s_suppkey").select(F.when(F.col("s_suppkey") % 2 == 0, "active").otherwise("off").alias("status"))
    bindings = table(spark, sf_dir, "nation", "n_nationkey").select(F.element_at(F.array(F.lit("embed"), F.lit("text_generate"), F.lit("structured_generate")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("capability"), (F.col("n_nationkey") % 3 < 2).alias("enabled"))
    return workflow.readiness(e.select(F.col("event_type").alias("prompt")), models, bindings, list(EXPECTED))


@listing.add(f"WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity > 10 AS required, {CHILD} AS status FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN NOT required THEN 'skipped' WHEN status IN ('succeeded', 'failed') THEN status ELSE 'active' END AS outcome FROM m")
def member_outcomes(spark, sf_dir):
    """Labels of scatter members."""
    m = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return m.select("l_orderkey", "l_linenumber", workflow.member_outcome(F.col("l_quantity") > 10, F.expr(CHILD)).alias("outcome"))


#: Codes of failed attempts by the number in an event's properties: those that are tried again, near misses, and others.
CODES = (*workflow.RECOVERABLE, "inference_backpressure", "not-ready ", "NOT-READY", "OCR_MISSING", "", None)
CODE = "CASE CAST({k} AS INT) % " + str(len(CODES)) + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES) if c is not None) + " END"


@listing.add(f"""SELECT event_id, coalesce(code, 'none') AS code, CASE WHEN list_contains({list(workflow.RECOVERABLE)!r}, code) THEN 'retryable' ELSE 'failed' END AS class FROM (SELECT event_id, {CODE.format(k="json_extract_string(props, '$.k')")} AS code FROM events)""")
def retry_classes(spark, sf_dir):
    """Errors that are tried again and those that aren't: the code must be one of the list to the letter."""
    e = table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.expr(CODE.format(k="get_json_object(props, '$.k')")).alias("code"))
    return e.select("event_id", F.coalesce("code", F.lit("none")).alias("code"), workflow.retry_class(F.col("code")).alias("class"))


TEAM = {"team": "c_custkey", "status": "CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'deleted' END", "action": "CASE c_custkey % 4 WHEN 0 THEN 'deactivate' WHEN 1 THEN 'activate' WHEN 2 THEN 'delete' ELSE 'restore' END", "row_revision": "c_custkey % 5", "expected_revision": "c_custkey % 7 % 5"}


@listing.add(f"""WITH {_sql('t', TEAM, 'customer')}, n AS (SELECT *, CASE WHEN status = 'active' AND action = 'deactivate' THEN 'inactive' WHEN status = 'inactive' AND action = 'activate' THEN 'active' WHEN status IN ('active', 'inactive') AND action = 'delete' THEN 'deleted' WHEN status = 'deleted' AND action = 'restore' THEN 'inactive' END AS x FROM t)
SELECT team, CASE WHEN row_revision <> expected_revision THEN 'stale' WHEN x IS NULL THEN 'invalid' ELSE 'moved' END AS state, CASE WHEN row_revision = expected_revision THEN x END AS next FROM n""")
def team_transitions(spark, sf_dir):
    """What actions make of teams."""
    return workflow.moved(_df(spark, sf_dir, TEAM, "customer"), workflow.TEAM_MOVES).select("team", "state", "next")


SETS = {"candidate": "o_orderkey", "producer": "o_custkey", "status": "CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'sealed' WHEN 2 THEN 'accepted' ELSE 'abandoned' END", "action": "CASE o_orderkey % 3 WHEN 0 THEN 'seal' WHEN 1 THEN 'accept' ELSE 'abandon' END", "row_revision": "0", "expected_revision": "o_orderkey % 5 % 2"}


@listing.add(f"""WITH {_sql('t', SETS, 'orders')}, n AS (SELECT *, CASE WHEN status = 'open' AND action = 'seal' THEN 'sealed' WHEN status = 'sealed' AND action = 'accept' THEN 'accepted' WHEN status IN ('open', 'sealed') AND action = 'abandon' THEN 'abandoned' END AS x FROM t)
SELECT candidate, CASE WHEN row_revision <> expected_revision THEN 'stale' WHEN x IS NULL THEN 'invalid' ELSE 'moved' END AS state, CASE WHEN row_revision = expected_revision THEN x END AS next FROM n""")
def candidate_transitions(spark, sf_dir):
    """What actions make of candidate sets."""
    return workflow.moved(_df(spark, sf_dir, SETS, "orders"), workflow.CANDIDATE_MOVES).select("candidate", "state", "next")


@listing.add(f"WITH {_sql('t', SETS, 'orders')} SELECT producer, count(*) AS n, min(candidate) AS first FROM t WHERE status <> 'abandoned' GROUP BY producer HAVING count(*) > 1")
def candidate_conflicts(spark, sf_dir):
    """Producers with more than one candidate set."""
    return workflow.single_candidates(_df(spark, sf_dir, SETS, "orders"))


RETRY = {"task": "o_custkey", "fingerprint": "o_orderkey % 11"}
MADE = {"task": "c_custkey", "fingerprint": "c_custkey % 11", "restart": "c_custkey * 2"}


@listing.add(f"""WITH {_sql('q', RETRY, 'orders')}, {_sql('t', TASKS, 'customer', 'c_custkey % 10 > 0')}, {_sql('k', MADE, 'customer')},
s AS (SELECT q.task, q.fingerprint, t.generation, CASE WHEN restart IS NOT NULL THEN 'replay' WHEN status IS NULL THEN 'missing' WHEN status = 'succeeded' THEN 'succeeded' WHEN status = 'running' THEN 'active' ELSE 'restarted' END AS state FROM q LEFT JOIN t ON q.task = t.task LEFT JOIN k ON q.task = k.task AND q.fingerprint = k.fingerprint)
SELECT task, fingerprint, state, CASE WHEN state = 'restarted' THEN generation + 1 END AS generation FROM s""")
def task_retry(spark, sf_dir):
    """Retries that replay, refuse or start a new generation."""
    return workflow.retried(_df(spark, sf_dir, RETRY, "orders"), _df(spark, sf_dir, TASKS, "customer", "c_custkey % 10 > 0"), _df(spark, sf_dir, MADE, "customer"))


@listing.add(f"""WITH {_sql('e', EXECUTIONS, 'orders', 'o_orderkey % 6 > 0')}, s AS (SELECT DISTINCT l_partkey AS snapshot, min(l_orderkey) AS execution FROM lineitem GROUP BY 1), r AS (SELECT p_partkey AS rebuild, p_partkey AS snapshot FROM part)
SELECT rebuild, r.snapshot, task, generation, CASE WHEN s.execution IS NULL THEN 'no_producer' WHEN task IS NULL THEN 'no_task' ELSE 'linked' END AS state FROM r LEFT JOIN s ON r.snapshot = s.snapshot LEFT JOIN e ON s.execution = e.execution""")
def rebuild_sources(spark, sf_dir):
    """Rebuilds with the tasks that once made their targets."""
    snapshots = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey").groupBy(F.col("l_partkey").alias("snapshot")).agg(F.min("l_orderkey").alias("execution"))
    rebuilds = table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("rebuild"), F.col("p_partkey").alias("snapshot"))
    return workflow.rebuild_sources(rebuilds, snapshots, _df(spark, sf_dir, EXECUTIONS, "orders", "o_orderkey % 6 > 0"))


STEPS = {"execution": "o_orderkey", "step": "CASE o_orderkey % 3 WHEN 0 THEN 'human_gate' WHEN 1 THEN 'scatter_join' ELSE 'other' END", "mode": "CASE WHEN o_orderkey % 2 = 0 THEN 'any' ELSE 'all' END", "admission": "CASE WHEN o_orderkey % 5 = 0 THEN 'auto' ELSE 'human_review' END", "evidence": "o_orderkey % 7 > 0"}
CHILDREN = {"execution": "l_orderkey", "required": "l_quantity > 10", "status": CHILD}


@listing.add(f"""WITH {_sql('s', STEPS, 'orders')}, {_sql('g', GATES, 'events')}, {_sql('c', CHILDREN, 'lineitem')}, o AS (SELECT DISTINCT execution FROM g WHERE status = 'open'),
j AS (SELECT execution, bool_and(status IN ('succeeded', 'failed')) AS every, bool_or(status = 'succeeded') AS anyone FROM c WHERE required GROUP BY 1)
SELECT s.execution, step, CASE step WHEN 'human_gate' THEN CASE WHEN o.execution IS NOT NULL THEN 'conflict' WHEN admission = 'human_review' AND evidence THEN 'opened' ELSE 'refused' END
  WHEN 'scatter_join' THEN CASE WHEN coalesce(CASE WHEN mode = 'any' THEN anyone ELSE every END, false) THEN 'joined' ELSE 'waiting' END ELSE 'error' END AS state
FROM s LEFT JOIN o ON s.execution = o.execution LEFT JOIN j ON s.execution = j.execution""")
def control_entries(spark, sf_dir):
    """What control steps do: open a gate, join, or fail."""
    return workflow.control_entries(_df(spark, sf_dir, STEPS, "orders"), _df(spark, sf_dir, GATES, "events"), _df(spark, sf_dir, CHILDREN, "lineitem"))


FALLBACK = {"clean": "p1", "summarizer": "p2"}
CATALOGUE = {"prompt": "concat('p', p_partkey % 20)", "version": "concat(p_size % 3, '.', p_partkey)", "role": "CASE p_partkey % 20 % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'clean' WHEN 2 THEN 'summarizer' ELSE 'markdown' END", "status": "CASE WHEN p_partkey % 6 > 0 THEN 'active' ELSE 'retired' END"}


@listing.add(f"""WITH {_sql('c', CATALOGUE, 'part')}, q AS (SELECT c_custkey AS request, role, c_nationkey AS domain, CASE WHEN c_custkey % 5 = 0 THEN concat('p', c_custkey % 25) END AS explicit FROM customer, (SELECT unnest(['clean', 'json', 'summarizer']) AS role)),
d AS (SELECT n_nationkey AS domain, 'json' AS role, concat('p', n_nationkey % 20) AS prompt FROM nation WHERE n_nationkey % 2 = 0),
w AS (SELECT request, q.role, coalesce(explicit, d.prompt, CASE q.role WHEN 'clean' THEN 'p1' WHEN 'summarizer' THEN 'p2' END) AS prompt FROM q LEFT JOIN d ON q.domain = d.domain AND q.role = d.role),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY list_transform(string_split(version, '.'), lambda x: x::INTEGER) DESC) AS k FROM c WHERE status = 'active') WHERE k = 1),
s AS (SELECT request, w.role, w.prompt, version, CASE WHEN w.prompt IS NULL THEN 'none' WHEN version IS NULL THEN 'not_registered' WHEN n.role <> w.role THEN 'role_mismatch' ELSE 'selected' END AS state FROM w LEFT JOIN n ON w.prompt = n.prompt)
SELECT request, role, prompt, CASE WHEN state = 'selected' THEN version END AS version, state FROM s""")
def prompt_selection(spark, sf_dir):
    """The prompt of each role: explicit, else the domain's, else the global default."""
    q = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").selectExpr("c_custkey AS request", "explode(array('clean', 'json', 'summarizer')) AS role", "c_nationkey AS domain", "CASE WHEN c_custkey % 5 = 0 THEN concat('p', c_custkey % 25) END AS explicit")
    d = table(spark, sf_dir, "nation", "n_nationkey").where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS domain", "'json' AS role", "concat('p', n_nationkey % 20) AS prompt")
    return workflow.prompts_selected(q, d, _df(spark, sf_dir, CATALOGUE, "part"), FALLBACK)


LEASES = {"process": "event_id % 3000", "fencing": "event_id", "ended": "CASE WHEN event_type = 'error' THEN concat('d', event_id % 2) END"}
OUTCOMES = {"process": "event_id % 3100", "fencing": "event_id + 6000 * (event_id % 2)", "digest": "concat('d', event_id % 3 % 2)"}


@listing.add(f"""WITH {_sql('l', LEASES, 'events')}, {_sql('o', OUTCOMES, 'events')}, n AS (SELECT process, max(fencing) AS now, (SELECT ended FROM l k WHERE k.process = l.process ORDER BY fencing DESC LIMIT 1) AS ended FROM l GROUP BY process)
SELECT o.process, fencing, digest, CASE WHEN now IS NULL THEN 'missing' WHEN fencing < now THEN 'stale' WHEN ended IS NULL THEN 'accepted' WHEN ended = digest THEN 'replay' ELSE 'conflict' END AS state FROM o LEFT JOIN n ON o.process = n.process""")
def outcome_acceptance(spark, sf_dir):
    """Outcomes of workers against the newest lease: late ones are stale, repeated ones replay or conflict."""
    return workflow.fenced_outcomes(_df(spark, sf_dir, OUTCOMES, "events"), _df(spark, sf_dir, LEASES, "events"))


DECLARED = {"execution": "l_orderkey", "step": "concat('s', l_linenumber)"}
PERSISTED = {"execution": "l_orderkey", "step": "concat('s', CASE WHEN l_partkey % 31 = 0 THEN l_linenumber + 10 ELSE l_linenumber END)"}


@listing.add(f"WITH {_sql('d', DECLARED, 'lineitem')}, {_sql('p', PERSISTED, 'lineitem', 'l_partkey % 37 > 0')} SELECT *, 'declared' AS side FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM p) UNION ALL SELECT *, 'persisted' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM d)")
def steps_match(spark, sf_dir):
    """Steps that were declared or persisted only."""
    return workflow.steps_match(_df(spark, sf_dir, DECLARED, "lineitem"), _df(spark, sf_dir, PERSISTED, "lineitem", "l_partkey % 37 > 0"))


@listing.add("""WITH t AS (SELECT doc_id, 1 AS a, len(string_split(text, chr(10) || chr(10))) AS b, len(string_split(text, chr(10))) - CASE WHEN starts_with(text, 'T') THEN 1000000 ELSE 0 END AS c, regexp_matches(text, '[#$%&]') AS odd FROM documents)
SELECT doc_id, c >= 0 AND NOT odd AS valid, sha256('0=1;1=' || b || ';' || CASE WHEN odd THEN 'x' ELSE '2' END || '=' || c) AS digest FROM t""")
def layer_counts(spark, sf_dir):
    """Blocks of each layer of every text, whether the counts are well formed, and the digest of their sorted entries; texts with odd marks name a layer that isn't a number, others have a count below zero."""
    size = lambda by: F.size(F.split("text", by, -1)).cast("long")
    last = F.when(F.regexp_like("text", F.lit("[#$%&]")), "x").otherwise("2")
    m = F.create_map(F.lit("0"), F.lit(1).cast("long"), F.lit("1"), size("\n\n"), last, size("\n") - F.when(F.startswith("text", F.lit("T")), 1_000_000).otherwise(0))
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", workflow.layer_counts_valid(m).alias("valid"), F.sha2(F.array_join(entries, ";"), 256).alias("digest"))


@listing.add("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(ts - CASE event_id % 4 WHEN 1 THEN INTERVAL 120 MINUTE WHEN 2 THEN INTERVAL (-330) MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%S.%fZ') END AS utc FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def rfc3339(spark, sf_dir):
    """Timestamps of several zones in UTC; without a zone they aren't valid."""
    zone = F.when(F.col("event_id") % 4 == 0, "Z").when(F.col("event_id") % 4 == 1, "+02:00").when(F.col("event_id") % 4 == 2, "-05:30").otherwise("")
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", workflow.rfc3339(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)).alias("utc"))


@listing.add("""SELECT doc_id, sha256(token) AS fingerprint, ip AS address, CASE WHEN ip <> '' THEN sha256(ip) END AS address_fingerprint FROM (SELECT doc_id, regexp_extract(text, 'token = "([0-9a-f]+)"', 1) AS token, regexp_extract(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}') AS ip FROM documents) WHERE token <> '' OR ip <> ''""".replace("sha256(token) AS", "CASE WHEN token <> '' THEN sha256(token) END AS").replace(" ip AS address,", ""))
def token_fingerprint(spark, sf_dir):
    """Fingerprints that stand for the tokens and addresses that texts hold; what a text lacks has none."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    token, ip = F.regexp_extract("text", 'token = "([0-9a-f]+)"', 1), F.regexp_extract("text", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 0)
    out = d.select("doc_id", workflow.fingerprint(token).alias("fingerprint"), workflow.fingerprint(ip).alias("address_fingerprint"))
    return out.where("fingerprint is not null or address_fingerprint is not null")


@listing.add(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path, substr(regexp_extract(url, '^https?://[^/]+(.*)$', 1), 2) AS below, sha256(html) AS h FROM pages),
x AS (SELECT page_id, CASE WHEN contains(path, '?') THEN path WHEN contains(path, '#') THEN replace(below, '#', '/../') ELSE below END AS path, CASE WHEN path LIKE '%.html' THEN upper(h) WHEN path LIKE '%/' THEN substr(h, 1, 63) ELSE h END AS digest FROM p)
SELECT page_id, regexp_full_match(digest, '[0-9a-f]{64}') AS digest_ok, path <> '' AND substr(path, 1, 1) <> '/' AND NOT list_contains(string_split(path, '/'), '..') AS path_ok FROM x""")
def pattern_checks(spark, sf_dir):
    """Digests of pages and paths of their URLs by their patterns: absolute ones, and ones with a step to a parent, aren't relative paths."""
    path = F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)
    p = table(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", path.alias("p"), F.substring(path, 2, 1 << 20).alias("below"), F.sha2("html", 256).alias("h"))
    made = F.when(F.contains("p", F.lit("?")), F.col("p")).when(F.contains("p", F.lit("#")), F.replace("below", F.lit("#"), F.lit("/../"))).otherwise(F.col("below"))
    digest = F.when(F.endswith("p", F.lit(".html")), F.upper("h")).when(F.endswith("p", F.lit("/")), F.substring("h", 1, 63)).otherwise(F.col("h"))
    return workflow.pattern_checks(p.select("page_id", made.alias("path"), digest.alias("digest"))).select("page_id", "digest_ok", "path_ok")


@listing.add("SELECT event_id, date_diff('minute', ts, m) < CASE event_id % 3 WHEN 0 THEN 1440 WHEN 1 THEN 60 ELSE 1 END AS kept FROM events, (SELECT max(ts) AS m FROM events)")
def cleanup_grace(spark, sf_dir):
    """What is too young to be cleaned up, by kind."""
    e = table(spark, sf_dir, "events", "event_id", "ts")
    kind = F.when(F.col("event_id") % 3 == 0, "object").when(F.col("event_id") % 3 == 1, "generation").otherwise("cleanup")
    minutes = F.timestamp_diff("MINUTE", F.date_trunc("minute", "ts"), F.date_trunc("minute", "m"))
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("m")))).select("event_id", workflow.within_grace(minutes, kind).alias("kept"))  # one row


#: Handlers by dotted prefix; keys are the labels of a page's host from the top, then the first step of its path.
HANDLERS = {"com": "shop", "com.example": "sample", "com.example.blog": "never", "net.example": "sample_net", "org": "public", "com.example.therin": "therin", "net.example.thther": "thther"}
HOST = r"^https?://([^/:?#]+)[^/]*/?([a-z]*)"


@listing.add(rf"""WITH h AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in HANDLERS.items())}) t(prefix, handler)),
k AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '{HOST}', 1), '.')), '.') || '.' || regexp_extract(url, '{HOST}', 2) AS key FROM pages)
SELECT page_id, arg_max(handler, length(prefix)) AS handler FROM k LEFT JOIN h ON starts_with(key || '.', prefix || '.') GROUP BY page_id""")
def handler_registry(spark, sf_dir):
    """Handlers of pages by the longest registered prefix of their host, read from the top, and path."""
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", HOST, 1), "[.]")), ".")
    p = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.concat(host, F.lit("."), F.regexp_extract("url", HOST, 2)).alias("key"))
    return workflow.handler_for(p, "key", HANDLERS).select("page_id", "handler")


@listing.add("SELECT event_id, ts, event_type, '/srv/' || event_id AS raw, '[REDACTED_PATH] Bearer [REDACTED]' AS summary FROM events WHERE user_id % 3 = 1 ORDER BY ts DESC, event_id DESC LIMIT 51")
def audit_page(spark, sf_dir):
    """A page of one team's audit events, newest first, redacted."""
    from lamella.functions.text import secret_redacted

    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "user_id").where("user_id % 3 = 1").drop("user_id")
    page = ledger.keyset_page(e, "ts", "event_id", 50)
    raw = F.concat(F.lit("/srv/"), "event_id")
    return page.select("event_id", "ts", "event_type", raw.alias("raw"), secret_redacted(F.concat(raw, F.lit(" bearer xyz"))).alias("summary"))


@listing.add("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey % 4 = 1 AND (o_orderdate < DATE '1997-01-01' OR (o_orderdate = DATE '1997-01-01' AND o_orderkey < 100)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def generation_page(spark, sf_dir):
    """A page of generations, newest first, behind a cursor."""
    import datetime

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").where("o_custkey % 4 = 1")
    return ledger.keyset_page(o, "o_orderdate", "o_orderkey", 20, (datetime.date(1997, 1, 1), 100))


@listing.add("""WITH seen AS (SELECT user_id AS team, max(event_id) AS last, count(*) AS n FROM events GROUP BY user_id), held AS (SELECT o_custkey AS team, max(o_orderkey) AS mark FROM orders GROUP BY o_custkey)
SELECT coalesce(s.team, h.team) AS team, greatest(coalesce(mark, 0), coalesce(last, 0)) AS high_water, coalesce(last, 0) > coalesce(mark, 0) AS advanced FROM seen s FULL JOIN held h ON s.team = h.team""")
def high_water(spark, sf_dir):
    """Each team's mark of the highest sequence number seen, which only moves up: the stored one, or that of a later event."""
    seen = table(spark, sf_dir, "events", "user_id", "event_id").select(F.col("user_id").alias("team"), F.col("event_id").alias("sequence"))
    held = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").groupBy(F.col("o_custkey").alias("team")).agg(F.max("o_orderkey").alias("mark"))
    return workflow.advanced(held, seen)
