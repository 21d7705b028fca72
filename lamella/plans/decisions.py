"""Queries of decisions: routes with fan-out, gate actions, members of a generation, registrations, bindings, purges, retrieval requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import json_text
from lamella.operators import decisions
from lamella.plans.base import Listing
from lamella.sources import ledgers
from lamella.sources.tables import table

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def _pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else repr(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names}))"


GUARDS = [("auto", "registered_admission_result", "eq", "auto"), ("human", "registered_admission_result", "eq", "human"), ("rebuild", "registered_request_intent", "eq", "rebuild"), ("ingest", "registered_request_intent", "eq", "ingest"), ("above", "registered_request_intent", "gt", "a"), ("free", "free_text", "eq", "a")]
ROUTES = [
    ("URGENT", "succeeded", "index", 1, "fan_out", "auto"), ("URGENT", "succeeded", "notify", 1, "fan_out", "rebuild"), ("URGENT", "succeeded", "store", 2, "normal", "ingest"), ("URGENT", "succeeded", "close", 9, "terminal", None),
    ("HIGH", "succeeded", "fast", 1, "normal", "auto"), ("HIGH", "succeeded", "lost", 2, "branch", "unknown"), ("MEDIUM", "succeeded", "all", 1, "fan_out", None), ("MEDIUM", "succeeded", "odd", 2, "normal", "above"),
    ("LOW", "failed", "copy", 3, "fan_out", None), ("LOW", "failed", "ask", 2, "fan_out", "human"), ("LOW", "failed", "stop", 4, "terminal", "rebuild"), ("LOW", "failed", "never", 5, "normal", None), ("LOW", "succeeded", "any", 1, "normal", "free"),
]
FACT = {"execution": "o_orderkey", "step": "substr(o_orderpriority, 3)", "outcome": "CASE o_orderstatus WHEN 'F' THEN 'succeeded' ELSE 'failed' END"}
KNOWN = {"admission_result": "CASE WHEN floor(o_totalprice) % 5 < 2 THEN 'auto' WHEN floor(o_totalprice) % 5 < 4 THEN 'human' END", "request_intent": "CASE WHEN o_custkey % 3 = 0 THEN 'rebuild' WHEN o_custkey % 3 = 1 THEN 'ingest' END"}
NAMES = "step, outcome, route, priority, kind, guard", "guard, predicate, op, expected"


@listing.add(f"""WITH routes AS {_values(ROUTES, NAMES[0])}, guards AS {_values(GUARDS, NAMES[1])}, facts AS (SELECT {_listed(FACT | KNOWN)} FROM orders),
tried AS (SELECT f.execution, f.step, f.outcome, r.route, r.kind, r.guard, row_number() OVER (PARTITION BY f.execution ORDER BY priority, r.route) AS n,
  CASE WHEN r.guard IS NULL THEN 'match' WHEN g.guard IS NULL THEN 'guard_missing' WHEN op <> 'eq' OR predicate = 'free_text' THEN 'guard_unsupported'
    WHEN coalesce(CASE predicate WHEN 'registered_admission_result' THEN admission_result ELSE request_intent END = expected, false) THEN 'match' ELSE 'miss' END AS verdict
  FROM facts f JOIN routes r ON f.step = r.step AND f.outcome = r.outcome LEFT JOIN guards g ON r.guard = g.guard),
seen AS (SELECT * FROM tried t WHERE NOT EXISTS (SELECT 1 FROM tried b WHERE b.execution = t.execution AND b.n < t.n AND (b.verdict LIKE 'guard%' OR (b.verdict = 'match' AND b.kind <> 'fan_out')))),
summed AS (SELECT execution, max(verdict) FILTER (WHERE verdict LIKE 'guard%') AS error, coalesce(list(route ORDER BY n) FILTER (WHERE verdict = 'match'), []) AS taken,
  coalesce(string_agg(DISTINCT '"' || guard || '":' || (verdict = 'match')::VARCHAR, ',' ORDER BY '"' || guard || '":' || (verdict = 'match')::VARCHAR) FILTER (WHERE guard IS NOT NULL), '') AS asked FROM seen GROUP BY execution)
SELECT f.execution, f.step, f.outcome, CASE WHEN error IS NULL THEN coalesce(array_to_string(taken, ','), '') ELSE '' END AS routes, CASE WHEN error IS NULL THEN '{{' || coalesce(asked, '') || '}}' END AS guard_results,
  CASE WHEN error IS NULL THEN sha256('{{"execution_uuid":"' || f.execution || '","guard_results":{{' || coalesce(asked, '') || '}},"outcome_selector":"' || f.outcome || '","routes":[' || coalesce(array_to_string(list_transform(taken, lambda x: '"' || x || '"'), ','), '') || '],"source_step_key":"' || f.step || '"}}') END AS digest,
  CASE WHEN error IS NOT NULL THEN error WHEN coalesce(len(taken), 0) = 0 THEN 'no_route' ELSE 'routed' END AS state
FROM facts f LEFT JOIN summed s ON f.execution = s.execution""")
def route_decisions(spark, sf_dir):
    """The routes that each outcome takes: all that fan out until one that doesn't, as their guards find the facts."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    known = F.map_filter(F.create_map(*[x for k, v in KNOWN.items() for x in (F.lit(k), F.expr(v))]), lambda k, v: v.isNotNull())
    facts = o.select(*[F.expr(v).alias(k) for k, v in FACT.items()], known.alias("known"))
    routes = spark.createDataFrame(ROUTES, "step string, outcome string, route string, priority int, kind string, guard string")
    guards = spark.createDataFrame(GUARDS, "guard string, predicate string, operator string, expected string")
    return decisions.routed(facts, routes, guards).withColumn("routes", F.array_join("routes", ",")).drop("known")


REQUEST = {
    "request": "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS STRING))", "gate": "CASE WHEN l_quantity = 50 THEN -1 - l_orderkey ELSE l_orderkey END", "revision": "CASE WHEN l_tax > 0.07 THEN 2 ELSE 1 END", "at": "l_shipdate", "actor": "CASE WHEN l_tax = 0 THEN '' ELSE 'a' END",
    "action": "CASE WHEN l_returnflag = 'A' THEN 'approve' WHEN l_returnflag = 'N' THEN 'reject' WHEN l_discount < 0.03 THEN 'postpone' WHEN l_discount < 0.06 THEN 'reclean' ELSE 'approve' END", "key": "concat('k', CAST(l_quantity AS BIGINT) % 3)",
}
HELD = {"gate": "o_orderkey", "status": "CASE WHEN o_orderstatus = 'P' THEN 'released' ELSE 'open' END", "revision": "1", "execution": "o_orderkey"}
REVIEW = {
    "gate": "o_orderkey", "target_digest": "concat('t', o_custkey)",
    "review": "CASE WHEN floor(o_totalprice) % 10 < 7 THEN '{\"allowed_actions\":[\"approve\",\"reject\",\"reclean\"]}' WHEN floor(o_totalprice) % 10 = 7 THEN '{\"allowed_actions\":[\"reject\"]}' WHEN floor(o_totalprice) % 10 = 8 THEN '{\"allowed_actions\":[\"reject\",\"reject\"]}' ELSE '[' END",
}
WAITING = {"execution": "o_orderkey", "status": "CASE WHEN o_orderpriority LIKE '5%' THEN 'running' ELSE 'waiting' END", "waiting_ref": "o_orderkey"}
MADE = {"gate": "l_orderkey", "key": "concat('k', CAST(l_quantity AS BIGINT) % 3)"}


@listing.add(f"""WITH RECURSIVE requests AS (SELECT {_listed(REQUEST)} FROM lineitem), gates AS (SELECT {_listed(HELD)} FROM orders), targets AS (SELECT {_listed(REVIEW)} FROM orders WHERE floor(o_totalprice) % 13 <> 0), executions AS (SELECT {_listed(WAITING)} FROM orders),
made AS (SELECT DISTINCT {_listed(MADE)} FROM lineitem WHERE l_linenumber = 6),
r AS (SELECT q.*, row_number() OVER (PARTITION BY q.gate ORDER BY q.at, q.request) AS n, g.status, g.revision AS now, t.target_digest, t.review, t.gate IS NOT NULL AS targeted, x.status AS running, x.waiting_ref, m.key IS NOT NULL AS recorded
  FROM requests q LEFT JOIN gates g ON q.gate = g.gate LEFT JOIN targets t ON q.gate = t.gate LEFT JOIN executions x ON g.execution = x.execution LEFT JOIN made m ON q.gate = m.gate AND q.key = m.key),
v AS (SELECT *, CASE WHEN action = 'postpone' THEN 'gate-action-invalid' WHEN actor = '' THEN 'gate-decision-invalid' WHEN status IS NULL THEN 'gate-not-found' WHEN recorded THEN 'repeated' END AS early,
  CASE WHEN NOT targeted THEN 'gate-target-missing' WHEN review IN ('[', '{{"allowed_actions":["reject","reject"]}}') THEN 'gate-target-invalid' WHEN NOT contains(review, '"' || action || '"') THEN 'gate-action-not-allowed'
    WHEN running <> 'waiting' THEN 'gate-execution-conflict' WHEN action = 'reclean' THEN 'gate-action-route-unavailable' ELSE 'accepted' END AS late FROM r),
s AS (
  SELECT gate, 0 AS n, NULL::VARCHAR AS request, NULL::VARCHAR AS state, NULL::VARCHAR AS decided FROM (SELECT DISTINCT gate FROM v)
  UNION ALL
  SELECT v.gate, v.n::INT, v.request, CASE WHEN early IS NOT NULL THEN early WHEN v.key = s.decided THEN 'repeated' WHEN s.decided IS NOT NULL OR v.status <> 'open' OR v.revision <> v.now THEN 'gate-revision-conflict' ELSE late END AS state,
    CASE WHEN early IS NULL AND s.decided IS NULL AND v.status = 'open' AND v.revision = v.now AND late = 'accepted' THEN v.key ELSE s.decided END FROM s JOIN v ON v.gate = s.gate AND v.n = s.n + 1
)
SELECT v.request, v.gate, s.state, CASE WHEN s.state = 'accepted' THEN CASE action WHEN 'reject' THEN 'rejected' ELSE 'released' END END AS gate_status, CASE WHEN s.state = 'accepted' THEN v.revision + 1 END AS gate_revision, CASE WHEN s.state = 'accepted' THEN target_digest END AS target_digest,
  CASE WHEN s.state = 'accepted' THEN sha256('{{"action":"' || action || '","gate_revision":' || v.revision || ',"gate_uuid":"' || v.gate || '","idempotency_key":"' || v.key || '"}}') END AS decision_digest
FROM v JOIN s ON v.request = s.request""")
def gate_actions(spark, sf_dir):
    """What becomes of each request to decide a gate: one decides it, its repetitions change nothing, others conflict."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    targets = _pick(o.where("floor(o_totalprice) % 13 <> 0"), REVIEW)
    return decisions.gate_actions(_pick(l, REQUEST), _pick(o, HELD), targets, _pick(o, WAITING), _pick(l.where("l_linenumber = 6"), MADE))


#: Handoffs stand for documents; a document's number ``d`` names the one field in which its first member deviates.
HANDOFF = {"team": "1 + doc_id % 2", "execution": "doc_id", "task": "doc_id * 3"}
RECEIPT = {"team": "team", "execution": "execution", "member": "member", "artifact": "execution * 10 + m", "handle": "CASE WHEN d = 1 AND m = 1 THEN '' ELSE concat('generation/', execution, '/', member) END", "digest": "digest", "size": "CASE WHEN d = 2 AND m = 1 THEN -1 ELSE size END"}
ARTIFACT = {
    "team": "team", "member": "member", "artifact": "execution * 10 + m", "handle": "CASE WHEN d = 3 AND m = 1 THEN 'moved' ELSE concat('generation/', execution, '/', member) END", "digest": "CASE WHEN d = 4 AND m = 1 THEN 'other' ELSE digest END",
    "size": "CASE WHEN d = 5 AND m = 1 THEN size + 1 ELSE size END", "validation": "CASE WHEN d = 6 AND m = 1 THEN 'partial' ELSE 'full_valid' END", "execution": "CASE WHEN d = 7 AND m = 1 THEN -1 ELSE execution END", "task": "CASE WHEN d = 8 AND m = 1 THEN -1 ELSE execution * 3 END",
}
CURRENT = {"team": "team", "execution": "execution", "member": "member", "artifact": "execution * 10 + CASE WHEN d = 9 AND m = 1 THEN 9 ELSE m END"}
SPREAD = "SELECT 1 + doc_id % 2 AS team, doc_id AS execution, member, m, {digest} AS digest, {size} AS size, n_chars % 16 AS d FROM"
HOLES = {"receipts": "NOT (d = 10 AND m = 2)", "artifacts": "NOT (d = 11 AND m = 3)", "pointers": "NOT (d = 12 AND m = 4)"}


@listing.add(f"""WITH spread AS ({SPREAD.format(digest="sha256(member || ':' || coalesce(text, ''))", size="strlen(coalesce(text, '')) + m")} documents, (SELECT unnest([{", ".join(f"'{m}'" for m in ledgers.MEMBERS)}]) AS member, unnest(range(1, {len(ledgers.MEMBERS) + 1})) AS m)),
h AS (SELECT {_listed(HANDOFF)} FROM documents), r AS (SELECT {_listed(RECEIPT)}, m FROM spread WHERE {HOLES["receipts"]}), a AS (SELECT {_listed(ARTIFACT)} FROM spread WHERE {HOLES["artifacts"]}), p AS (SELECT {_listed(CURRENT)} FROM spread WHERE {HOLES["pointers"]}),
j AS (SELECT h.team, h.execution, h.task, w.member, CASE WHEN r.artifact IS NULL OR r.handle = '' OR r.size < 0 THEN 'receipt_invalid' WHEN a.artifact IS NULL THEN 'artifact_missing' WHEN a.handle <> r.handle THEN 'handle' WHEN a.digest <> r.digest THEN 'digest' WHEN a.size <> r.size THEN 'size'
  WHEN a.validation <> 'full_valid' THEN 'validation' WHEN a.execution <> h.execution OR a.task <> h.task THEN 'owner' WHEN p.artifact IS NULL OR p.artifact <> r.artifact THEN 'not_current' END AS reason
  FROM h CROSS JOIN (SELECT unnest([{", ".join(f"'{m}'" for m in ledgers.MEMBERS)}]) AS member) w LEFT JOIN r ON r.team = h.team AND r.execution = h.execution AND r.member = w.member
  LEFT JOIN a ON a.team = h.team AND a.member = w.member AND a.artifact = r.artifact LEFT JOIN p ON p.team = h.team AND p.execution = h.execution AND p.member = w.member)
SELECT team, execution, task, count(*) FILTER (WHERE reason IS NULL) AS matched, coalesce(string_agg(member || '=' || reason, ',' ORDER BY member || '=' || reason) FILTER (WHERE reason IS NOT NULL), '') AS failures, count(reason) = 0 AS admitted FROM j GROUP BY ALL""")
def generation_members(spark, sf_dir):
    """Handoffs whose six members all are what the ledger holds, whole, their own and current; else what is wrong with which."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    names = F.posexplode(F.array(*map(F.lit, ledgers.MEMBERS)))
    held = d.select("doc_id", "text", "n_chars", names.alias("p", "member")).withColumn("m", F.col("p") + 1)
    spread = held.selectExpr("1 + doc_id % 2 AS team", "doc_id AS execution", "member", "m", "sha2(concat(member, ':', coalesce(text, '')), 256) AS digest", "octet_length(coalesce(text, '')) + m AS size", "n_chars % 16 AS d")
    sides = [_pick(spread.where(HOLES[k]), c) for k, c in (("receipts", RECEIPT), ("artifacts", ARTIFACT), ("pointers", CURRENT))]
    return decisions.generation_members(_pick(d, HANDOFF), *sides, ledgers.MEMBERS)


NEW = {
    "seq": "event_id", "key": "concat('w', user_id)", "revision": "CAST(floor(value) AS BIGINT) % 4", "fingerprint": "concat('f', CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)", "compiled": "concat('c', CASE WHEN value > 150 THEN 1 ELSE 0 END)",
    "domain": "CASE WHEN value > 170 AND event_type = 'view' THEN 'other' ELSE 'main' END", "purpose": "'intake'", "role": "'root'",
}
REGISTRY = {"key": "concat('w', c_custkey)", "domain": "CASE WHEN c_custkey % 9 = 0 THEN 'other' ELSE 'main' END", "purpose": "'intake'", "role": "'root'", "active": "c_nationkey % 4"}
REVISION = {"key": "concat('w', c_custkey)", "revision": "c_nationkey % 4", "fingerprint": "'f0'", "compiled": "concat('c', c_nationkey % 2)"}
REGISTERED = f"""new AS (SELECT {_listed(NEW)} FROM events), registry AS (SELECT {_listed(REGISTRY)} FROM customer WHERE c_custkey % 2 = 0), revisions AS (SELECT {_listed(REVISION)} FROM customer WHERE c_custkey % 2 = 0),
shaped AS (SELECT n.*, g.key IS NULL AS fresh, row_number() OVER (PARTITION BY n.key ORDER BY seq) = 1 AS opening, coalesce(g.domain, first_value(n.domain) OVER (PARTITION BY n.key ORDER BY seq)) = n.domain AS fits FROM new n LEFT JOIN registry g ON n.key = g.key),
put AS (SELECT s.*, v.fingerprint AS vf, v.compiled AS vc, row_number() OVER w = 1 AS inserts, first_value(s.fingerprint) OVER w AS pf, first_value(s.compiled) OVER w AS pc FROM shaped s LEFT JOIN revisions v ON s.key = v.key AND s.revision = v.revision
  WINDOW w AS (PARTITION BY s.key, s.revision, fits ORDER BY seq)),
registered AS (SELECT seq, key, revision, fingerprint, compiled, domain, purpose, role, CASE WHEN NOT fits THEN 'shape_conflict' WHEN vf IS NULL AND inserts THEN CASE WHEN fresh AND opening THEN 'created' ELSE 'inserted' END
  WHEN fingerprint = coalesce(vf, pf) AND compiled = coalesce(vc, pc) THEN 'verified' ELSE 'digest_conflict' END AS state FROM put)"""


def _registered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    new = _pick(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value"), NEW)
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_custkey % 2 = 0")
    registry = _pick(c, REGISTRY)
    return decisions.registrations(new, _pick(c, REVISION), registry), registry


@listing.add(f"WITH {REGISTERED} SELECT seq, key, revision, state FROM registered")
def workflow_registrations(spark, sf_dir):
    """What each registration does: creates a workflow, adds a revision, repeats one, or contradicts its digests or its workflow's shape."""
    return _registered(spark, sf_dir)[0].select("seq", "key", "revision", "state")


@listing.add(f"""WITH {REGISTERED}, last AS (SELECT key, arg_max(revision, seq) AS last FROM registered WHERE state NOT LIKE '%conflict' GROUP BY key)
SELECT key, coalesce(last, active) AS active, last IS NOT NULL AND last IS DISTINCT FROM active AS moved FROM registry FULL JOIN last USING (key)""")
def workflow_active(spark, sf_dir):
    """The revision that each workflow's pointer names after the registrations, and whether it moved."""
    return decisions.active_revisions(*_registered(spark, sf_dir))


BINDING = {"capability": "p_brand", "binding": "p_partkey", "priority": "p_size", "team": "CASE WHEN p_retailprice > 1500 THEN 1 END", "enabled": "p_size > CAST(p_partkey % 12 AS INT)"}


@listing.add(f"""WITH b AS (SELECT {_listed(BINDING)} FROM part), r AS (SELECT *, rank() OVER (PARTITION BY capability ORDER BY priority) AS n FROM b WHERE enabled AND team IS NULL), t AS (SELECT capability, count(*) AS n, min(binding) AS binding FROM r WHERE n = 1 GROUP BY capability)
SELECT c.capability, CASE WHEN t.n = 1 THEN binding END AS binding, CASE WHEN t.n IS NULL THEN 'missing' WHEN t.n > 1 THEN 'ambiguous' ELSE 'bound' END AS state
FROM (SELECT DISTINCT p_brand AS capability FROM part UNION SELECT o_orderpriority FROM orders) c LEFT JOIN t USING (capability)""")
def binding_resolution(spark, sf_dir):
    """One binding for each capability: the global one that stands first, an error if several do."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    needed = p.select(F.col("p_brand").alias("capability")).union(table(spark, sf_dir, "orders", "o_orderpriority"))
    return decisions.bindings_resolved(needed, _pick(p, BINDING))


PURGE = {
    "command": "o_orderkey", "team": "1", "mode": "CASE WHEN o_orderpriority LIKE '5%' THEN 'rebuild' ELSE 'purge_generation' END", "channel": "CASE WHEN floor(o_totalprice) % 9 = 0 THEN 'summary' ELSE 'all' END", "expected": "CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END",
    "targets": "CASE WHEN floor(o_totalprice) % 7 = 0 THEN {list}(o_orderkey * 10 + 2, o_orderkey * 10 + 1) WHEN floor(o_totalprice) % 7 = 1 THEN {list}(o_orderkey * 10 + 1, o_orderkey * 10 + 1) WHEN floor(o_totalprice) % 7 < 5 THEN {list}(o_orderkey * 10 + 1) ELSE {list}(o_orderkey * 10 + 1, o_orderkey * 10 + 2) END",
}
PROJECTION = {"team": "1", "artifact": "l_orderkey * 10 + l_linenumber", "type": "CASE WHEN l_quantity < 5 THEN 'structure' ELSE 'dual_channel_projection' END", "validation": "CASE WHEN l_tax > 0.07 THEN 'partial' ELSE 'full_valid' END"}
VECTOR = {"team": "1", "artifact": "l_orderkey * 10 + 1 + l_linenumber % 2", "deleted_at": "CASE WHEN l_discount > 0.06 THEN l_shipdate END"}


@listing.add(f"""WITH c AS (SELECT {_listed(PURGE).format(list="list_value")} FROM orders), a AS (SELECT {_listed(PROJECTION)} FROM lineitem), v AS (SELECT {_listed(VECTOR)} FROM lineitem),
f AS (SELECT *, coalesce((SELECT list(DISTINCT a.artifact ORDER BY a.artifact) FROM a WHERE a.type = 'dual_channel_projection' AND a.validation = 'full_valid' AND list_contains(c.targets, a.artifact)), []) AS found,
  (SELECT count(*) FROM v WHERE deleted_at IS NULL AND list_contains(c.targets, v.artifact)) AS n FROM c WHERE command < 0 UNION ALL
  SELECT c.*, coalesce(g.found, []), coalesce(g.n, 0) FROM c LEFT JOIN (SELECT command, list(artifact ORDER BY artifact) AS found, sum(n) AS n FROM (SELECT DISTINCT c.command, a.artifact, (SELECT count(*) FROM v WHERE v.artifact = a.artifact AND deleted_at IS NULL) AS n
    FROM (SELECT command, unnest(targets) AS artifact FROM c) c JOIN a USING (artifact) WHERE a.type = 'dual_channel_projection' AND a.validation = 'full_valid') GROUP BY command) g USING (command)),
s AS (SELECT *, CASE WHEN mode <> 'purge_generation' THEN 'command_invalid' WHEN channel <> 'all' THEN 'channel_unsupported' WHEN found <> targets THEN 'target_not_found' WHEN n <> expected THEN 'set_changed' ELSE 'purged' END AS state FROM f)
SELECT command, state, CASE WHEN state IN ('set_changed', 'purged') THEN n::BIGINT END AS matched, CASE WHEN state = 'purged' THEN n ELSE 0 END::BIGINT AS purged FROM s""")
def purge_receipts(spark, sf_dir):
    """What each purge command does to its targets, which must be exactly what it lists, with as many records as were planned."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    return decisions.purge_receipts(_pick(o, {k: v.format(list="array") for k, v in PURGE.items()}), _pick(l, PROJECTION), _pick(l, VECTOR))


def _digit(at: int, **cases: str) -> str:
    """A piece of a payload chosen by a digit of the text's digest."""
    return "CASE substr(h, " + str(at) + ", 1) " + " ".join(f"WHEN '{k[1:]}' THEN {v}" for k, v in cases.items()) + " ELSE '' END"


UUID = "concat('\"', substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 14, 3), '-8', substr(h, 18, 3), '-', substr(h, 21, 12), '\"')"
OLD_UUID = UUID.replace("'-4'", "'-1'")
#: Requests written from texts and their digests, whose digits choose which fields are there and what is wrong with them.
PAYLOAD = f"""CASE WHEN substr(h, 64, 1) = 'f' THEN concat('[', q) ELSE concat('{{"query":', CASE WHEN substr(h, 40, 1) = '0' THEN '7' ELSE q END, {_digit(41, _0='\'\'', _1=f"concat(',\"team_uuid\":', {OLD_UUID})", _2="',\"team_uuid\":\"x\"'").replace("ELSE ''", f"ELSE concat(',\"team_uuid\":', {UUID})")},
  {_digit(42, _0="',\"stream\":true'", _1="',\"colour\":1'", _2="',\"schema_version\":\"mkb.retrieval.v1\"'", _3="',\"schema_version\":\"v0\"'")}, {_digit(43, _0="',\"return_k\":5'", _1="',\"return_k\":\"5\"'", _2="',\"return_k\":5.0'", _3="',\"top_k\":20'", _4="',\"return_k\":3,\"top_k\":3'", _5="',\"return_k\":30'", _6="',\"return_k\":0'", _7="',\"return_k\":null'")},
  {_digit(44, _0="',\"recall_k\":50'", _1="',\"recall_k\":500'", _2="',\"recall_k\":true'")}, {_digit(45, _0="',\"threshold\":0.25'", _1="',\"score_threshold\":1'", _2="',\"score_threshold\":\"1\"'", _3="',\"threshold\":true'")},
  {_digit(46, _0="',\"filters\":{}'", _1="concat(',\"filters\":{\"channel\":\"', lang, '\"}')", _2="',\"filters\":{\"channel\":\"summary\",\"source_kind\":\"http_resource\"}'", _3="',\"filters\":{\"colour\":\"red\"}'", _4="',\"filters\":[]'", _5=f"concat(',\"filters\":{{\"intake_item_uuid\":', {UUID}, ',\"channel\":null}}')", _6="',\"filters\":{\"source_kind\":3}'", _7=f"concat(',\"filters\":{{\"intake_item_uuid\":', {OLD_UUID}, '}}')")},
  {_digit(47, _0="''", _1="',\"namespace_key\":\" \"'", _2=f"concat(',\"namespace_uuid\":', {UUID})", _3=f"concat(',\"namespace_key\":\"a\",\"namespace_uuid\":', {UUID})").replace("ELSE ''", "ELSE concat(',\"namespace_key\":\"', source, '\"')")}, {_digit(48, _0="',\"include_pack\":false'", _1="',\"include_pack\":\"no\"'")}, '}}') END"""
U = r"'^[0-9a-f]{8}-[0-9a-f]{4}-[47][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'"
_CODES = f"""CASE WHEN substr(h, 64, 1) = 'f' THEN 'RETRIEVE_SCHEMA_INVALID' WHEN len(list_intersect(keys, ['stream'])) > 0 THEN 'RETRIEVE_SCHEMA_FORBIDDEN_FIELD' WHEN list_contains(keys, 'colour') THEN 'RETRIEVE_SCHEMA_UNKNOWN_FIELD' WHEN json_extract_string(p, '$.schema_version') <> 'mkb.retrieval.v1' THEN 'RETRIEVE_SCHEMA_INVALID'
  WHEN NOT coalesce(regexp_matches(json_extract_string(p, '$.team_uuid'), {U}), false) THEN 'RETRIEVE_SCHEMA_TEAM_REQUIRED' WHEN json_type(p, '$.query') <> 'VARCHAR' THEN 'RETRIEVE_SCHEMA_QUERY_INVALID' WHEN length(json_extract_string(p, '$.query')) > 8192 THEN 'RETRIEVE_SCHEMA_INVALID'
  WHEN rt = 'DOUBLE' OR rt = 'VARCHAR' OR ct = 'BOOLEAN' OR (rk IS NOT NULL AND tk IS NOT NULL) OR coalesce(rk, tk, 10) < 1 OR coalesce(rk, tk, 10) > coalesce(ck, 20) OR coalesce(ck, 20) > 100 THEN 'RETRIEVE_TOPK_INVALID'
  WHEN json_type(p, '$.score_threshold') = 'VARCHAR' OR json_type(p, '$.threshold') = 'BOOLEAN' THEN 'RETRIEVE_SCHEMA_THRESHOLD_INVALID'
  WHEN json_type(p, '$.filters') = 'ARRAY' OR json_extract(p, '$.filters.colour') IS NOT NULL OR json_type(p, '$.filters.source_kind') = 'UBIGINT' OR coalesce(json_extract_string(p, '$.filters.channel') NOT IN ('summary', 'original'), false) OR coalesce(NOT regexp_matches(json_extract_string(p, '$.filters.intake_item_uuid'), {U}), false) THEN 'RETRIEVE_FILTER_INVALID'
  WHEN json_extract_string(p, '$.namespace_key') IS NULL AND json_extract_string(p, '$.namespace_uuid') IS NULL THEN 'RETRIEVE_SCHEMA_NAMESPACE_REQUIRED' WHEN trim(json_extract_string(p, '$.namespace_key')) = '' OR (json_extract_string(p, '$.namespace_key') IS NOT NULL AND json_extract_string(p, '$.namespace_uuid') IS NOT NULL) THEN 'RETRIEVE_SCHEMA_NAMESPACE_INVALID'
  WHEN json_type(p, '$.include_pack') = 'VARCHAR' THEN 'RETRIEVE_SCHEMA_PACK_INVALID' ELSE 'ok' END"""


@listing.add(f"""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, to_json(coalesce(text, ''))::VARCHAR AS q, lang, source FROM documents), w AS (SELECT doc_id, h, CASE WHEN substr(h, 64, 1) = 'f' THEN '{{}}' ELSE {PAYLOAD} END::JSON AS p FROM d),
k AS (SELECT *, json_keys(p) AS keys, json_type(p, '$.return_k') AS rt, json_type(p, '$.recall_k') AS ct, CASE WHEN json_type(p, '$.return_k') = 'UBIGINT' THEN json_extract_string(p, '$.return_k')::BIGINT END AS rk, json_extract_string(p, '$.top_k')::BIGINT AS tk, CASE WHEN json_type(p, '$.recall_k') = 'UBIGINT' THEN json_extract_string(p, '$.recall_k')::BIGINT END AS ck FROM w),
s AS (SELECT *, {_CODES} AS state FROM k)
SELECT doc_id AS request, state, CASE WHEN state = 'ok' THEN json_extract_string(p, '$.team_uuid') END AS team, CASE WHEN state = 'ok' THEN sha256(regexp_replace(json_extract_string(p, '$.query'), '^\\s+|\\s+$', '', 'g')) END AS query_digest,
  CASE WHEN state = 'ok' THEN CASE WHEN json_extract_string(p, '$.namespace_key') IS NOT NULL THEN 'key:' || (json_extract_string(p, '$.namespace_key')) ELSE 'uuid:' || (json_extract_string(p, '$.namespace_uuid')) END END AS selector, CASE WHEN state = 'ok' THEN coalesce(rk, tk, 10) END AS return_k, CASE WHEN state = 'ok' THEN coalesce(ck, 20) END AS recall_k,
  CASE WHEN state = 'ok' THEN coalesce(json_extract_string(p, '$.score_threshold')::DOUBLE, json_extract_string(p, '$.threshold')::DOUBLE, 0.0) END AS threshold,
  CASE WHEN state = 'ok' THEN concat_ws(';', 'channel=' || (json_extract_string(p, '$.filters.channel')), 'intake_item_uuid=' || (json_extract_string(p, '$.filters.intake_item_uuid')), 'source_kind=' || (json_extract_string(p, '$.filters.source_kind'))) END AS filters, CASE WHEN state = 'ok' THEN coalesce(json_extract_string(p, '$.include_pack')::BOOLEAN, true) END AS include_pack FROM s""")
def retrieval_requests(spark, sf_dir):
    """Retrieval requests as they will run, or the code of the first rule they break."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumn("text", F.coalesce("text", F.lit("")))
    written = d.select("doc_id", F.sha2("text", 256).alias("h"), json_text(F.col("text")).alias("q"), "lang", "source").selectExpr("doc_id AS request", f"{PAYLOAD} AS payload")
    out = decisions.retrieval_requests(written)
    return out.withColumn("query_digest", F.sha2("query", 256)).drop("query")
