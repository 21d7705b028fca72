"""What ledgers decide about requests, a row each: routes with fan-out, gate actions, members of a generation, registrations, bindings, purges, retrieval requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.text import json_text

#: What a guard may look at, and under which name a fact is held.
PREDICATES = {
    "registered_admission_result": "admission_result", "registered_request_intent": "request_intent", "registered_metadata_disposition": "metadata_disposition",
    "registered_markdown_selection": "markdown_selection", "registered_admission_markdown_selection": "admission_markdown_selection",
}
ACTIONS = ("approve", "reject", "reclean")
#: Fields of a retrieval request, those no client may set, filters and their values.
FIELDS = ("schema_version", "team_uuid", "query", "namespace_key", "namespace_uuid", "return_k", "recall_k", "score_threshold", "threshold", "include_pack", "top_k", "filters")
FORBIDDEN = ("index_generation", "raw_query_vector", "query_embedding", "distance_metric", "embedding_model", "model_override", "include_answer", "stream")
FILTERS = ("intake_item_uuid", "source_kind", "channel")
SOURCE_KINDS = ("inline_payload", "local_object", "http_resource", "registered_api")
CHANNELS = ("original", "summary")
SCHEMA = "mkb.retrieval.v1"
QUERY_CHARS, KEY_CHARS = 8192, 256
RETURN_K, RECALL_K, MAX_K = 10, 20, 100


def _first(*cases: tuple[Column, str], otherwise: Column) -> Column:
    """The name of the first case that holds; one that is null doesn't."""
    out = None
    for case, name in cases:
        out = F.when(F.coalesce(case, F.lit(False)), name) if out is None else out.when(F.coalesce(case, F.lit(False)), name)
    return out.otherwise(otherwise)


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_text), ","), F.lit("]"))


def routed(facts: DataFrame, routes: DataFrame, guards: DataFrame) -> DataFrame:
    """Routes that each outcome takes: facts (execution, step, outcome, known: map of texts) with routes, guard_results, digest and state.

    Routes (step, outcome, route, priority, kind, guard) are tried by priority, ties by name. A route without guard matches; a guard
    (guard, predicate, operator, expected) compares one fact, and a missing fact doesn't match. A route that matches is taken, and
    ends the search unless it fans out. A guard that isn't there, or asks for what isn't supported, ends it as an error.
    Routes are gathered by step and outcome, as many as a workflow declares, and join the facts in one join: facts are never grouped.
    """
    named = guards.select("guard", "predicate", "operator", "expected", F.lit(True).alias("there"))
    each = F.struct("priority", "route", "kind", "guard", "there", "operator", "expected", F.coalesce(*[F.when(F.col("predicate") == k, v) for k, v in PREDICATES.items()]).alias("fact"))
    plan = routes.join(named, "guard", "left").groupBy("step", "outcome").agg(F.array_sort(F.collect_list(each)).alias("tried"))

    def verdict(r: Column) -> Column:
        fits = F.coalesce(F.element_at(F.col("known"), r["fact"]) == r["expected"], F.lit(False))
        return F.when(r["guard"].isNull(), "match").when(r["there"].isNull(), "guard_missing").when(F.coalesce((r["operator"] != "eq") | r["fact"].isNull(), F.lit(True)), "guard_unsupported").when(fits, "match").otherwise("miss")

    judged = facts.join(plan, ["step", "outcome"], "left").withColumn("tried", F.transform(F.coalesce("tried", F.array()), lambda r: F.struct(r["route"].alias("route"), r["kind"].alias("kind"), r["guard"].alias("guard"), verdict(r).alias("verdict"))))
    ends = F.transform("tried", lambda r: (r["verdict"].startswith("guard_") | ((r["verdict"] == "match") & (r["kind"] != "fan_out"))).cast("int"))
    judged = judged.withColumn("end", F.array_position(ends, 1)).withColumn("tried", F.when(F.col("end") > 0, F.slice("tried", F.lit(1), F.col("end").cast("int"))).otherwise(F.col("tried")))
    error = F.filter("tried", lambda r: r["verdict"].startswith("guard_"))
    taken = F.transform(F.filter("tried", lambda r: r["verdict"] == "match"), lambda r: r["route"])
    asked = F.array_sort(F.array_distinct(F.transform(F.filter("tried", lambda r: r["guard"].isNotNull()), lambda r: F.struct(r["guard"].alias("guard"), (r["verdict"] == "match").alias("is")))))
    out = judged.select(*facts.columns, F.when(F.size(error) > 0, F.array().cast("array<string>")).otherwise(taken).alias("routes"), asked.alias("asked"), F.get(error, F.lit(0))["verdict"].alias("error"))
    results = F.concat(F.lit("{"), F.array_join(F.transform("asked", lambda g: F.concat(json_text(g["guard"]), F.lit(":"), g["is"].cast("string"))), ","), F.lit("}"))
    payload = F.concat(
        F.lit('{"execution_uuid":'), json_text(F.col("execution").cast("string")), F.lit(',"guard_results":'), results, F.lit(',"outcome_selector":'), json_text(F.col("outcome")), F.lit(',"routes":'), _list(F.col("routes")),
        F.lit(',"source_step_key":'), json_text(F.col("step")), F.lit("}"),
    )
    state = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size("routes") == 0, "no_route").otherwise("routed")
    return out.select(*facts.columns, "routes", F.when(F.col("error").isNull(), results).alias("guard_results"), F.when(F.col("error").isNull(), F.sha2(payload, 256)).alias("digest"), state.alias("state"))


def gate_actions(requests: DataFrame, gates: DataFrame, targets: DataFrame, executions: DataFrame, recorded: DataFrame) -> DataFrame:
    """What becomes of each request (request, gate, revision, action, key, actor, at) to decide a gate, in the order of ``at`` and request.

    Gates are (gate, status, revision, execution), targets (gate, target_digest, review: JSON with allowed_actions), executions (execution, status,
    waiting_ref), recorded the decisions made before (gate, key). Only the first request that passes every check
    decides its gate; later ones with its key repeat it, others find the gate closed. A reclean has no route and changes nothing.
    What is known of a gate is put together before requests meet it; requests are then shuffled twice, by gate and key and by gate, and the first
    one is a minimum over the rows where they are: they aren't read or shuffled again for it. A gate's requests pass through one task, which spills what it can't hold.
    """
    listed = F.from_json("review", "allowed_actions array<string>")["allowed_actions"]
    broken = F.coalesce((F.size("_listed") < 1) | (F.size(F.array_distinct("_listed")) < F.size("_listed")) | F.exists("_listed", lambda a: F.coalesce(~a.isin(*ACTIONS), F.lit(True))), F.lit(True))
    t = targets.select("gate", "target_digest", listed.alias("_listed")).select("gate", "target_digest", F.when(~broken, F.col("_listed")).alias("_allowed"), F.lit(True).alias("_target"))
    x = executions.select("execution", F.col("status").alias("_running"), "waiting_ref")
    g = gates.select("gate", F.col("status").alias("_status"), F.col("revision").alias("_revision"), "execution").join(x, "execution", "left").join(t, "gate", "left").drop("execution")
    known = recorded.select("gate", "key").distinct().withColumn("_recorded", F.lit(True))
    rows = requests.join(known, ["gate", "key"], "left").join(g, "gate", "left")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    early = ((F.coalesce(~F.col("action").isin(*ACTIONS), F.lit(True)), "gate-action-invalid"), (empty("key") | empty("actor"), "gate-decision-invalid"), (F.col("_status").isNull(), "gate-not-found"), (F.col("_recorded"), "repeated"))
    late = (
        (F.coalesce((F.col("_status") != "open") | (F.col("_revision") != F.col("revision")), F.lit(True)), "gate-revision-conflict"), (F.col("_target").isNull(), "gate-target-missing"), (F.col("_allowed").isNull(), "gate-target-invalid"),
        (~F.array_contains("_allowed", F.col("action")), "gate-action-not-allowed"), (F.coalesce((F.col("_running") != "waiting") | (F.col("waiting_ref") != F.col("gate")), F.lit(True)), "gate-execution-conflict"),
        (F.col("action") == "reclean", "gate-action-route-unavailable"),
    )
    rows = rows.withColumn("_state", _first(*early, *late, otherwise=F.lit("accepted"))).withColumn("_early", _first(*early, otherwise=F.lit(None).cast("string")))
    place = F.struct("at", "request")
    rows = rows.withColumn("_first", F.min(F.when(F.col("_state") == "accepted", F.struct("at", "request", "key"))).over(Window.partitionBy("gate")))
    after = F.col("_first").isNotNull() & (place > F.struct("_first.at", "_first.request"))
    state = F.when(~F.coalesce(after, F.lit(False)) | F.col("_early").isNotNull(), F.col("_state")).when(F.col("key") == F.col("_first.key"), "repeated").otherwise("gate-revision-conflict")
    decided = F.col("state") == "accepted"
    digest = F.sha2(F.concat(F.lit('{"action":'), json_text(F.col("action")), F.lit(',"gate_revision":'), F.col("revision").cast("string"), F.lit(',"gate_uuid":'), json_text(F.col("gate").cast("string")), F.lit(',"idempotency_key":'), json_text(F.col("key")), F.lit("}")), 256)
    return rows.withColumn("state", state).select(
        "request", "gate", "state", F.when(decided, F.when(F.col("action") == "reject", "rejected").otherwise("released")).alias("gate_status"), F.when(decided, F.col("revision") + 1).alias("gate_revision"),
        F.when(decided, F.col("target_digest")).alias("target_digest"), F.when(decided, digest).alias("decision_digest"),
    )


def generation_members(handoffs: DataFrame, receipts: DataFrame, artifacts: DataFrame, pointers: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(team, execution, task, matched, failures, admitted): whether each handoff's members are what the ledger holds and serves now.

    Every one of ``names`` needs a receipt (team, execution, member, artifact, handle, digest, size) whose texts aren't empty and whose size isn't
    negative; a fully valid artifact of the same team, member, handle, digest, size, execution and task; and a pointer to it.
    ``failures`` lists member=reason by name. Joins are on keys of all members; the group of a handoff has one row a name.
    """
    wanted = handoffs.select("team", "execution", "task").withColumn("member", F.explode(F.array(*map(F.lit, names))))
    r = receipts.select("team", "execution", "member", F.col("artifact").alias("_artifact"), F.col("handle").alias("_handle"), F.col("digest").alias("_digest"), F.col("size").alias("_size"))
    a = artifacts.select("team", "member", F.col("artifact").alias("_artifact"), "handle", "digest", "size", "validation", F.col("execution").alias("_execution"), F.col("task").alias("_task"), F.lit(True).alias("_there"))
    p = pointers.select("team", "execution", "member", F.col("artifact").alias("_current"))
    rows = wanted.join(r, ["team", "execution", "member"], "left").join(a, ["team", "member", "_artifact"], "left").join(p, ["team", "execution", "member"], "left")
    blank = lambda c: F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reason = _first(
        (blank("_artifact") | blank("_handle") | blank("_digest") | F.coalesce(F.col("_size") < 0, F.lit(True)), "receipt_invalid"), (F.col("_there").isNull(), "artifact_missing"), (differs("handle", "_handle"), "handle"), (differs("digest", "_digest"), "digest"),
        (differs("size", "_size"), "size"), (~F.col("validation").eqNullSafe("full_valid"), "validation"), (differs("_execution", "execution") | differs("_task", "task"), "owner"), (differs("_current", "_artifact"), "not_current"),
        otherwise=F.lit(None).cast("string"),
    )
    judged = rows.select("team", "execution", "task", "member", reason.alias("reason"))
    failed = F.collect_set(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "member", "reason")))
    out = judged.groupBy("team", "execution", "task").agg(F.count_if(F.col("reason").isNull()).alias("matched"), F.array_join(F.array_sort(failed), ",").alias("failures"))
    return out.withColumn("admitted", F.col("failures") == "")


#: What a workflow keeps over all its revisions.
SHAPE = ("domain", "purpose", "role")


def registrations(new: DataFrame, revisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Registrations (seq, key, revision, fingerprint, compiled, domain, purpose, role) with ``state``: created, inserted, verified, digest_conflict or shape_conflict.

    They apply in the order of ``seq``. A key that the registry (key, domain, purpose, role) lacks takes the shape of the first registration; every other
    must have the same. A revision number that is not held (key, revision, fingerprint, compiled) takes the digests of the
    first registration of the right shape, which inserts it; every other must have the same digests.
    """
    shape = F.struct(*SHAPE)
    first = new.groupBy("key").agg(F.min_by(shape, "seq").alias("_taken"), F.min("seq").alias("_began"))
    held = registry.select("key", shape.alias("_held"))
    rows = new.join(first, "key").join(held, "key", "left").withColumn("_fits", shape.eqNullSafe(F.coalesce("_held", "_taken")))
    digests = F.struct("fingerprint", "compiled")
    inserting = rows.where("_fits").groupBy("key", "revision").agg(F.min_by(digests, "seq").alias("_put"), F.min("seq").alias("_at"))
    stored = revisions.select("key", "revision", digests.alias("_stored"))
    rows = rows.join(inserting, ["key", "revision"], "left").join(stored, ["key", "revision"], "left")
    state = _first(
        (~F.col("_fits"), "shape_conflict"), (F.col("_stored").isNull() & (F.col("seq") == F.col("_at")) & F.col("_held").isNull() & (F.col("seq") == F.col("_began")), "created"),
        (F.col("_stored").isNull() & (F.col("seq") == F.col("_at")), "inserted"), (digests.eqNullSafe(F.coalesce("_stored", "_put")), "verified"), otherwise=F.lit("digest_conflict"),
    )
    return rows.withColumn("state", state).select(*new.columns, "state")


def active_revisions(registered: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, active, moved): the revision that each workflow's pointer names after ``registered``: that of its last registration without conflict, else what the registry holds."""
    last = registered.where(~F.col("state").endswith("conflict")).groupBy("key").agg(F.max_by("revision", "seq").alias("_last"))
    out = registry.select("key", F.col("active").alias("_was")).join(last, "key", "full")
    return out.select("key", F.coalesce("_last", "_was").alias("active"), (F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("_was"))).alias("moved"))


def bindings_resolved(needed: DataFrame, bindings: DataFrame) -> DataFrame:
    """(capability, binding, state) of needed capabilities: the enabled binding of no team with the smallest priority number; missing if there is none, ambiguous if several share it.

    Counted by capability and priority first, so a capability of any number of bindings reaches its group as one row a priority.
    """
    each = bindings.where("enabled and team is null").groupBy("capability", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("binding").alias("binding"))
    top = each.groupBy("capability").agg(F.min_by(F.struct("n", "binding"), "priority").alias("top"))
    state = F.when(F.col("top").isNull(), "missing").when(F.col("top.n") > 1, "ambiguous").otherwise("bound")
    return needed.select("capability").distinct().join(top, "capability", "left").select("capability", F.when(state == "bound", F.col("top.binding")).alias("binding"), state.alias("state"))


def purge_receipts(commands: DataFrame, artifacts: DataFrame, records: DataFrame) -> DataFrame:
    """Receipts of purge commands (command, team, mode, channel, targets, expected): command, state, matched and purged records.

    The listed targets must be exactly the fully valid projections among them (team, artifact, type, validation), ascending and each once; the records
    (team, artifact, deleted_at) that are live under them must still be as many as the plan expected. Live records are counted by artifact before they meet a command.
    """
    named = commands.select("command", "team", F.explode("targets").alias("artifact"))
    valid = artifacts.where("type = 'dual_channel_projection' and validation = 'full_valid'").select("team", "artifact").distinct()
    live = records.where("deleted_at is null").groupBy("team", "artifact").agg(F.count(F.lit(1)).alias("n"))
    per = named.distinct().join(valid, ["team", "artifact"]).join(live, ["team", "artifact"], "left").groupBy("command").agg(F.array_sort(F.collect_list("artifact")).alias("_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    rows = commands.join(per, "command", "left")
    state = _first(
        (~F.col("mode").eqNullSafe("purge_generation"), "command_invalid"), (~F.col("channel").eqNullSafe("all"), "channel_unsupported"), (~F.coalesce("_found", F.array().cast("array<long>")).eqNullSafe(F.col("targets")), "target_not_found"),
        (~F.coalesce("_n", F.lit(0)).eqNullSafe(F.col("expected")), "set_changed"), otherwise=F.lit("purged"),
    )
    bound = F.col("state").isin("set_changed", "purged")
    return rows.withColumn("state", state).select("command", "state", F.when(bound, F.coalesce("_n", F.lit(0))).alias("matched"), F.when(F.col("state") == "purged", F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("purged"))


def canonical_uuid(text: Column) -> Column:
    """A UUID of version 4 or 7 in its usual form; null for anything else."""
    hex_ = F.replace(F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit(""))
    spelled = F.concat_ws("-", *[F.substring(hex_, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(F.regexp_like(hex_, F.lit("^[0-9a-f]{12}[47][0-9a-f]{3}[89ab][0-9a-f]{15}$")), spelled)


def retrieval_requests(requests: DataFrame, max_k: int = MAX_K, default_threshold: float = 0.0) -> DataFrame:
    """Retrieval requests (request, payload: JSON) as they will run, or the code of the first rule they break.

    A field counts with the type it has in the JSON: a number in quotes is no number, and 5.0 no whole one. Returns request, state (ok or an error code), team, query,
    selector (key:... or uuid:...), return_k, recall_k, threshold, filters (name=value by name) and include_pack; all but state are null beside an error.
    What isn't a JSON object is RETRIEVE_SCHEMA_INVALID. All of it is expressions over VARIANT; nothing is shuffled.
    """
    v = F.try_parse_json("payload")
    keys = F.map_keys(F.from_json("payload", "map<string,string>"))
    fields = [F.try_variant_get("v", f"$.{k}", "string").alias(f"s_{k}") for k in FIELDS] + [F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).alias(f"t_{k}") for k in FIELDS]
    within = F.from_json("s_filters", "map<string,string>")
    rows = requests.select("request", v.alias("v"), keys.alias("keys")).select("request", "keys", F.schema_of_variant("v").alias("t_"), *fields, "v")
    rows = rows.withColumn("within", within).withColumn("kinds", F.array(*[F.schema_of_variant(F.try_variant_get("v", f"$.filters.{k}", "variant")) for k in FILTERS]))
    s, t = (lambda k: F.col(f"s_{k}")), (lambda k: F.col(f"t_{k}"))
    given = lambda k: t(k).isNotNull() & (t(k) != "VOID")
    text = lambda k: t(k) == "STRING"
    whole = lambda k: given(k) & ~((t(k) == "BIGINT") & (s(k).try_cast("long") >= 1))
    number = lambda k: (t(k) == "BIGINT") | (t(k) == "DOUBLE") | t(k).startswith("DECIMAL")
    blank = lambda k: F.trim(F.regexp_replace(s(k), r"^\s+|\s+$", "")) == ""
    return_k = F.coalesce(F.when(given("return_k"), s("return_k")), F.when(given("top_k"), s("top_k")), F.lit(str(RETURN_K))).try_cast("long")
    recall_k = F.coalesce(F.when(given("recall_k"), s("recall_k")), F.lit(str(RECALL_K))).try_cast("long")
    limit = "score_threshold", "threshold"
    chosen = F.when(given(limit[0]), s(limit[0])).when(given(limit[1]), s(limit[1]))
    odd = F.when(given(limit[0]), ~number(limit[0])).otherwise(given(limit[1]) & ~number(limit[1])) | F.coalesce(F.abs(chosen.try_cast("double")) == float("inf"), F.lit(False))
    value = lambda k: F.element_at("within", k)
    held = [F.col("kinds")[i].isNotNull() & (F.col("kinds")[i] != "VOID") for i in range(len(FILTERS))]
    wrong = given("filters") & (
        ~t("filters").startswith("OBJECT") | (F.size(F.array_except(F.map_keys("within"), F.array(*map(F.lit, FILTERS)))) > 0)
        | F.greatest(*[h & ((F.col("kinds")[i] != "STRING") | (value(k) == "")) for i, (k, h) in enumerate(zip(FILTERS, held))])
        | (held[0] & canonical_uuid(value(FILTERS[0])).isNull()) | (held[1] & ~value(FILTERS[1]).isin(*SOURCE_KINDS)) | (held[2] & ~value(FILTERS[2]).isin(*CHANNELS))
    )
    neither, key, id_ = ~given("namespace_key") & ~given("namespace_uuid"), "namespace_key", "namespace_uuid"
    state = _first(
        (~F.coalesce(F.col("t_").startswith("OBJECT"), F.lit(False)), "RETRIEVE_SCHEMA_INVALID"), (F.arrays_overlap("keys", F.array(*map(F.lit, FORBIDDEN))), "RETRIEVE_SCHEMA_FORBIDDEN_FIELD"),
        (F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) > 0, "RETRIEVE_SCHEMA_UNKNOWN_FIELD"), (given("schema_version") & ~(text("schema_version") & (s("schema_version") == SCHEMA)), "RETRIEVE_SCHEMA_INVALID"),
        (~F.coalesce(text("team_uuid"), F.lit(False)) | canonical_uuid(s("team_uuid")).isNull(), "RETRIEVE_SCHEMA_TEAM_REQUIRED"), (~F.coalesce(text("query"), F.lit(False)), "RETRIEVE_SCHEMA_QUERY_INVALID"), (F.length(s("query")) > QUERY_CHARS, "RETRIEVE_SCHEMA_INVALID"),
        ((given("return_k") & given("top_k")) | whole("return_k") | whole("top_k") | whole("recall_k"), "RETRIEVE_TOPK_INVALID"), ((return_k > max_k) | (recall_k > max_k) | (return_k > recall_k), "RETRIEVE_TOPK_INVALID"),
        (odd, "RETRIEVE_SCHEMA_THRESHOLD_INVALID"), (wrong, "RETRIEVE_FILTER_INVALID"), (neither, "RETRIEVE_SCHEMA_NAMESPACE_REQUIRED"),
        (given(key) & (~text(key) | blank(key) | (F.length(s(key)) > KEY_CHARS)), "RETRIEVE_SCHEMA_NAMESPACE_INVALID"), (given(id_) & (~text(id_) | canonical_uuid(s(id_)).isNull() | given(key)), "RETRIEVE_SCHEMA_NAMESPACE_INVALID"),
        (given("include_pack") & (t("include_pack") != "BOOLEAN"), "RETRIEVE_SCHEMA_PACK_INVALID"), otherwise=F.lit("ok"),
    )
    filters = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(h, F.concat(F.lit(f"{k}="), canonical_uuid(value(k)) if k == FILTERS[0] else value(k))) for k, h in zip(FILTERS, held)]))), ";")
    out = {
        "team": canonical_uuid(s("team_uuid")), "query": F.regexp_replace(s("query"), r"^\s+|\s+$", ""), "selector": F.when(given(key), F.concat(F.lit("key:"), s(key))).otherwise(F.concat(F.lit("uuid:"), canonical_uuid(s(id_)))),
        "return_k": return_k, "recall_k": recall_k, "threshold": F.coalesce(chosen.try_cast("double"), F.lit(default_threshold)), "filters": F.coalesce(filters, F.lit("")), "include_pack": F.coalesce(F.when(given("include_pack"), s("include_pack")).try_cast("boolean"), F.lit(True)),
    }
    judged = rows.withColumn("state", state)
    return judged.select("request", "state", *[F.when(F.col("state") == "ok", c).alias(k) for k, c in out.items()])
