"""Decisions on fixed cases: order, ties, nulls, empty tables."""

import json

import pytest

from lamella.operators import decisions

UUID4 = "0f8fad5b-d9cb-469f-a165-70867728950e"
GATE = "gate long, status string, revision long, execution long"
REQUEST = "request string, gate long, revision long, action string, key string, actor string, at long"


def gates(spark, requests, status="open", review='{"allowed_actions":["approve","reject"]}', recorded=()):
    out = decisions.gate_actions(
        spark.createDataFrame(requests, REQUEST), spark.createDataFrame([(1, status, 4, 10)], GATE), spark.createDataFrame([(1, "t", review)], "gate long, target_digest string, review string"),
        spark.createDataFrame([(10, "waiting", 1)], "execution long, status string, waiting_ref long"), spark.createDataFrame(list(recorded), "gate long, key string"),
    )
    return {r["request"]: (r["state"], r["gate_status"], r["gate_revision"]) for r in out.collect()}


def test_one_request_decides_a_gate(spark):
    found = gates(spark, [("a", 1, 3, "approve", "k", "x", 1), ("b", 1, 4, "reject", "k", "x", 2), ("c", 1, 4, "approve", "k", "x", 3), ("d", 1, 4, "approve", "l", "x", 3), ("e", 2, 4, "approve", "l", "x", 0), ("f", 1, 4, "approve", None, "x", 0), ("g", 1, 4, None, "k", "x", 0)])
    assert found == {
        "a": ("gate-revision-conflict", None, None), "b": ("accepted", "rejected", 5), "c": ("repeated", None, None), "d": ("gate-revision-conflict", None, None), "e": ("gate-not-found", None, None),
        "f": ("gate-decision-invalid", None, None), "g": ("gate-action-invalid", None, None),
    }


@pytest.mark.parametrize("review", [None, "[", "{}", '{"allowed_actions":[]}', '{"allowed_actions":["approve",null]}', '{"allowed_actions":["approve","approve"]}', '{"allowed_actions":["close"]}'])
def test_broken_targets_decide_nothing(spark, review):
    assert gates(spark, [("a", 1, 4, "approve", "k", "x", 1)], review=review)["a"][0] == "gate-target-invalid"


def test_recorded_keys_and_closed_gates(spark):
    assert gates(spark, [("a", 1, 4, "approve", "k", "x", 1)], recorded=[(1, "k")])["a"][0] == "repeated"
    assert gates(spark, [("a", 1, 4, "approve", "k", "x", 1)], status="released")["a"][0] == "gate-revision-conflict"
    assert gates(spark, [("a", 1, 4, "reclean", "k", "x", 1), ("b", 1, 4, "approve", "k", "x", 2)], review='{"allowed_actions":["approve","reclean"]}') == {"a": ("gate-action-route-unavailable", None, None), "b": ("accepted", "released", 5)}
    assert gates(spark, []) == {}


def routes(spark, known, declared, guards=(("g", "registered_request_intent", "eq", "a"),)):
    out = decisions.routed(
        spark.createDataFrame([(1, "s", "ok", known)], "execution long, step string, outcome string, known map<string,string>"),
        spark.createDataFrame([("s", "ok", *r) for r in declared], "step string, outcome string, route string, priority int, kind string, guard string"), spark.createDataFrame(list(guards), "guard string, predicate string, operator string, expected string"),
    ).first()
    return out["state"], out["routes"], out["guard_results"]


def test_routes_fan_out_until_one_ends_the_search(spark):
    many = [("z", 1, "fan_out", None), ("b", 2, "fan_out", "g"), ("c", 3, "normal", None), ("d", 4, "fan_out", None)]
    assert routes(spark, {"request_intent": "a"}, many) == ("routed", ["z", "b", "c"], '{"g":true}')
    assert routes(spark, {"request_intent": "b"}, many) == routes(spark, {}, many) == routes(spark, None, many) == ("routed", ["z", "c"], '{"g":false}')
    assert routes(spark, {}, [("a", 1, "normal", "g")]) == ("no_route", [], '{"g":false}')
    assert routes(spark, {}, []) == ("no_route", [], "{}")


def test_guards_that_nobody_reaches_are_no_errors(spark):
    assert routes(spark, {}, [("a", 1, "normal", None), ("b", 2, "normal", "lost")]) == ("routed", ["a"], "{}")
    assert routes(spark, {}, [("a", 1, "fan_out", None), ("b", 2, "normal", "lost")]) == ("guard_missing", [], None)
    assert routes(spark, {}, [("b", 2, "normal", "g")], [("g", "registered_request_intent", "gt", "a")]) == routes(spark, {}, [("b", 2, "normal", "g")], [("g", "text", "eq", "a")]) == ("guard_unsupported", [], None)


def asked(spark, *payloads):
    rows = spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "request long, payload string")
    return [r.asDict() for r in decisions.retrieval_requests(rows).orderBy("request").collect()]


def test_requests_in_their_usual_form(spark):
    (r,) = asked(spark, {"team_uuid": "urn:uuid:{" + UUID4.upper() + "}", "query": "  two words\n", "namespace_key": "n", "top_k": 3, "threshold": 1, "filters": {"channel": "summary", "source_kind": None, "intake_item_uuid": UUID4.replace("-", "")}, "include_pack": False})
    assert r == {"request": 0, "state": "ok", "team": UUID4, "query": "two words", "selector": "key:n", "return_k": 3, "recall_k": 20, "threshold": 1.0, "filters": f"channel=summary;intake_item_uuid={UUID4}", "include_pack": False}


def test_requests_that_break_a_rule(spark):
    good = {"team_uuid": UUID4, "query": "q", "namespace_key": "n"}
    cases = [
        (None, "RETRIEVE_SCHEMA_INVALID"), ("", "RETRIEVE_SCHEMA_INVALID"), ("[1]", "RETRIEVE_SCHEMA_INVALID"), (good, "ok"), (good | {"stream": False, "x": 1}, "RETRIEVE_SCHEMA_FORBIDDEN_FIELD"), (good | {"x": 1}, "RETRIEVE_SCHEMA_UNKNOWN_FIELD"), ({**good, "team_uuid": None}, "RETRIEVE_SCHEMA_TEAM_REQUIRED"),
        (good | {"team_uuid": UUID4[:14] + "1" + UUID4[15:]}, "RETRIEVE_SCHEMA_TEAM_REQUIRED"), (good | {"query": ["q"]}, "RETRIEVE_SCHEMA_QUERY_INVALID"), (good | {"query": "é" * 8192}, "ok"), (good | {"query": "é" * 8193}, "RETRIEVE_SCHEMA_INVALID"), (good | {"query": ""}, "ok"),
        (good | {"return_k": 10**30}, "RETRIEVE_TOPK_INVALID"), (good | {"return_k": -1}, "RETRIEVE_TOPK_INVALID"), (good | {"return_k": True}, "RETRIEVE_TOPK_INVALID"), (good | {"return_k": 21}, "RETRIEVE_TOPK_INVALID"), (good | {"return_k": 100, "recall_k": 100}, "ok"), (good | {"recall_k": 101}, "RETRIEVE_TOPK_INVALID"),
        (good | {"threshold": "1"}, "RETRIEVE_SCHEMA_THRESHOLD_INVALID"), (good | {"score_threshold": 0.5, "threshold": "1"}, "ok"), (good | {"filters": {"channel": ""}}, "RETRIEVE_FILTER_INVALID"), (good | {"filters": {"channel": "all"}}, "RETRIEVE_FILTER_INVALID"), (good | {"filters": "x"}, "RETRIEVE_FILTER_INVALID"),
        (good | {"namespace_key": None}, "RETRIEVE_SCHEMA_NAMESPACE_REQUIRED"), (good | {"namespace_key": 3}, "RETRIEVE_SCHEMA_NAMESPACE_INVALID"), (good | {"namespace_key": "n" * 257}, "RETRIEVE_SCHEMA_NAMESPACE_INVALID"), (good | {"namespace_uuid": UUID4}, "RETRIEVE_SCHEMA_NAMESPACE_INVALID"),
        ({**good, "namespace_key": None, "namespace_uuid": UUID4}, "ok"), (good | {"include_pack": 1}, "RETRIEVE_SCHEMA_PACK_INVALID"),
    ]
    assert [(i, r["state"]) for i, r in enumerate(asked(spark, *[p for p, _ in cases]))] == [(i, s) for i, (_, s) in enumerate(cases)]


def test_members_must_be_whole_own_and_current(spark):
    h = spark.createDataFrame([(1, 5, 7)], "team long, execution long, task long")
    r = "team long, execution long, member string, artifact long, handle string, digest string, size long"
    a = "team long, member string, artifact long, handle string, digest string, size long, validation string, execution long, task long"
    p = "team long, execution long, member string, artifact long"
    made = lambda x, s: spark.createDataFrame(x, s)
    both = [(1, 5, "a", 1, "h", "d", 3), (1, 5, "b", 2, "h", "d", None)]
    held = [(1, "a", 1, "h", "d", 3, "full_valid", 5, 7), (1, "b", 2, "h", "d", 3, "full_valid", 5, 7)]
    (row,) = decisions.generation_members(h, made(both, r), made(held, a), made([(1, 5, "a", 1)], p), ("a", "b", "c")).collect()
    assert (row["matched"], row["failures"], row["admitted"]) == (1, "b=receipt_invalid,c=receipt_invalid", False)
    assert decisions.generation_members(h, made(both[:1], r), made(held, a), made([(1, 5, "a", 1)], p), ("a",)).first()["admitted"]
    assert decisions.generation_members(h, made(both[:1], r), made(held, a), made([], p), ("a",)).first()["failures"] == "a=not_current"
    assert decisions.generation_members(h.limit(0), made([], r), made([], a), made([], p), ("a",)).count() == 0


def test_purges_need_their_whole_target_set(spark):
    c = spark.createDataFrame([(1, 1, "purge_generation", "all", [1, 2], 2), (2, 1, "purge_generation", "all", [2, 1], 2), (3, 1, "purge_generation", "all", [1, 3], 1), (4, 1, "purge_generation", "all", [1], 2), (5, 1, None, "all", [1], 1), (6, 1, "purge_generation", "all", [], 0), (7, 2, "purge_generation", "all", [1], 1)], "command long, team long, mode string, channel string, targets array<long>, expected long")
    a = spark.createDataFrame([(1, i, "dual_channel_projection", v) for i, v in ((1, "full_valid"), (2, "full_valid"), (3, "partial"))], "team long, artifact long, type string, validation string")
    v = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 2, 9)], "team long, artifact long, deleted_at long")
    found = {r["command"]: (r["state"], r["matched"], r["purged"]) for r in decisions.purge_receipts(c, a, v).collect()}
    lost = ("target_not_found", None, 0)
    assert found == {1: ("purged", 2, 2), 2: lost, 3: lost, 4: ("set_changed", 1, 0), 5: ("command_invalid", None, 0), 6: ("purged", 0, 0), 7: lost}


def test_registrations_and_the_active_pointer(spark):
    new = spark.createDataFrame([(i, "w", r, f, "c", d, "p", "r") for i, (r, f, d) in enumerate([(1, "f", "x"), (1, "g", "x"), (2, "f", "y"), (2, "f", "x"), (1, "f", "x")])], "seq long, key string, revision long, fingerprint string, compiled string, domain string, purpose string, role string")
    registry = spark.createDataFrame([("v", "x", "p", "r", 3)], "key string, domain string, purpose string, role string, active long")
    revisions = spark.createDataFrame([], "key string, revision long, fingerprint string, compiled string")
    done = decisions.registrations(new, revisions, registry)
    assert [r["state"] for r in done.orderBy("seq").collect()] == ["created", "digest_conflict", "shape_conflict", "inserted", "verified"]
    assert {r["key"]: (r["active"], r["moved"]) for r in decisions.active_revisions(done, registry).collect()} == {"w": (1, True), "v": (3, False)}


def test_a_shared_first_place_binds_nothing(spark):
    b = spark.createDataFrame([("c", 1, 5, None, True), ("c", 2, 5, None, True), ("d", 3, 5, None, True), ("d", 4, 4, 9, True), ("d", 5, 3, None, False)], "capability string, binding long, priority int, team long, enabled boolean")
    needed = spark.createDataFrame([("c",), ("d",), ("e",)], "capability string")
    assert {r["capability"]: (r["binding"], r["state"]) for r in decisions.bindings_resolved(needed, b).collect()} == {"c": (None, "ambiguous"), "d": (3, "bound"), "e": (None, "missing")}
