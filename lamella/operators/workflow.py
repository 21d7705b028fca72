"""Checks and views over workflow ledgers: gates, restarts, scatter facts, retries, registrations, transitions, readiness."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.folds import numbered
from lamella.operators.ledger import latest

#: Error codes after which a step is tried again.
RECOVERABLE = (
    "VECTORIZE_INFERENCE_FAILED", "GENERATION_INFERENCE_FAILED", "VECTORIZE_CONFIG_SNAPSHOT_UNAVAILABLE", "INFERENCE_TRANSPORT_RETRYABLE", "CLAUDE_CLI_TIMEOUT",
    "CLAUDE_CLI_TRANSPORT_FAILED", "INFERENCE_TRANSPORT_EXHAUSTED", "INFERENCE_BACKPRESSURE", "not-ready",
)
#: Team states, actions and what follows; the states of a candidate set likewise.
TEAM_MOVES = [("active", "deactivate", "inactive"), ("inactive", "activate", "active"), ("active", "delete", "deleted"), ("inactive", "delete", "deleted"), ("deleted", "restore", "inactive")]
CANDIDATE_MOVES = [("open", "seal", "sealed"), ("sealed", "accept", "accepted"), ("sealed", "abandon", "abandoned"), ("open", "abandon", "abandoned")]
RUNNING = ("ready", "claimed", "running", "retry_wait", "cancelling")
ENDED = ("succeeded", "failed", "cancelled")
NEEDED = ("embed", "structured_generate", "text_generate")


def open_gates(gates: DataFrame, targets: DataFrame) -> DataFrame:
    """The newest open gate of each task, its target if any, and how many gates the task has open."""
    held = gates.where("status = 'open'")
    counts = held.groupBy("team", "task").agg(F.count(F.lit(1)).alias("open_gates"))
    return latest(held, ["team", "task"], [F.desc("opened_at"), F.desc("gate")]).join(targets, ["team", "gate"], "left").join(counts, ["team", "task"])


def gate_states(gates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(gate, state): cancelled, else the first decision on the gate's current revision, else stale if all decisions were on others, else open.

    Decisions come in the order of decided_at, id and, if there is one, ``place``, the row's place in its ledger: times and ids may repeat.
    """
    order = [c for c in ("decided_at", "id", "place") if c in decisions.columns]
    first = decisions.groupBy("gate", "revision").agg(F.min_by("decision", F.struct(*order)).alias("_decision"))
    any_ = decisions.select("gate").distinct().withColumn("_any", F.lit(True))
    out = gates.join(first, ["gate", "revision"], "left").join(any_, "gate", "left")
    return out.select("gate", F.when(F.col("cancelled"), "cancelled").when(F.col("_decision").isNotNull(), F.col("_decision")).when(F.col("_any"), "stale").otherwise("open").alias("state"))


def restart_listing(restarts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Restarts with the state of the task they made, if it is still there."""
    return restarts.join(tasks.select("team", F.col("task").alias("restart_task"), F.col("status").alias("target_status"), F.col("generation").alias("target_generation")), ["team", "restart_task"], "left")


def artifact_listing(artifacts: DataFrame, executions: DataFrame) -> DataFrame:
    """Artifacts with the execution that made them; one without isn't listed."""
    return artifacts.join(executions, ["team", "execution"])


def pending_decisions(outbox: DataFrame, decisions: DataFrame) -> DataFrame:
    """Gates whose decision still waits in the outbox: messages name it inside their JSON payload."""
    waiting = outbox.where("kind = 'gate_decision' and status in ('pending', 'in_flight')").select(F.get_json_object("payload", "$.decision").cast("long").alias("decision"))
    return decisions.join(waiting.where("decision is not null").distinct(), "decision", "left_semi").select("gate").distinct()


def with_publication(tasks: DataFrame, publications: DataFrame) -> DataFrame:
    """Tasks with ``publication_ready``: whether any publication of theirs is active."""
    ready = publications.where("status = 'active'").select("task").distinct().withColumn("publication_ready", F.lit(True))
    return tasks.join(ready, "task", "left").withColumn("publication_ready", F.coalesce("publication_ready", F.lit(False)))


def scatter_facts(memberships: DataFrame, facts: DataFrame) -> DataFrame:
    """(snapshot, required, facts, intact): whether the accepted facts are exactly the required members, one to one.

    A required member must be accepted and name item and revision; facts must be complete, distinct, and match members
    by ordinal, item and revision. Anything else means a corrupt snapshot, never a smaller one.
    """
    key = ["snapshot", "ordinal", "item", "revision"]
    need = memberships.where("required")
    broken = need.where("decision <> 'accepted' or item is null or revision is null or decision is null").groupBy("snapshot").agg(F.count(F.lit(1)).alias("broken"))
    e = need.groupBy(*key).agg(F.count(F.lit(1)).alias("e"))
    a = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("a"))
    on = (e["snapshot"] == a["snapshot"]) & e["ordinal"].eqNullSafe(a["ordinal"]) & e["item"].eqNullSafe(a["item"]) & e["revision"].eqNullSafe(a["revision"])
    both = e.join(a, on, "full_outer").select(F.coalesce(e["snapshot"], a["snapshot"]).alias("snapshot"), F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    out = both.groupBy("snapshot").agg(F.sum("e").alias("required"), F.sum("a").alias("facts"), F.bool_and((F.col("e") == 1) & (F.col("a") == 1)).alias("same"))
    return out.join(broken, "snapshot", "left").select("snapshot", "required", "facts", (F.col("same") & F.col("broken").isNull()).alias("intact"))


def resolved(requests: DataFrame, registry: DataFrame, revisions: DataFrame) -> DataFrame:
    """Requests (request, key) with the active revision of their workflow, if there is exactly one; else ``state`` says missing or ambiguous.

    Active revisions are counted by key, and equal requests too, before they meet: a request never meets the workflows of a shared key one by one.
    """
    active = registry.join(revisions, (registry["workflow"] == revisions["of"]) & (registry["active_revision"] == revisions["revision"]))
    active = active.groupBy("key").agg(F.count("revision").alias("_n"), F.min("revision").alias("revision"), F.min("digest").alias("digest"))
    asked = requests.groupBy("request", "key").agg(F.count(F.lit(1)).alias("_times"))
    found = asked.join(active, "key", "left").withColumn("n", F.coalesce(F.col("_times") * F.col("_n"), F.lit(0)))
    one = F.col("n") == 1
    return found.select("request", "key", F.when(one, F.col("revision")).alias("revision"), F.when(one, F.col("digest")).alias("digest"), F.when(one, "resolved").when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("state"))


def registered(new: DataFrame, revisions: DataFrame) -> DataFrame:
    """Registrations (key, revision, digest, compiled): a new number is inserted, a known one must match every digest, or conflicts."""
    held = revisions.select("key", "revision", F.col("digest").alias("_d"), F.col("compiled").alias("_c"))
    out = new.join(held, ["key", "revision"], "left")
    return out.withColumn("state", F.when(F.col("_d").isNull(), "inserted").when((F.col("digest") == F.col("_d")) & (F.col("compiled") == F.col("_c")), "verified").otherwise("conflict")).drop("_d", "_c")


def heads_merged(first: DataFrame, second: DataFrame, order: tuple[str, ...] = ("available_at", "created_at", "process")) -> DataFrame:
    """The earlier of the heads of two queues; each queue gives one row."""
    by = [F.asc_nulls_first(c) for c in order]
    one = lambda df: df.orderBy(*by).limit(1)
    return one(one(first).unionByName(one(second)))


def convergence(executions: DataFrame, processes: DataFrame) -> DataFrame:
    """Cancelling executions with their active processes and unfinished descendants, and whether the cancellation is complete.

    Only a root waits for descendants.
    """
    active = processes.where(F.col("status").isin(*RUNNING)).groupBy("execution").agg(F.count(F.lit(1)).alias("active"))
    below = executions.where((F.col("root") != F.col("execution")) & ~F.col("status").isin(*ENDED)).groupBy(F.col("root").alias("execution")).agg(F.count(F.lit(1)).alias("descendants"))
    held = executions.where("status = 'cancelling'").join(active, "execution", "left").join(below, "execution", "left").na.fill(0, ["active", "descendants"])
    return held.select("execution", "root", "active", "descendants", ((F.col("active") == 0) & ((F.col("root") != F.col("execution")) | (F.col("descendants") == 0))).alias("converged"))


def readiness(prompts: DataFrame, models: DataFrame, bindings: DataFrame, expected: list[str]) -> DataFrame:
    """One row: what is registered, what lacks, and whether it is enough: all prompts, two active models, every needed capability bound."""
    one = prompts.agg(F.collect_set(F.when(F.col("prompt").isin(expected), F.col("prompt"))).alias("p"))  # as many as expected, at most
    two = models.agg(F.count_if(F.col("status") == "active").alias("models"))
    three = bindings.where("enabled").agg(F.collect_set(F.when(F.col("capability").isin(*NEEDED), F.col("capability"))).alias("c"))
    row = one.crossJoin(two).crossJoin(three)  # one row each
    lacking = F.array_sort(F.concat(F.array_except(F.array(*map(F.lit, expected)), "p"), F.array_except(F.array(*map(F.lit, NEEDED)), "c")))
    return row.select("models", F.array_join(lacking, ",").alias("lacking"), ((F.size(lacking) == 0) & (F.col("models") >= 2)).alias("ready"))


def member_outcome(required: Column, status: Column) -> Column:
    """Label of a member: skipped unless required, its child's end, else active."""
    return F.when(~required, "skipped").when(status.isin(*ENDED), status).otherwise("active")


def retry_class(code: Column) -> Column:
    return F.when(F.coalesce(code.isin(*RECOVERABLE), F.lit(False)), "retryable").otherwise("failed")


def moved(rows: DataFrame, moves: list[tuple[str, str, str]]) -> DataFrame:
    """Rows (status, action, row_revision, expected_revision) with what follows: the next status, stale, or invalid."""
    table = rows.sparkSession.createDataFrame(moves, "status string, action string, _next string")
    out = rows.join(table, ["status", "action"], "left")
    state = F.when(F.col("row_revision") != F.col("expected_revision"), "stale").when(F.col("_next").isNull(), "invalid").otherwise("moved")
    return out.withColumn("state", state).withColumn("next", F.when(F.col("state") == "moved", F.col("_next"))).drop("_next")


def single_candidates(sets: DataFrame) -> DataFrame:
    """Producers with more than one candidate set that isn't abandoned: each may have one."""
    return sets.where("status <> 'abandoned'").groupBy("producer").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("first")).where("n > 1")


def retried(requests: DataFrame, tasks: DataFrame, restarts: DataFrame) -> DataFrame:
    """Retry requests (task, fingerprint): a known fingerprint replays its restart; an active or succeeded task refuses; else a new generation."""
    known = restarts.select("task", "fingerprint", F.col("restart").alias("_restart")).dropDuplicates(["task", "fingerprint"])
    out = requests.join(tasks.select("task", "status", "generation"), "task", "left").join(known, ["task", "fingerprint"], "left")
    state = F.when(F.col("_restart").isNotNull(), "replay").when(F.col("status").isNull(), "missing").when(F.col("status") == "succeeded", "succeeded").when(~F.col("status").isin(*ENDED), "active").otherwise("restarted")
    return out.select("task", "fingerprint", state.alias("state"), F.when(state == "restarted", F.col("generation") + 1).alias("generation"))


def rebuild_sources(rebuilds: DataFrame, snapshots: DataFrame, executions: DataFrame) -> DataFrame:
    """Rebuilds with the task and generation that once made their target: snapshot to execution to task; a missing link is an error."""
    out = rebuilds.join(snapshots.select("snapshot", F.col("execution").alias("_e")), "snapshot", "left").join(executions.select(F.col("execution").alias("_e"), "task", "generation"), "_e", "left")
    return out.select("rebuild", "snapshot", "task", "generation", F.when(F.col("_e").isNull(), "no_producer").when(F.col("task").isNull(), "no_task").otherwise("linked").alias("state"))


def control_entries(steps: DataFrame, gates: DataFrame, children: DataFrame) -> DataFrame:
    """What a control step does: a human gate opens if the execution has no open one and its review admission and evidence stand; a join passes when all required children ended (any mode: one succeeded); anything else is an error."""
    open_ = gates.where("status = 'open'").select("execution").distinct().withColumn("_open", F.lit(True))
    c = children.where("required").groupBy("execution").agg(F.bool_and(F.col("status").isin(*ENDED)).alias("_all"), F.bool_or(F.col("status") == "succeeded").alias("_any"))
    out = steps.join(open_, "execution", "left").join(c, "execution", "left")
    human = F.when(F.coalesce("_open", F.lit(False)), "conflict").when((F.col("admission") == "human_review") & F.col("evidence"), "opened").otherwise("refused")
    join = F.when(F.coalesce(F.when(F.col("mode") == "any", F.col("_any")).otherwise(F.col("_all")), F.lit(False)), "joined").otherwise("waiting")
    return out.select("execution", "step", F.when(F.col("step") == "human_gate", human).when(F.col("step") == "scatter_join", join).otherwise("error").alias("state"))


def prompts_selected(requests: DataFrame, defaults: DataFrame, catalogue: DataFrame, fallback: dict[str, str]) -> DataFrame:
    """(request, role, prompt, version, state): the explicit prompt, else the domain's default, else the global one, in its newest active version, if it is registered for the role."""
    wanted = requests.join(defaults.withColumnRenamed("prompt", "_default"), ["domain", "role"], "left")
    usual = F.coalesce(*[F.when(F.col("role") == r, p) for r, p in fallback.items()], F.lit(None).cast("string"))
    wanted = wanted.select("request", "role", F.coalesce("explicit", "_default", usual).alias("prompt"))
    newest = latest(catalogue.where("status = 'active'"), ["prompt"], [F.desc(F.transform(F.split("version", r"\."), lambda x: x.cast("int")))]).select("prompt", "version", F.col("role").alias("_role"))
    out = wanted.join(newest, "prompt", "left")
    state = F.when(F.col("prompt").isNull(), "none").when(F.col("version").isNull(), "not_registered").when(F.col("_role") != F.col("role"), "role_mismatch").otherwise("selected")
    return out.select("request", "role", "prompt", F.when(state == "selected", F.col("version")).alias("version"), state.alias("state"))


def fenced_outcomes(outcomes: DataFrame, leases: DataFrame) -> DataFrame:
    """Outcomes (process, fencing, digest) against the newest lease and the recorded end: accepted, stale (an older fence), replay or conflict."""
    newest = leases.groupBy("process").agg(F.max("fencing").alias("_now"), F.max_by("ended", "fencing").alias("_ended"))
    out = outcomes.join(newest, "process", "left")
    state = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("fencing") < F.col("_now"), "stale").when(F.col("_ended").isNull(), "accepted")
        .when(F.col("_ended") == F.col("digest"), "replay").otherwise("conflict")
    )
    return out.select("process", "fencing", "digest", state.alias("state"))


def steps_match(declared: DataFrame, persisted: DataFrame) -> DataFrame:
    """Steps that only one of two sets has, with the side that has them."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(declared, persisted, "declared").unionByName(only(persisted, declared, "persisted"))


def layer_counts_valid(counts: Column) -> Column:
    """Whether a map of layer to count has only numbers as keys and no negative or null count."""
    return F.coalesce(F.forall(F.map_entries(counts), lambda e: F.regexp_like(e["key"], F.lit(r"^[0-9]+$")) & F.coalesce(e["value"] >= 0, F.lit(False))), F.lit(False))


ENDED, ACTIVE = ("succeeded", "failed", "cancelled"), RUNNING


def repair_actions(executions: DataFrame, processes: DataFrame, gates: DataFrame, decisions: DataFrame, outbox: DataFrame, now: Column) -> DataFrame:
    """(team, action, id, dedupe_key): what a repair sweep has to do, from the ledgers as they stand.

    executions (team, execution, status, manifest), processes (team, execution, process, ordinal, status, fence, lease_until, available_at, attempts, most),
    gates (gate, execution, gate_status), decisions (team, gate, decision, verdict), outbox (team, dedupe_key, status). Actions: redeliver_decision
    (decided as the gate stands, no open message), cancel_tree, wake_process (ready, its execution alive), wake_execution (created or ready
    without an active process), repair_transition (its last process ended and no decision explains it), promote_retry, recover_lease or fail_lease.
    Waking messages are sent once for good: any message under their key counts. Ledgers of an execution meet in one shuffle by it; messages in one by their key.
    """
    at = ["team", "execution"]
    last = processes.groupBy(*at).agg(F.bool_or(F.col("status").isin(*ACTIVE)).alias("_active"), F.max_by("status", F.struct("ordinal", "process", "status")).alias("_last"))
    decided = decisions.join(gates, "gate")
    settled_ = decided.select("execution").distinct().withColumn("_decided", F.lit(True))
    alive = ~F.col("status").isin(*ENDED, "cancelling")
    e = executions.join(last, at, "left").join(settled_, "execution", "left")

    def asked(df: DataFrame, where: Column, action: str | Column, id_: str, key: Column | None = None) -> DataFrame:
        return df.where(where).select("team", (F.lit(action) if isinstance(action, str) else action).alias("action"), F.col(id_).cast("long").alias("id"), (F.lit(None).cast("string") if key is None else key).alias("dedupe_key"))

    key = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *[F.col(p).cast("string") for p in parts])
    p = processes.join(executions.select(*at, F.col("status").alias("_execution")), at)
    over = (F.col("status") == "running") & (F.col("lease_until") < now)
    agreed = ((F.col("verdict") == "approve") & (F.col("gate_status") == "released")) | ((F.col("verdict") == "reject") & (F.col("gate_status") == "rejected"))
    waking = asked(p, (F.col("status") == "ready") & ~F.col("_execution").isin(*ENDED, "cancelling"), "wake_process", "process", key("repair-wake-process", "process", "fence")).unionByName(
        asked(e, F.col("status").isin("created", "ready") & ~F.coalesce("_active", F.lit(False)), "wake_execution", "execution", key("repair-wake-execution", "execution", "manifest"))
    )
    waking = waking.join(outbox.select("team", "dedupe_key").distinct(), ["team", "dedupe_key"], "left_anti")
    open_ = outbox.where("status in ('pending', 'in_flight')").select("team", F.regexp_replace("dedupe_key", "^repair-", "").alias("_k")).distinct()
    again = asked(decided, agreed, "redeliver_decision", "decision", key("repair-gate-decision", "decision")).withColumn("_k", F.regexp_replace("dedupe_key", "^repair-", "")).join(open_, ["team", "_k"], "left_anti").drop("_k")
    rest = asked(e, F.col("status") == "cancelling", "cancel_tree", "execution").unionByName(
        asked(e, alive & (F.col("status") != "waiting") & F.col("_last").isin(*ENDED) & F.col("_decided").isNull(), "repair_transition", "execution")
    ).unionByName(asked(processes, (F.col("status") == "retry_wait") & (F.col("available_at") <= now), "promote_retry", "process")).unionByName(
        asked(processes, over, F.when(F.col("attempts") < F.col("most"), "recover_lease").otherwise("fail_lease"), "process")
    )
    columns = ("team", "action", "id", "dedupe_key")
    return rest.select(*columns).unionByName(waking.select(*columns)).unionByName(again.select(*columns))


def claimable(processes: DataFrame, executions: DataFrame, now: Column, free: dict[str, bool]) -> DataFrame:
    """The next process that each team may claim: admitted, ready and available, of an execution that is ready or running.

    Embeddings are a lane of their own, first come first served; the other lane goes by rank (high first), then time, deadline (none last) and id, and
    leaves out pools without a free slot. Of the two lanes' firsts the earlier one is taken, the embedding on a tie.
    """
    live = executions.where(F.col("status").isin("ready", "running")).select("team", "execution")
    ready = processes.where((F.col("status") == "ready") & F.col("admitted") & (F.col("available_at") <= now)).join(live, ["team", "execution"], "left_semi")
    runs = F.col("pool").isNull() | (F.col("pool") == "embed")
    for pool, slot in free.items():
        runs = runs | ((F.col("pool") == pool) & F.lit(slot))
    lane = F.coalesce(F.col("pool") == "embed", F.lit(False))
    time = ["available_at", "created_at", "process"]
    w = Window.partitionBy("team", lane)
    embed = F.row_number().over(w.orderBy(*time))
    other = F.row_number().over(w.orderBy(F.desc("rank"), "available_at", F.asc_nulls_last("deadline_at"), "created_at", "process"))
    firsts = ready.where(runs).withColumn("_n", F.when(lane, embed).otherwise(other)).where("_n = 1")
    return latest(firsts, ["team"], [F.asc(c) for c in time]).select("team", "process", "pool")


def rfc3339(value: Column) -> Column:
    """A timestamp with a time zone in UTC with microseconds; null if it has none or can't be read."""
    zoned = F.regexp_like(value, F.lit(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?(?:Z|[+-]\d\d:\d\d)$"))
    return F.when(zoned, F.date_format(F.convert_timezone(F.expr("current_timezone()"), F.lit("UTC"), F.try_to_timestamp(value).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def uuid7(df: DataFrame, millis: str, *order: str, name: str = "uuid") -> DataFrame:
    """Time-ordered identifiers: 48 bits of milliseconds, version, 30 bits that count the rows of a millisecond in ``order`` around the variant, and 44 random bits from the row's digest.

    Identifiers ascend strictly with (millis, order), up to a thousand million rows of one millisecond; the count goes on across
    partitions, so that a millisecond of any number of rows is no task of its own.
    """
    rows = numbered(df, millis, *order, name="_n").withColumn("_seed", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    digits = lambda c, width: F.lpad(F.lower(F.hex(c)), width, "0")
    n = F.col("_n")
    variant = F.get(F.array(*map(F.lit, "89ab")), F.shiftright(n, 16).bitwiseAND(3).cast("int"))
    hexed = F.concat(digits(F.col(millis), 12), F.lit("7"), digits(F.shiftright(n, 18).bitwiseAND(0xFFF), 3), variant, digits(n.bitwiseAND(0xFFFF), 4), F.substring("_seed", 1, 11))
    return rows.withColumn(name, F.regexp_replace(hexed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).drop("_n", "_seed")


def advanced(held: DataFrame, seen: DataFrame) -> DataFrame:
    """(team, high_water, advanced): stored marks (team, mark) moved up to the highest sequence seen (team, sequence), never down; teams of either side."""
    last = seen.groupBy("team").agg(F.max("sequence").alias("_last"))
    both = held.join(last, "team", "full_outer")
    mark, new = F.coalesce("mark", F.lit(0).cast("long")), F.coalesce("_last", F.lit(0).cast("long"))
    return both.select("team", F.greatest(mark, new).alias("high_water"), (new > mark).alias("advanced"))


def fingerprint(secret: Column) -> Column:
    """What stands for a secret where it must not be shown; none for an empty one."""
    return F.when(secret != "", F.sha2(secret, 256))


def pattern_checks(df: DataFrame) -> DataFrame:
    """Rows (digest, path) with whether the digest is 64 lower-case hex digits and the path is relative without parent steps."""
    path = F.col("path")
    return df.withColumn("digest_ok", F.regexp_like("digest", F.lit("^[0-9a-f]{64}$"))).withColumn("path_ok", (path != "") & ~F.startswith(path, F.lit("/")) & ~F.regexp_like(path, F.lit(r"(^|/)\.\.(/|$)")))


def within_grace(age_minutes: Column, kind: Column) -> Column:
    """Whether something is too young to be cleaned up: objects a day, generations an hour, cleanups a minute."""
    return age_minutes < F.when(kind == "object", 24 * 60).when(kind == "generation", 60).when(kind == "cleanup", 1)


def handler_for(df: DataFrame, column: str, handlers: dict[str, str]) -> DataFrame:
    """Rows with the handler registered for the longest dotted prefix of their key; null if there is none."""
    if bad := [k for k in handlers if not re.fullmatch(r"[a-z0-9_]+(\.[a-z0-9_]+)*", k)]:
        raise ValueError(f"not keys: {bad}")
    found = F.coalesce(*[F.when((F.col(column) == k) | F.startswith(F.col(column), F.lit(f"{k}.")), v) for k, v in sorted(handlers.items(), key=lambda x: -len(x[0]))], F.lit(None).cast("string"))
    return df.withColumn("handler", found)


