"""Queries of publication, retirement, objects, references and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import json_text
from lamella.operators import cutover, fence, folds, ledger, publish, workflow
from lamella.plans.base import Listing
from lamella.sources import ledgers
from lamella.sources.tables import table

listing = Listing()
queries, oracle_sql = listing.queries, listing.oracle_sql
CTE = ledgers.CTE


CONTENT = "concat_ws(':', item, unit, channel)"


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the digests of their content and of their vector, which every fourth lacks."""
    return ledgers.records(spark, sf_dir).withColumn("content_digest", F.sha2(F.expr(CONTENT), 256)).withColumn("embedding_digest", F.when(F.col("vec_id") % 4 != 3, F.sha2(F.col("vec_id").cast("string"), 256)))


PAIRS = """'[' || string_agg('["' || vec_id || '","' || sha256(""" + CONTENT + """) || '"]', ',' ORDER BY vec_id::VARCHAR) || ']'"""


@listing.add(f"WITH {CTE} SELECT item, namespace, generation, sha256({PAIRS}) AS digest, count(*) AS members FROM records WHERE state = 'indexed' GROUP BY item, namespace, generation")
def publication_set_digest(spark, sf_dir):
    """Digest of each publication's members, whatever their order: of the canonical JSON of the sorted pairs of id and content digest."""
    return cutover.proven(contents(spark, sf_dir).where("state = 'indexed'"))


@listing.add(f"""WITH {CTE} SELECT item, generation, sha256('[' || string_agg('["' || vec_id || '","' || sha256({CONTENT}) || '","' || CASE WHEN vec_id % 4 <> 3 THEN sha256(vec_id::VARCHAR) ELSE '' END || '","' || unit || '","' || channel || '","' || model_key || '","' || model_version || '","' || adapter || '",' || dimension || ']', ',' ORDER BY unit::VARCHAR, channel, vec_id::VARCHAR) || ']') AS digest, count(*) AS members
FROM records GROUP BY item, generation""")
def rebuild_integrity(spark, sf_dir):
    """Digest of each generation's records in their order, nine fields each: id, content and vector digest, unit, channel, model key and version, adapter and dimension."""
    text = lambda c: json_text(F.coalesce(F.col(c).cast("string"), F.lit("")))
    fields = [text(c) for c in ("vec_id", "content_digest", "embedding_digest", "unit", "channel", "model_key", "model_version", "adapter")]
    row = F.concat(F.lit("["), F.concat_ws(",", *fields, F.col("dimension").cast("string")), F.lit("]"))
    return folds.ordered_digest(contents(spark, sf_dir), ["item", "generation"], [F.col("unit").cast("string"), F.col("channel"), F.col("vec_id").cast("string")], row)


@listing.add("SELECT l_orderkey, sha256(string_agg(l_linenumber || '=' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey)) AS root_digest FROM lineitem GROUP BY l_orderkey")
def member_root_digest(spark, sf_dir):
    """Digest of each execution's members in their order."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    return rows.select("l_orderkey", F.sha2(F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), "\n"), 256).alias("root_digest"))


@listing.add(f"WITH {CTE} SELECT namespace, generation, channel, count(*) AS n, min(vec_id) AS first_vec, max(vec_id) AS last_vec FROM records GROUP BY ALL")
def vector_stats(spark, sf_dir):
    """Counts and bounds of each generation's channels."""
    return ledgers.records(spark, sf_dir).groupBy("namespace", "generation", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_vec"), F.max("vec_id").alias("last_vec"))


@listing.add(f"WITH {CTE} SELECT DISTINCT r.item, r.namespace, r.generation, p.active_generation FROM records r JOIN pointers p ON r.item = p.item AND r.namespace = p.namespace AND r.generation < p.active_generation")
def retired_generations(spark, sf_dir):
    """Generations behind the active pointer."""
    return publish.withdrawn_older(ledgers.records(spark, sf_dir), ledgers.pointers(spark, sf_dir)).select("item", "namespace", "generation", "active_generation")


@listing.add(f"""WITH {CTE}, old AS (SELECT DISTINCT r.item, r.namespace, r.generation, p.minutes FROM records r JOIN pointers p ON r.item = p.item AND r.namespace = p.namespace AND r.generation < p.active_generation)
SELECT item, namespace, generation, CASE WHEN item IN (SELECT item FROM items WHERE lifecycle <> 'active' OR item_deleted_at IS NOT NULL) THEN 'deferred' WHEN minutes < 60 THEN 'waiting' ELSE 'due' END AS state FROM old""")
def retirement_due(spark, sf_dir):
    """Retired generations: deferred while their item isn't active, waiting while the pointer moved within the grace of an hour, else due."""
    old = publish.withdrawn_older(ledgers.records(spark, sf_dir), ledgers.pointers(spark, sf_dir), "minutes")
    held = ledgers.items(spark, sf_dir).where("lifecycle <> 'active' or item_deleted_at is not null").select("item", F.lit(True).alias("held"))
    return publish.retirement(old.join(held, "item", "left"), F.coalesce("held", F.lit(False)), F.col("minutes")).select("item", "namespace", "generation", "state")


@listing.add(f"""WITH {CTE}, t AS (SELECT r.item, r.namespace, r.generation, count(*) AS planned, count(*) FILTER (WHERE state = 'indexed') AS affected FROM records r JOIN pointers p ON r.item = p.item AND r.namespace = p.namespace
WHERE r.generation < p.active_generation GROUP BY ALL) SELECT *, planned = affected AS exact FROM t""")
def purge_plan(spark, sf_dir):
    """Records a purge plans to delete against those it would affect."""
    r, p = ledgers.records(spark, sf_dir), ledgers.pointers(spark, sf_dir)
    t = r.join(p.select("item", "namespace", "active_generation"), ["item", "namespace"]).where("generation < active_generation").groupBy("item", "namespace", "generation")
    return t.agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("state") == "indexed").alias("affected")).withColumn("exact", F.col("planned") == F.col("affected"))


@listing.add(f"""WITH {CTE} SELECT r.vec_id, r.item, r.namespace, r.generation + 1 AS generation, r.channel, r.unit FROM records r JOIN pointers p ON r.item = p.item AND r.namespace = p.namespace AND r.generation = p.active_generation
JOIN items i ON r.item = i.item WHERE p.pointer_state = 'active' AND r.state = 'indexed' AND i.lifecycle = 'active'""")
def rebuild_plan(spark, sf_dir):
    """The records of the next generation, cloned from active ones."""
    r = ledgers.records(spark, sf_dir).where("state = 'indexed'").join(ledgers.pointers(spark, sf_dir).where("pointer_state = 'active'").select("item", "namespace", "active_generation"), ["item", "namespace"]).where("generation = active_generation")
    live = r.join(ledgers.items(spark, sf_dir).where("lifecycle = 'active'").select("item"), "item", "left_semi")
    return publish.cloned(live).select("vec_id", "item", "namespace", "generation", "channel", "unit")


@listing.add(f"""WITH {CTE} SELECT p.item, p.namespace, p.active_generation, p.pointer_state, s.source_kind FROM pointers p LEFT JOIN items i ON p.item = i.item LEFT JOIN sources s ON i.team = s.team AND i.source = s.source""")
def pointer_listing(spark, sf_dir):
    """Pointers with the items they belong to, if known."""
    known = ledgers.items(spark, sf_dir).join(ledgers.sources(spark), ["team", "source"], "left").select("item", "source_kind")
    return ledgers.pointers(spark, sf_dir).join(known, "item", "left").select("item", "namespace", "active_generation", "pointer_state", "source_kind")


@listing.add(f"""WITH {CTE} SELECT g.artifact, count(m.member) AS n_members, count(*) FILTER (WHERE m.disposition = 'full_valid') AS n_valid,
  count(DISTINCT m.member) = {len(ledgers.MEMBERS)} AND bool_and(coalesce(m.disposition = 'full_valid', false)) AND bool_and(g.validation = 'full_valid') AS admitted
FROM generations g LEFT JOIN members m USING (artifact) GROUP BY g.artifact""")
def generation_gate(spark, sf_dir):
    """Generations whose own verdict and all six members are fully valid."""
    return publish.gate(ledgers.generations(spark, sf_dir), ledgers.members(spark, sf_dir), ledgers.MEMBERS)


@listing.add(f"WITH {CTE} SELECT p.item, p.namespace, g.artifact, g.handle, g.validation FROM pointers p JOIN generations g ON p.team = g.team AND p.artifact = g.artifact WHERE p.pointer_state = 'active'")
def current_generations(spark, sf_dir):
    """The generation that each active pointer serves."""
    p = ledgers.pointers(spark, sf_dir).where("pointer_state = 'active'").select("team", "artifact", "item", "namespace")
    return p.join(ledgers.generations(spark, sf_dir).select("team", "artifact", "handle", "validation"), ["team", "artifact"]).select("item", "namespace", "artifact", "handle", "validation")


@listing.add(f"WITH {CTE} SELECT r.vec_id, r.vec_id + 1000000000 AS new_vec, r.channel, r.unit FROM records r JOIN pointers p ON r.item = p.item AND r.namespace = p.namespace AND r.generation = p.active_generation WHERE r.state = 'indexed'")
def facet_copy(spark, sf_dir):
    """Facets of active records under the ids that a rebuild gives them."""
    r = ledgers.records(spark, sf_dir).where("state = 'indexed'").join(ledgers.pointers(spark, sf_dir).select("item", "namespace", "active_generation"), ["item", "namespace"]).where("generation = active_generation")
    mapping = r.select("vec_id", (F.col("vec_id") + 1_000_000_000).alias("new_vec"))
    facets = ledgers.records(spark, sf_dir).select("vec_id", "channel", "unit")
    return publish.copied(facets, mapping).select("vec_id", "new_vec", "channel", "unit")


@listing.add(f"WITH {CTE} SELECT DISTINCT f.proof, f.expected_count, f.actual_count, f.matched_count FROM proofs f WHERE NOT (f.expected_count = f.actual_count AND f.actual_count = f.matched_count)")
def inconsistent_proofs(spark, sf_dir):
    """Proofs whose three counts don't agree."""
    p = ledgers.proofs(spark, sf_dir)
    return p.where(~fence.counts_consistent(F.col("expected_count"), F.col("actual_count"), F.col("matched_count"))).select("proof", "expected_count", "actual_count", "matched_count").distinct()


OBJECTS = "objects AS (SELECT doc_id AS object_id, sha256(text) AS digest, strlen(text) AS size_bytes, doc_id % 5 AS team FROM documents)"


def objects(spark: SparkSession, sf_dir: str, teams: int = 5) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("object_id"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size_bytes"), (F.col("doc_id") % teams).alias("team"))


@listing.add(f"WITH {OBJECTS} SELECT object_id, digest, size_bytes FROM objects ANTI JOIN (SELECT doc_id AS object_id FROM labels) USING (object_id)")
def orphan_objects(spark, sf_dir):
    """Objects that no label refers to."""
    refs = table(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "object_id")
    return ledger.orphans(objects(spark, sf_dir), refs, "object_id").select("object_id", "digest", "size_bytes")


#: Open cleanup intents by event: what they hold, spelled in one of six ways at some depth of a JSON list, in a target or in a snapshot reference.
#: Those whose props name a number below three are cut off in writing, or no list, and so hold their whole team.
INTENT = {"event_id": "event_id", "team": "user_id % 40", "named": "event_id % 997"}
NAME = "CASE k % 7 WHEN 0 THEN concat(named, '') WHEN 1 THEN coalesce(digest, 'gone') WHEN 2 THEN concat('handle/', coalesce(digest, 'gone')) WHEN 3 THEN concat('stored_object:', named) WHEN 4 THEN concat('object:', named) WHEN 5 THEN concat('sha256:', coalesce(digest, 'gone')) ELSE concat('other:', named) END"
REFS = """CASE WHEN k < 2 THEN concat('["', name) WHEN k = 2 THEN concat('{"a": "', name, '"}') WHEN k % 5 = 0 THEN concat('["', name, '"]') WHEN k % 5 = 1 THEN concat('[["x", {"a": [1, {"b": "', name, '"}]}]]') WHEN k % 5 = 2 THEN concat('[null, {"', name, '": "key only"}]') ELSE '[]' END"""
OBJECTS_40 = OBJECTS.replace("doc_id % 5 AS team", "doc_id % 40 AS team")


@listing.add(f"""WITH {OBJECTS_40}, intents AS (SELECT {", ".join(f"{v} AS {k}" for k, v in INTENT.items())}, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_type = 'signup'),
spelled AS (SELECT i.team, k, {NAME} AS name FROM intents i LEFT JOIN objects o ON o.object_id = i.named),
broken AS (SELECT DISTINCT team FROM spelled WHERE k <= 2), names AS (SELECT DISTINCT team, name FROM spelled WHERE k % 5 <> 2 AND k > 2)
SELECT object_id, digest, CASE WHEN o.team IN (SELECT team FROM broken) THEN 'team_blocked' WHEN EXISTS (SELECT 1 FROM names n WHERE n.team = o.team AND n.name IN (o.object_id::VARCHAR, o.digest, 'handle/' || o.digest, 'stored_object:' || o.object_id, 'object:' || o.object_id, 'sha256:' || o.digest)) THEN 'held' ELSE 'free' END AS state FROM objects o""")
def held_objects(spark, sf_dir):
    """Objects by whether open intents hold them: named in a list of any depth, a target or a snapshot, in one of six spellings; a list that can't be read, or isn't one, blocks its whole team."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").where("event_type = 'signup'")
    e = e.selectExpr(*[f"{v} AS {k}" for k, v in INTENT.items()], "CAST(get_json_object(props, '$.k') AS INT) AS k")
    o = objects(spark, sf_dir, 40)
    named = e.join(o.select(F.col("object_id").alias("named"), "digest"), "named", "left").withColumn("name", F.expr(NAME))
    intents = named.select("team", F.expr(REFS).alias("refs"), F.when(F.col("k") % 5 == 3, F.col("name")).alias("target"), F.when(F.col("k") % 5 == 4, F.col("name")).alias("snapshot"))
    return publish.holds(o, intents).select("object_id", "digest", "state")


@listing.add(f"WITH {OBJECTS} SELECT team, digest, count(*) AS n, min(object_id) AS first_object FROM objects GROUP BY team, digest HAVING count(*) > 1")
def duplicate_objects(spark, sf_dir):
    """Digests that a team's catalogue holds more than once."""
    return objects(spark, sf_dir).groupBy("team", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("object_id").alias("first_object")).where("n > 1")


@listing.add("SELECT d.source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents d GROUP BY d.source")
def collection_bytes(spark, sf_dir):
    """Members and bytes of each collection at its seal."""
    return table(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@listing.add("""SELECT d.doc_id, 'lang=' || d.lang || ';quality=' || coalesce(l.quality::VARCHAR, 'none') || ';source=' || CASE WHEN l.toxic = 1 THEN 'flagged' ELSE d.source END AS merged
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def metadata_merge(spark, sf_dir):
    """Base metadata overwritten by labels."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    base = F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("quality"), F.lit("none")), lambda k, v: v.isNotNull())
    over = F.map_filter(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("source"), F.when(F.col("toxic") == 1, "flagged")), lambda k, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    merged = F.array_sort(F.map_entries(F.map_concat(kept, over)))
    return d.join(lab, "doc_id", "left").select("doc_id", F.array_join(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("merged"))


@listing.add("SELECT doc_id, sha256('lang=' || lang || chr(10) || 'source=' || source) AS fingerprint FROM documents")
def semantic_fingerprint(spark, sf_dir):
    """Digest of the metadata entries that take part, sorted by key."""
    entries = F.array_sort(F.array(F.concat(F.lit("source="), "source"), F.concat(F.lit("lang="), "lang")))
    return table(spark, sf_dir, "documents", "doc_id", "lang", "source").select("doc_id", F.sha2(F.array_join(entries, "\n"), 256).alias("fingerprint"))


@listing.add("SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY source")
def pivot_facets(spark, sf_dir):
    """Languages of each source as columns."""
    return table(spark, sf_dir, "documents", "source", "lang").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1))).na.fill(0)


@listing.add(f"""WITH {CTE}, a AS (SELECT unnest(['deactivate', 'reactivate', 'delete', 'restore']) AS action)
SELECT lifecycle, action, CASE lifecycle || ':' || action WHEN 'active:deactivate' THEN 'deactivated' WHEN 'deactivated:reactivate' THEN 'active' WHEN 'active:delete' THEN 'deleted' WHEN 'deactivated:delete' THEN 'deleted' WHEN 'deleted:restore' THEN 'deactivated' END AS next, count(*) AS n
FROM items, a GROUP BY ALL""")
def lifecycle_transition(spark, sf_dir):
    """What each action makes of the items, where it is legal."""
    moves = [("active", "deactivate", "deactivated"), ("deactivated", "reactivate", "active"), ("active", "delete", "deleted"), ("deactivated", "delete", "deleted"), ("deleted", "restore", "deactivated")]
    counts = ledgers.items(spark, sf_dir).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))
    asked = counts.withColumn("action", F.explode(F.array(*[F.lit(a) for a in ("deactivate", "reactivate", "delete", "restore")])))
    return asked.join(spark.createDataFrame(moves, "lifecycle string, action string, next string"), ["lifecycle", "action"], "left").select("lifecycle", "action", "next", "n")


@listing.add("""WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
c AS (SELECT d.doc_id, 'mode=' || CASE WHEN source IS NULL THEN 'exact' ELSE lang END || ';recall_k=' || least(coalesce(CASE WHEN n_chars % 3 = 0 THEN n_chars END, CASE WHEN quality = 1 THEN 40 END, 20), 100) || ';return_k=' || least(coalesce(CASE WHEN quality = 0 THEN 5 END, 10), 50) AS config FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id)
SELECT doc_id, config, sha256(config) AS digest FROM c""")
def config_layers(spark, sf_dir):
    """Defaults under runtime settings (by label) under a request's overrides, capped, and frozen into one digest."""
    q = table(spark, sf_dir, "labels", "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").join(q, "doc_id", "left")
    value = lambda c: c.cast("string")
    defaults = {"recall_k": "20", "return_k": "10", "mode": "exact"}
    runtime = {"recall_k": F.when(F.col("quality") == 1, F.lit("40")), "return_k": F.when(F.col("quality") == 0, F.lit("5")), "mode": F.when(F.col("source").isNotNull(), F.col("lang"))}
    request = {"recall_k": F.when(F.col("n_chars") % 3 == 0, value(F.col("n_chars")))}
    frozen = ledger.frozen_config(defaults, [runtime, request], {"recall_k": 100, "return_k": 50})
    return d.select("doc_id", frozen.alias("config"), F.sha2(frozen, 256).alias("digest"))


@listing.add("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'rejected' WHEN n_chars > 5000 THEN 'human_review' ELSE 'auto' END AS admission FROM documents")
def preflight_admission(spark, sf_dir):
    """Texts by how they are admitted: empty ones never, long ones after a review."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return d.select("doc_id", F.when(F.col("text").isNull() | (F.trim("text") == ""), "rejected").when(F.col("n_chars") > 5000, "human_review").otherwise("auto").alias("admission"))


@listing.add("""WITH r AS (SELECT o_custkey AS team, o_orderkey % 50 AS key, o_orderkey, o_orderkey % 3 AS fingerprint FROM orders), f AS (SELECT team, key, min(o_orderkey) AS first_key, arg_min(fingerprint, o_orderkey) AS held FROM r GROUP BY team, key)
SELECT r.o_orderkey, CASE WHEN r.o_orderkey = first_key THEN 'created' WHEN fingerprint = held THEN 'replay' ELSE 'conflict' END AS verdict FROM r JOIN f ON r.team = f.team AND r.key = f.key""")
def idempotent_create(spark, sf_dir):
    """Requests that create, repeat or contradict what their key stands for."""
    r = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("team"), (F.col("o_orderkey") % 50).alias("key"), "o_orderkey", (F.col("o_orderkey") % 3).alias("fingerprint"))
    f = r.groupBy("team", "key").agg(F.min("o_orderkey").alias("first_key"), F.min_by("fingerprint", "o_orderkey").alias("held"))
    return r.join(f, ["team", "key"]).select("o_orderkey", F.when(F.col("o_orderkey") == F.col("first_key"), "created").when(F.col("fingerprint") == F.col("held"), "replay").otherwise("conflict").alias("verdict"))


@listing.add("""WITH g AS (SELECT o_orderkey AS gate, o_orderkey % 3 AS revision, o_orderstatus = 'P' AS cancelled FROM orders),
d AS (SELECT l_orderkey AS gate, l_linenumber % 3 AS revision, CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'approved' END AS decision, l_shipdate AS decided_at, l_linenumber AS id FROM lineitem),
f AS (SELECT gate, revision, arg_min(decision, (decided_at, id)) AS decision FROM d GROUP BY gate, revision), s AS (SELECT gate, count(*) AS n FROM d GROUP BY gate)
SELECT g.gate, CASE WHEN cancelled THEN 'cancelled' WHEN f.decision IS NOT NULL THEN f.decision WHEN s.n IS NOT NULL THEN 'stale' ELSE 'open' END AS state FROM g LEFT JOIN f ON g.gate = f.gate AND g.revision = f.revision LEFT JOIN s ON g.gate = s.gate""")
def gate_decisions(spark, sf_dir):
    """Gates by the first decision on their current revision: one on another revision is stale, and a cancellation wins. Of decisions alike in time and number, the one that stands first in the table counts."""
    gates = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").selectExpr("o_orderkey AS gate", "o_orderkey % 3 AS revision", "o_orderstatus = 'P' AS cancelled")
    decisions = table(spark, sf_dir, "lineitem").selectExpr("struct(_metadata.file_path, _metadata.row_index) AS place", "l_orderkey AS gate", "l_linenumber % 3 AS revision", "CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'approved' END AS decision", "l_shipdate AS decided_at", "l_linenumber AS id")
    return workflow.gate_states(gates, decisions)
