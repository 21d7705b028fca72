"""Rebuild, cutover and retirement of index generations over a versioned store: each is one commit, and what it rests on is read again first.

Tables of the store: ``records`` (vec_id, item, namespace, generation, channel, unit, content_digest, state, deleted_at), ``facets``
(vec_id, facet, value), ``proofs`` (item, namespace, generation, members, digest), ``pointers`` (item, namespace, active_generation,
pointer_state) and ``intents`` (item, namespace, generation, due_at, state). Times are numbers of the caller's clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import json_text
from lamella.operators.folds import ordered_digest
from lamella.sources.shared import settled
from lamella.sources.versions import SEEN, VERSION, Store

KEYS = {"records": ("vec_id",), "facets": ("vec_id", "facet"), "proofs": ("item", "namespace", "generation"), "pointers": ("item", "namespace"), "intents": ("item", "namespace", "generation")}
GENERATION = ["item", "namespace", "generation"]
#: How much later than the cutover the generation left behind is due to go.
GRACE = 60


def store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, KEYS)


def pair(vec: str = "vec_id", digest: str = "content_digest") -> Column:
    """A record as a JSON pair of its id and content digest, both texts."""
    return F.concat(F.lit("["), json_text(F.col(vec).cast("string")), F.lit(","), json_text(F.col(digest)), F.lit("]"))


def proven(records: DataFrame) -> DataFrame:
    """(item, namespace, generation, digest, members): the digest of the canonical JSON of each generation's pairs, sorted as texts."""
    return ordered_digest(records, GENERATION, [F.col("vec_id").cast("string"), F.col("content_digest")], pair())


def live(records: DataFrame) -> DataFrame:
    return records.where("state = 'indexed' and deleted_at is null")


def _crash(_: str) -> None:
    """Called between steps; tests raise here."""


def rebuild(s: Store, now: int, new_id: Column | None = None, grace: int = GRACE, between: Callable[[str], None] = _crash) -> int:
    """Give every active pointer whose generation still matches its proof a next generation, and move all of it over in one commit.

    1. From one snapshot: live records of active pointers; generations whose count or digest isn't that of their proof stay as they are.
    2. Clones of their records and facets under new ids are written and read again, and the new proof is made from what was read.
    3. A generation whose new proof doesn't count as many members as its old one isn't moved.
    4. Records, facets, proofs, pointers and the retirement intents, with their deadline frozen, become visible by one log file.
    A crash at any point before 4 leaves what was served before; a pointer or record changed meanwhile is a Conflict. Returns the version.
    """
    v = s.version()
    records, pointers, proofs = live(s.snapshot("records", v)), s.snapshot("pointers", v).where("pointer_state = 'active'"), s.snapshot("proofs", v)
    served = records.join(pointers.select("item", "namespace", F.col("active_generation").alias("generation")), GENERATION, "left_semi")
    sound = settled(proven(served).join(proofs.select(*GENERATION, F.col("digest").alias("_d"), F.col("members").alias("_m")), GENERATION).where("digest = _d and members = _m").select(*GENERATION, "members"), "sound")
    between("planned")
    named = (new_id if new_id is not None else F.col("vec_id") + 1_000_000_000).alias("_new")
    source = served.join(sound.select(*GENERATION), GENERATION, "left_semi")
    mapping = settled(source.select("vec_id", named, *GENERATION, "channel", "unit", "content_digest", "state", "deleted_at"), "mapping")
    clones = settled(mapping.select(F.col("_new").alias("vec_id"), "item", "namespace", (F.col("generation") + 1).alias("generation"), "channel", "unit", "content_digest", "state", "deleted_at"), "clones")
    facets = settled(s.snapshot("facets", v).drop(VERSION).join(mapping.select("vec_id", "_new"), "vec_id").drop("vec_id").withColumnRenamed("_new", "vec_id"), "facets")
    between("cloned")
    again = proven(clones)  # from what was written
    want = sound.select("item", "namespace", (F.col("generation") + 1).alias("generation"), F.col("members").alias("_want"))
    good = settled(again.join(want, GENERATION).where("members = _want").drop("_want"), "proofs")
    between("proven")
    ids = clones.join(good.select(*GENERATION), GENERATION, "left_semi")
    moved = good.select("item", "namespace", (F.col("generation") - 1).alias("_old"))
    seen = pointers.join(moved, ["item", "namespace"]).where("active_generation = _old")
    point = seen.withColumn("active_generation", F.col("_old") + 1).withColumn(SEEN, F.col(VERSION)).drop("_old", VERSION)
    intents = moved.select("item", "namespace", F.col("_old").alias("generation"), F.lit(now + grace).cast("long").alias("due_at"), F.lit("open").alias("state"))
    changes = {
        "records": ids.withColumn(SEEN, F.lit(0).cast("long")), "facets": facets.join(ids.select("vec_id"), "vec_id", "left_semi"), "proofs": good, "pointers": point, "intents": intents,
    }
    return s.commit(changes, v, {"kind": "cutover", "at": now})


def served(s: Store, version: int | None = None) -> DataFrame:
    """The records that active pointers serve at a version."""
    p = s.snapshot("pointers", version).where("pointer_state = 'active'").select("item", "namespace", F.col("active_generation").alias("generation"))
    return live(s.snapshot("records", version)).join(p, GENERATION, "left_semi")


def retire(s: Store, now: int, held: DataFrame | None = None, between: Callable[[str], None] = _crash) -> int | None:
    """Soft-delete the records of intents that are due and close these, in one commit; None if nothing is due.

    The deadline is the one frozen in the intent, whatever the grace is now. Intents of ``held`` items (item) wait, as do those whose
    generation is served again.
    """
    v = s.version()
    intents = s.snapshot("intents", v).where(f"state = 'open' and due_at <= {int(now)}")
    serving = s.snapshot("pointers", v).where("pointer_state = 'active'").select("item", "namespace", F.col("active_generation").alias("generation"))
    due = intents.join(serving, GENERATION, "left_anti")
    if held is not None:
        due = due.join(held.select("item").distinct(), "item", "left_anti")
    due = settled(due, "due")
    if due.isEmpty():
        return None
    between("due")
    gone = s.snapshot("records", v).where("deleted_at is null").join(due.select(*GENERATION), GENERATION, "left_semi")
    gone = gone.withColumn("deleted_at", F.lit(now).cast("long")).withColumn(SEEN, F.col(VERSION)).drop(VERSION)
    return s.commit({"records": gone, "intents": due.withColumn("state", F.lit("retired")).withColumn(SEEN, F.col(VERSION)).drop(VERSION)}, v, {"kind": "retire", "at": now})


def purge(s: Store, before: int, between: Callable[[str], None] = _crash) -> int | None:
    """Delete the records of retired generations, soft-deleted at or before ``before``, with their facets and proofs, in one commit; None if there are none.

    What is planned (every record of a retired generation) must be what would be deleted (its records soft-deleted in time): a generation for
    which these sets differ is left whole, since something else has touched it.
    """
    v = s.version()
    retired = s.snapshot("intents", v).where("state = 'retired'").select(*GENERATION)
    mine = s.snapshot("records", v).join(retired, GENERATION, "left_semi")
    equal = settled(mine.groupBy(*GENERATION).agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.coalesce(F.col("deleted_at") <= before, F.lit(False))).alias("affected")).where("planned = affected"), "equal")
    if equal.isEmpty():
        return None
    between("planned")
    gone = mine.join(equal.select(*GENERATION), GENERATION, "left_semi").select("vec_id", F.lit("delete").alias("op"), F.col(VERSION).alias(SEEN))
    facets = s.snapshot("facets", v).join(gone.select("vec_id"), "vec_id", "left_semi").select("vec_id", "facet", F.lit("delete").alias("op"))
    intents = equal.join(s.snapshot("intents", v), GENERATION).select(*GENERATION, "due_at", F.lit("purged").alias("state"))
    return s.commit({"records": gone, "facets": facets, "proofs": equal.select(*GENERATION, F.lit("delete").alias("op")), "intents": intents}, v, {"kind": "purge", "at": before})
