"""The serving fence: which vector records may be served, and the checks of candidates against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed keys of retrieval filters.
FILTERS = ("item", "source_kind", "channel")
MODEL = ("model", "model_key", "model_version", "adapter", "dimension")
#: What a proof and the records it vouches for have in common.
SET = ("team", "item", "revision", "namespace", "artifact", "artifact_type", *MODEL, "generation")


def live(records: DataFrame) -> DataFrame:
    return records.where("state = 'indexed' and deleted_at is null")


def recounted(proofs: DataFrame, records: DataFrame) -> DataFrame:
    """Proofs with ``recount``: the live records at exactly a proof's coordinates, counted anew; a proof's own count is never trusted."""
    counts = live(records).groupBy(*SET).agg(F.count(F.lit(1)).alias("recount"))
    return proofs.join(counts, list(SET), "left").withColumn("recount", F.coalesce("recount", F.lit(0).cast("long")))


def conditions() -> dict[str, Column]:
    """The fence's conditions by name, over a record joined with its ledgers; a null never passes."""
    r, n, q = F.col, lambda c: F.col(f"ns_{c}"), lambda c: F.col(f"proof_{c}")
    out = {
        "record_deleted": r("deleted_at").isNull(), "record_state": r("state") == "indexed", "namespace_status": r("status") == "active", "namespace_deleted": n("deleted_at").isNull(),
        **{f"namespace_{c}": r(c) == n(c) for c in MODEL},
        "pointer_state": r("pointer_state") == "active", "pointer_generation": r("active_generation") == r("generation"), "pointer_artifact": r("pointer_artifact") == r("artifact"), "pointer_proof": r("last_proof").isNotNull(),
        "proof_type": q("type") == "publication", "proof_version": q("version") == "v1",
        **{f"proof_{c}": q(c) == r(c) for c in ("team", "item", "revision", "namespace", "artifact", "artifact_type", "model_key", "adapter", "dimension", "generation")},
        "proof_model_version": q("model_version") == r("model_version"),
        "expected_count": r("expected_count") == r("actual_count"), "matched_count": r("actual_count") == r("matched_count"), "complete_set": r("actual_count") == r("recount"),
        "generation_type": r("generation_type") == r("artifact_type"), "generation_validation": r("validation") == "full_valid",
        "item_lifecycle": r("lifecycle") == "active", "item_deleted": r("item_deleted_at").isNull(), "item_serving": r("serving_revision").isNotNull(), "item_revision": r("serving_revision") == r("revision"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def serving_fence(records: DataFrame, namespaces: DataFrame, pointers: DataFrame, proofs: DataFrame, items: DataFrame, sources: DataFrame, generations: DataFrame, skip: tuple[str, ...] = (), team: int | None = None) -> DataFrame:
    """Records that may be served, with their namespace's metric, proof, generation handle and source kind.

    A record meets its namespace, its item's pointer, the proof that the pointer names, its item, the item's source (if
    any) and its generation artifact, and stays if all ``conditions`` hold; ``team`` keeps one team's. ``skip``
    leaves conditions out, for tests that each counts. All sides are plain equi-joins: Spark broadcasts what is
    below its threshold and shuffles, with skew handling, what isn't. The fence is narrow: vectors are joined to what it holds.
    """
    if team is not None:
        records = records.where(F.col("team") == team)
    held = recounted(proofs, records).select(
        F.col("proof").alias("last_proof"), *[F.col(c).alias(f"proof_{c}") for c in SET], "proof_type", "proof_version", "expected_count", "actual_count", "matched_count", "recount",
    )
    joined = (
        records.join(namespaces, "namespace")
        .join(pointers.select("team", "item", "namespace", "active_generation", "pointer_state", F.col("artifact").alias("pointer_artifact"), "last_proof"), ["team", "item", "namespace"])
        .join(held, "last_proof")
        .join(items, ["team", "item"])
        .join(sources, ["team", "source"], "left")
        .join(generations.select("team", "artifact", F.col("artifact_type").alias("generation_type"), "validation", "handle"), ["team", "artifact"])
    )
    for name, condition in conditions().items():
        if name not in skip:
            joined = joined.where(condition)
    return joined.select("vec_id", "team", "item", "namespace", "generation", "unit", "granularity", "channel", "source_kind", "metric", F.col("last_proof").alias("proof"), "handle")


def active_vectors(records: DataFrame, namespaces: DataFrame, pointers: DataFrame, proofs: DataFrame) -> DataFrame:
    """The weaker view: no item, count or revision checks."""
    held = pointers.where("pointer_state = 'active'").select("item", "namespace", "active_generation")
    joined = live(records).join(namespaces.where("status = 'active'").select("namespace"), "namespace").join(held, ["item", "namespace"])
    return joined.where("generation = active_generation").join(proofs, ["item", "namespace", "generation"], "left_semi")


def filtered(fence: DataFrame, **filters) -> DataFrame:
    """Optional equality filters by closed keys; a key that isn't known is an error, a list means any of its values."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for key, value in filters.items():
        if value is not None:
            fence = fence.where(F.col(key).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(key) == value)
    return fence


def eligible(candidates: DataFrame, records: DataFrame, items: DataFrame) -> DataFrame:
    """Candidate triples (vec_id, item, revision) whose record is live and whose item is active, not deleted, and serves the revision."""
    return fallback_eligible(candidates, live(records), items)


def fallback_eligible(candidates: DataFrame, records: DataFrame, items: DataFrame) -> DataFrame:
    """The same without a look at the record's own state: what stays when only items can be asked."""
    triple = ["vec_id", "item", "revision"]
    served = items.where("lifecycle = 'active' and item_deleted_at is null and serving_revision is not null").select("team", "item", F.col("serving_revision").alias("revision"))
    known = records.join(served, ["team", "item", "revision"], "left_semi")
    return candidates.select(*triple).distinct().join(known.select(*triple), triple, "left_semi")


def unconflicted(candidates: DataFrame) -> DataFrame:
    """Candidates of ids that stand at one coordinate only; an id at two is dropped entirely."""
    one = candidates.groupBy("vec_id").agg(F.min(F.struct("item", "revision")).alias("lo"), F.max(F.struct("item", "revision")).alias("hi"))
    return one.where("lo = hi").select("vec_id", "lo.item", "lo.revision")


def revalidated(candidates: DataFrame, fence: DataFrame) -> DataFrame:
    """Candidates that a fresh fence still holds at exactly their coordinates."""
    on = ["vec_id", "item", "namespace", "generation"]
    return candidates.join(fence.select(*on), on, "left_semi")


def within(cap: int, df: DataFrame) -> DataFrame:
    """The rows, or an error if there are more than ``cap``: a cap never cuts silently."""
    n = df.limit(cap + 1).count()
    if n > cap:
        raise ValueError(f"more than {cap} candidates")
    return df


def counts_consistent(expected: Column, actual: Column, matched: Column) -> Column:
    return F.coalesce((expected == actual) & (actual == matched), F.lit(False))
