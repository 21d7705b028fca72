"""Index generations: published as immutable folders, proven by re-reading, and named by numbered pointer files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.arrow import json_strings
from lamella.functions.workers import workers_import
from lamella.operators.ledger import set_digest
from lamella.sources.versions import put_if_absent


def member(vec: str = "vec_id", digest: str = "content_digest"):
    return F.concat_ws(":", F.col(vec).cast("string"), F.col(digest))


#: Minutes after a pointer moved for which what it left stays.
GRACE = 60


def withdrawn_older(records: DataFrame, pointers: DataFrame, *columns: str) -> DataFrame:
    """Generations behind the active pointer, each once, with ``columns`` of the pointer: what retirement acts on."""
    older = records.select("item", "namespace", "generation").distinct().join(pointers.select("item", "namespace", "active_generation", *columns), ["item", "namespace"])
    return older.where("generation < active_generation")


def retirement(older: DataFrame, held: Column, minutes: Column) -> DataFrame:
    """Whether a generation left behind is deferred (its item is held), waiting (within the grace) or due."""
    return older.withColumn("state", F.when(held, "deferred").when(minutes < GRACE, "waiting").otherwise("due"))


def gate(generations: DataFrame, members: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(artifact, n_members, n_valid, admitted): a generation is admitted if it and every one of its named members is fully valid."""
    m = members.where(F.col("member").isin(*names)).groupBy("artifact").agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("disposition") == "full_valid").alias("n_valid"), F.count_distinct("member").alias("kinds"))
    g = generations.groupBy("artifact").agg(F.bool_and(F.col("validation") == "full_valid").alias("own")).join(m, "artifact", "left").na.fill(0)
    return g.select("artifact", "n_members", "n_valid", ((F.col("kinds") == len(names)) & (F.col("n_members") == F.col("n_valid")) & F.col("own")).alias("admitted"))


def holds(objects: DataFrame, intents: DataFrame) -> DataFrame:
    """Objects (object_id, digest, team) with ``state`` by a team's open intents (team, target, snapshot, refs): team_blocked, held or free.

    ``refs`` is a JSON list; an object is held if any text in it, at any depth but as a key, or the target or snapshot names it in one of
    six spellings. A list that can't be read, or isn't a list, may name anything, and so blocks its team. Names and objects meet in one join.
    """
    workers_import(objects.sparkSession)
    read = intents.select("team", "target", "snapshot", json_strings("refs").alias("s"))
    blocked = read.where(F.col("s").isNull()).select("team", F.lit(True).alias("_blocked")).distinct()
    names = read.select("team", F.explode(F.concat(F.coalesce("s", F.array().cast("array<string>")), F.array("target", "snapshot"))).alias("name")).where("name is not null").distinct()
    id_, digest = F.col("object_id").cast("string"), F.col("digest")
    spellings = F.array(id_, digest, F.concat(F.lit("handle/"), digest), F.concat(F.lit("stored_object:"), id_), F.concat(F.lit("object:"), id_), F.concat(F.lit("sha256:"), digest))
    found = objects.select("object_id", "team", F.explode(spellings).alias("name")).join(names, ["team", "name"], "left_semi").select("object_id").distinct().withColumn("_held", F.lit(True))
    state = F.when(F.col("_blocked"), "team_blocked").when(F.col("_held"), "held").otherwise("free")
    return objects.join(found, "object_id", "left").join(blocked, "team", "left").withColumn("state", state).drop("_held", "_blocked")


def copied(facets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facets under the new ids of a mapping (vec_id, new_vec); facets of other records aren't copied."""
    return facets.join(mapping, "vec_id")


def cloned(records: DataFrame, generation: str = "generation") -> DataFrame:
    """The same vectors as the next generation's records."""
    return records.withColumn(generation, F.col(generation) + 1)


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """The newest pointer of a published index, or None before the first publication."""
    fs, folder, jvm = _file(spark, f"{root}/pointers")
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("pointer-"))
    return json.loads(spark.read.text(f"{root}/pointers/{names[-1]}", wholetext=True).first()[0]) if names else None


def publish(records: DataFrame, root: str, expected_revision: int) -> dict:
    """Write records (vec_id, content_digest, ...) to a folder of their own and put a pointer to it beside the older ones.

    The folder is written first and proven by reading it again (count and set digest). Pointers are numbered
    files, the highest of which counts; one is written aside and renamed into place, which fails if
    its number is taken, so nothing is ever overwritten or deleted: a crash leaves at most a folder and a file that no
    reader sees. ``expected_revision`` is that of the pointer to succeed (0: none yet).
    """
    spark = records.sparkSession
    now = read_pointer(spark, root)
    if (now["revision"] if now else 0) != expected_revision:
        raise ValueError("the pointer has moved")
    revision = expected_revision + 1
    folder = f"generation={revision}-{uuid.uuid4().hex}"
    records.write.parquet(f"{root}/{folder}")
    found = proof(spark.read.parquet(f"{root}/{folder}")).first()
    pointer = {"revision": revision, "generation": revision, "folder": folder, "members": found["members"], "digest": found["digest"]}
    fs, pointers, _ = _file(spark, f"{root}/pointers")
    fs.mkdirs(pointers)
    if not put_if_absent(spark, f"{root}/pointers/pointer-{revision:012d}", json.dumps(pointer)):
        raise ValueError("the pointer has moved")
    return pointer


def proof(records: DataFrame) -> DataFrame:
    """One row: members and an order-free digest. Members are hashed in buckets first, so no task gathers them all."""
    bucketed = set_digest(records.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(4096))), ["_b"], member())
    return bucketed.agg(F.sum("members").alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("_b").cast("string"), "digest"))), "\n"), 256).alias("digest"))


def published(spark: SparkSession, root: str) -> DataFrame:
    """The records of the generation the pointer names."""
    pointer = read_pointer(spark, root)
    if pointer is None:
        raise ValueError("nothing is published")
    return spark.read.parquet(f"{root}/{pointer['folder']}")
