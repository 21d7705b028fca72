"""A content-addressed sink for bytes, and an ordered, checksum-guarded list of schema steps."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.workers import workers_import


def stored_objects(objects: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of rows (key, content) below ``folder``, a URI all executors share, each under its SHA-256.

    A file is written aside and moved into place, so that readers only see whole ones and repeated writes of equal
    bytes, by other tasks or attempts, leave the same file. Returns key, digest, size_bytes and path; null contents store nothing.
    """
    workers_import(objects.sparkSession)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            out = []
            for content in b.column("content").to_pylist():
                if content is None:
                    out.append((None, None, None))
                    continue
                digest = hashlib.sha256(content).hexdigest()
                place = f"{root}/{digest[:2]}/{digest}"
                if store.get_file_info(place).type == fs.FileType.NotFound:
                    store.create_dir(f"{root}/{digest[:2]}", recursive=True)
                    staged = f"{root}/{digest[:2]}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(staged) as f:
                        f.write(content)
                    store.move(staged, place)
                out.append((digest, len(content), place))
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *columns], ["key", "digest", "size_bytes", "path"])

    kind = objects.schema["key"].dataType.simpleString()
    return objects.select("key", "content").mapInArrow(run, f"key {kind}, digest string, size_bytes long, path string")


def read_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, content, verified): what is stored, and whether it still has the digest of its name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("digest"), "content", (F.sha2("content", 256) == name).alias("verified"))


Step = tuple[int, str, Callable[[SparkSession, str], None]]


def migrated(spark: SparkSession, root: str, steps: list[Step]) -> list[int]:
    """Apply the steps (number, text, function of (spark, root)) that ``root`` lacks, in order; returns their numbers.

    Applied steps are recorded with the checksum of their text. Numbers count on from 1 without gaps, and a
    recorded step whose text is another now is an error, found before anything is applied.
    """
    if [n for n, _, _ in steps] != list(range(1, len(steps) + 1)):
        raise ValueError("steps must count on from 1")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/_steps")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = {}
    if store.exists(folder):
        held = {r["n"]: r["checksum"] for r in (json.loads(x[0]) for x in spark.read.text(f"{root}/_steps", wholetext=True).collect())}  # a row a step
    sums = {n: hashlib.sha256(text.encode()).hexdigest() for n, text, _ in steps}
    if wrong := [n for n, s in held.items() if sums.get(n) != s]:
        raise ValueError(f"steps differ from those applied: {sorted(wrong)}")
    done = []
    for n, _, apply in steps:
        if n in held:
            continue
        apply(spark, root)
        out = store.create(jvm.org.apache.hadoop.fs.Path(f"{root}/_steps/{n:06d}"), False)
        out.write(bytearray(json.dumps({"n": n, "checksum": sums[n]}).encode()))
        out.close()
        done.append(n)
    return done
