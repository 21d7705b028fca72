"""What the training-data operators share: tables, the shared folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, cut to ``columns`` so that extra ones never clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and all work is in one process (tests, one machine) a temporary folder is
    made; on a cluster that would be another folder on each machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lamella-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lamella-{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage is cut in storage that outlives any executor; later readers prune columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.lamella_path = path
    return held


def discard(*settled: DataFrame) -> None:
    """Delete what ``settle`` wrote, once no later step reads it: a lost executor is then replayed from later tables."""
    for df in settled:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.lamella_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, tag: str, rows: int) -> DataFrame:
    """Settle ``df`` and mark it for broadcast only if it has at most ``rows`` rows.

    Beyond the bound the table stays a plain join side, which Spark shuffles and, where
    a key is hot, splits.
    """
    held = settle(df, tag)
    return F.broadcast(held) if held.limit(rows + 1).count() <= rows else held


#: Rows of an Arrow batch between the JVM and a worker, at most: whole texts are large.
BATCH_ROWS = 4_000
#: Workers return freed memory to the system, and compute on the one core that Spark gives their task.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"}


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from the repository beside the driver, and keep them small."""
    env = spark.sparkContext.environment
    for k, v in LEAN.items():
        env.setdefault(k, v)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH")) if x)


def py(spark: SparkSession, df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the package importable on the workers."""
    workers_import(spark)
    return df.mapInArrow(function, schema)


_HELD: list = [None, {}]


def memory(key: object) -> dict:
    """What this worker remembers between tasks under ``key``; another key empties it, so that stages don't add up."""
    if _HELD[0] != key:
        _HELD[:] = [key, {}]
    return _HELD[1]
