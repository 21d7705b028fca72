"""Parquet tables of the data folder and a session with the settings the library expects."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cpus: int | None = None, app: str = "lamella", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the deployment's own session is used."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, cut to ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def binary_objects(spark: SparkSession, path: str, digests: DataFrame | None = None) -> DataFrame:
    """Files below ``path`` as (path, content, digest, size_bytes); with ``digests`` (digest) only verified ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.select("path", "content", F.sha2("content", 256).alias("digest"), F.col("length").alias("size_bytes"))
    return found if digests is None else found.join(digests.select("digest").distinct(), "digest", "left_semi")
