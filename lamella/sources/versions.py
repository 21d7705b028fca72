"""Versioned tables: an append-only log of numbered commits over Parquet changes, with optimistic writers and snapshot reads.

A store holds several keyed tables. A commit brings changes to any of them and counts as a whole: its changes are
written to folders of their own first, and become visible by one log file, whose number only one writer can take.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of changes and snapshots besides a table's own: what a change does, which version of its row the writer has seen, and which commit wrote a row.
OP, SEEN, VERSION = "op", "seen", "row_version"


class Conflict(Exception):
    """Another writer has changed what this one has read; ``keys`` names a table and some of the keys."""

    def __init__(self, table: str, keys: list):
        super().__init__(f"{table}: {keys}")
        self.table, self.keys = table, keys


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless its name is taken: then False. Of two writers one succeeds.

    The text is written aside. A local file gets its name by a link, others by a rename that doesn't overwrite; both fail if the name is taken.
    """
    fs, target, jvm = _files(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            nio = jvm.java.nio.file
            place = [nio.Paths.get(x.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for x in (target, staged)]
            nio.Files.createLink(*place)
            fs.delete(staged, False)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, target, options)
    except Exception:
        fs.delete(staged, False)
        if fs.exists(target):
            return False
        raise
    return True


class Store:
    """Tables by name with their keys, below ``root``, a URI that all executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, ...]]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _log(self) -> list[tuple[int, str]]:
        fs, folder, _ = _files(self.spark, f"{self.root}/log")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted((int(n.split(".")[0]), n) for n in names if not n.startswith("."))

    def version(self) -> int:
        """The number of the newest commit; 0 for an empty store."""
        log = self._log()
        return log[-1][0] if log else 0

    def entries(self, version: int | None = None) -> list[dict]:
        """The commits that make up a version: the newest compaction up to it, if any, and the changes behind what that one holds."""
        log = [(n, name) for n, name in self._log() if version is None or n <= version]
        if version is not None and version > (log[-1][0] if log else 0):
            raise ValueError(f"version {version} doesn't exist")
        base = next(((n, name) for n, name in reversed(log) if name.endswith(".compact")), None)
        return self._read([base[1]] if base else []) + self._read([name for n, name in log if n > (base[0] if base else 0) and name.endswith(".change")])

    def _read(self, names: list[str]) -> list[dict]:
        """Log files in order; few, since a compaction stands for those before it."""
        found = self.spark.read.text([f"{self.root}/log/{name}" for name in names], wholetext=True).collect() if names else []
        return sorted((json.loads(r[0]) for r in found), key=lambda e: e["version"])

    def changes(self, table: str, after: int, to: int) -> DataFrame | None:
        """What the commits behind ``after`` up to ``to`` did to a table, with row_version; None if nothing."""
        held = self._read([name for n, name in self._log() if after < n <= to and name.endswith(".change")])
        return self._union([(e["version"], e["tables"][table]) for e in held if table in e["tables"]])

    def _union(self, folders: list[tuple[int, str]]) -> DataFrame | None:
        # claims were checked when their commit was made, and stay in its files
        each = [self.spark.read.parquet(f"{self.root}/{folder}").drop(SEEN).withColumn(VERSION, F.lit(n).cast("long")) for n, folder in folders]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each) if each else None

    def _fold(self, table: str, version: int | None) -> DataFrame | None:
        held = [e for e in self.entries(version) if table in e["tables"]]
        parts = [self.spark.read.parquet(f"{self.root}/{e['tables'][table]}").withColumn(OP, F.lit("put")) for e in held if e["kind"] == "compact"]
        if (late := self._union([(e["version"], e["tables"][table]) for e in held if e["kind"] == "change"])) is not None:
            parts.append(late)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def snapshot(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table at a version (default: the newest) with row_version, the commit that wrote each.

        The newest change of each key counts, and a deleting one removes the row; changes are reduced to one a key and task
        before they are shuffled. A snapshot never changes: later commits only add files.
        """
        every = self._fold(table, version)
        if every is None:
            raise ValueError(f"{table} was never written")
        keys = self.tables[table]
        rest = [c for c in every.columns if c not in (*keys, VERSION)]
        newest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_x"), F.max(VERSION).alias(VERSION))
        return newest.where(f"_x.{OP} <> 'delete'").select(*keys, *[F.col("_x")[c].alias(c) for c in rest if c != OP], VERSION)

    def commit(self, changes: dict[str, DataFrame], read_version: int, note: dict | None = None) -> int:
        """Commit changes of one or more tables, based on a snapshot at ``read_version``; returns the new version.

        Changes have a table's columns, and may have ``op`` (put, the default, or delete) and ``seen``: the row_version that the writer has read,
        0 for a row that it saw absent, null for no claim. A key may stand once a table. Conflict, with nothing made
        visible: a claim that isn't true of ``read_version``, or a key that a commit since then has changed too. Commits on other
        keys don't conflict: this one then takes the next free number.
        """
        folders = {}
        for table, df in changes.items():
            keys = self.tables[table]
            df = df if OP in df.columns else df.withColumn(OP, F.lit("put"))
            folder = f"data/{table}-{uuid.uuid4().hex}"
            df.drop(VERSION).write.parquet(f"{self.root}/{folder}")
            mine = self.spark.read.parquet(f"{self.root}/{folder}")
            if twice := mine.groupBy(*keys).count().where("count > 1").limit(3).collect():
                raise ValueError(f"{table}: keys stand more than once: {twice}")
            if SEEN in mine.columns:
                self._claims(table, mine, read_version)
            folders[table] = folder
        _files(self.spark, self.root)[0].mkdirs(_files(self.spark, f"{self.root}/log")[1])
        checked = read_version
        while True:
            now = self.version()
            for table, folder in folders.items():
                theirs = self.changes(table, checked, now)
                if theirs is not None:
                    keys = list(self.tables[table])
                    if both := self.spark.read.parquet(f"{self.root}/{folder}").select(*keys).join(theirs.select(*keys), keys, "left_semi").limit(3).collect():
                        raise Conflict(table, [tuple(r) for r in both])
            checked, n = now, now + 1
            if put_if_absent(self.spark, f"{self.root}/log/{n:020d}.change", json.dumps({"version": n, "kind": "change", "read_version": read_version, "tables": folders, "note": note or {}})):
                return n

    def _claims(self, table: str, mine: DataFrame, version: int) -> None:
        keys = list(self.tables[table])
        claims = mine.where(f"{SEEN} is not null").select(*keys, SEEN)
        if version == 0:
            bad = claims.where(f"{SEEN} <> 0")
        else:
            held = self.snapshot(table, version).select(*keys, VERSION)
            bad = claims.join(held, keys, "left").where(F.coalesce(F.col(VERSION), F.lit(0)) != F.col(SEEN))
        if found := bad.select(*keys).limit(3).collect():
            raise Conflict(table, [tuple(r) for r in found])

    def compact(self) -> int:
        """Write the newest snapshot of every table as one base, from which later reads start; snapshots of any version stay readable.

        A base only repeats what its commits say, so writers go on meanwhile.
        """
        through = self.version()
        if not through:
            return 0
        folders = {}
        for table in self.tables:
            if self._fold(table, through) is not None:
                folders[table] = f"data/{table}-base-{uuid.uuid4().hex}"
                self.snapshot(table, through).write.parquet(f"{self.root}/{folders[table]}")
        put_if_absent(self.spark, f"{self.root}/log/{through:020d}.compact", json.dumps({"version": through, "kind": "compact", "through": through, "tables": folders}))
        return through
