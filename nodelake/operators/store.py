"""Collections of nodes as logs of Parquet folders, so that a change writes what it changes and nothing else.

A commit is a folder with new nodes and, beside them, the paths and the ids whose older nodes it hides; then a pointer
to it is created, whole. Readers see the last full commit and the later ones, without what later ones hide. Folders of
changes are merged when there are many of them, and into all the rest when they amount to a share of it, so each node is
rewritten a bounded number of times. A writer that fails leaves no pointer. All files go through Spark's file systems, so a
collection can lie wherever Spark can write. Only one writer may change a collection at a time.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..parsers import NODE

SCHEMA = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "content", "hash", "repo_path", "document_path", "language", "node_type", "node_name")), *NODE.fields[3:], T.StructField("embedding", T.ArrayType(T.FloatType())),
])
_STORED = T.StructType([*SCHEMA.fields, T.StructField("_commit", T.LongType())])
_HIDES = {"paths": "document_path", "ids": "id"}


def delete_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes without those of the given documents (``document_path``)."""
    gone = paths.select(F.col("document_path").alias("_path")).distinct()
    return nodes.join(gone, F.col("document_path") == F.col("_path"), "left_anti")


def upsert(nodes: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with the new ones, which replace those of equal key."""
    kept = nodes.join(new.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
    return kept.unionByName(new)


class Store:
    #: Folders of changes that are merged into one; the share (one in so many bytes) at which they go into the rest.
    MERGE, SHARE = 64, 4

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._ensured: set[str] = set()

    @classmethod
    def connect(cls, spark: SparkSession, settings: dict[str, Any]) -> Store:
        """A store as the settings have it: ``local`` in the folder ``path``; ``remote`` at ``url``, any address that Spark
        writes to; ``memory``, in a folder of its own that goes when the process ends."""
        mode = settings.get("mode", "local")
        if mode == "remote":
            if not settings.get("url"):
                raise ValueError("a remote store needs a url")
            return cls(spark, settings["url"])
        if mode == "local":
            return cls(spark, settings["path"])
        shared = spark.conf.get("spark.checkpoint.dir", None)
        store = cls(spark, f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="nodelake-store-"))
        atexit.register(store._remove if shared else lambda: shutil.rmtree(store.path, True))
        return store

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _remove(self) -> None:
        try:
            files, path = self._at()
            files.delete(path, True)
        except Exception:  # the session may have ended
            pass

    def _log(self, name: str) -> list[tuple[int, str, str]]:
        """Number, kind and folder of the commits that count: a full one and those of changes after it."""
        files, path = self._at(name, "_log")
        if not files.exists(path):
            return []
        found = sorted((int(n), kind, folder) for n, kind, folder in (s.getPath().getName().split("-") for s in files.listStatus(path)))
        kinds = [kind for _, kind, _ in found]
        found = found[max((i for i, k in enumerate(kinds) if k == "full"), default=0) :]
        merged = max((i for i, (_, kind, _) in enumerate(found) if kind == "merged"), default=1)
        found[1:merged] = []  # a merged commit stands for the changes before it
        return found

    def _commit(self, name: str, kind: str, nodes: DataFrame, **hidden: DataFrame | None) -> str:
        """Write a commit. What it hides are the paths and ids of the given rows; None: those of its own nodes."""
        log = self._log(name)
        number, folder = 1 + (log[-1][0] if log else 0), uuid.uuid4().hex
        nodes.select(*SCHEMA.names).withColumn("_commit", F.lit(number).cast("long")).write.parquet(f"{self.path}/{name}/{folder}/nodes")
        for what, column in _HIDES.items():
            if what in hidden:
                rows = self.spark.read.schema(_STORED).parquet(f"{self.path}/{name}/{folder}/nodes") if hidden[what] is None else hidden[what]
                rows.select(F.col(column).alias("key")).distinct().withColumn("before", F.lit(number).cast("long")).write.parquet(f"{self.path}/{name}/{folder}/{what}")
        files, path = self._at(name, "_log")
        files.mkdirs(path)
        files.createNewFile(self._at(name, "_log", f"{number:012d}-{kind}-{folder}")[1])
        return folder

    def _read(self, name: str, log: list[tuple[int, str, str]]) -> DataFrame:
        at = [f"{self.path}/{name}/{folder}" for _, _, folder in log]
        rows = self.spark.read.schema(_STORED).parquet(*(f"{f}/nodes" for f in at))
        for what, column in _HIDES.items():
            if gone := self._hidden(name, log, what):
                rows = rows.join(gone, (F.col(column) == F.col("key")) & (F.col("_commit") < F.col("before")), "left_anti")
        return rows

    def _hidden(self, name: str, log: list[tuple[int, str, str]], what: str) -> DataFrame | None:
        at = [f"{self.path}/{name}/{folder}/{what}" for _, kind, folder in log if kind != "full"]
        at = [f for f in at if (p := self.spark._jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)]
        return self.spark.read.schema("key string, before long").parquet(*at).groupBy("key").agg(F.max("before").alias("before")) if at else None

    def _bytes(self, name: str, folder: str) -> int:
        files, path = self._at(name, folder)
        return files.getContentSummary(path).getLength()

    def _change(self, name: str, new: DataFrame, **hidden: DataFrame | None) -> str:
        """Commit a change, and merge folders if it is time to. Returns the change's folder."""
        self.ensure(name)
        folder = self._commit(name, "delta", new, **hidden)
        log = self._log(name)
        if self.SHARE * sum(self._bytes(name, folder) for _, _, folder in log[1:]) > self._bytes(name, log[0][2]) + (64 << 20):
            self.compact(name)
        elif len(log) > self.MERGE:
            changes = log[1:]
            gone = {what: df.withColumnRenamed("key", _HIDES[what]) for what in _HIDES if (df := self._hidden(name, changes, what)) is not None}
            self._commit(name, "merged", self._read(name, changes), **gone)
        return folder

    def compact(self, name: str) -> None:
        """Write the collection as one full commit."""
        self._commit(name, "full", self.nodes(name))

    def vacuum(self, name: str) -> None:
        """Remove all folders that no reader of the present state needs. No reader may be at work on them."""
        log = self._log(name)
        now, pointers = {folder for _, _, folder in log}, {f"{n:012d}-{kind}-{folder}" for n, kind, folder in log}
        for parts, keep in (((name, "_log"), pointers), ((name,), now | {"_log"})):
            files, path = self._at(*parts)
            for s in files.listStatus(path):
                if s.getPath().getName() not in keep:
                    files.delete(s.getPath(), True)

    def create(self, name: str) -> None:
        self._commit(name, "full", self.spark.createDataFrame([], SCHEMA))
        self._ensured.add(name)

    def ensure(self, name: str) -> None:
        if name not in self._ensured:
            if not self._log(name):
                self.create(name)
            self._ensured.add(name)

    def drop(self, name: str) -> None:
        files, path = self._at(name)
        files.delete(path, True)
        self._ensured.discard(name)

    def nodes(self, name: str) -> DataFrame:
        self.ensure(name)
        return self._read(name, self._log(name)).drop("_commit")

    def replace(self, name: str, nodes: DataFrame) -> None:
        """All nodes of a collection anew."""
        self._commit(name, "full", nodes)

    def sync(self, name: str, new: DataFrame, gone: DataFrame) -> DataFrame:
        """New nodes, and documents (``document_path``) whose older nodes go, in one commit. Returns ``gone`` as written."""
        folder = self._change(name, new, paths=gone)
        return self.spark.read.schema("key string, before long").parquet(f"{self.path}/{name}/{folder}/paths").select(F.col("key").alias("document_path"))

    def upsert(self, name: str, new: DataFrame) -> int:
        """Returns the number of new nodes; none: nothing is written."""
        if new.isEmpty():
            return 0
        folder = self._change(name, new, ids=None)
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/{name}/{folder}/nodes").count()

    def delete_by_document_paths(self, name: str, paths: list[str]) -> int:
        """Returns the number of paths, not of nodes."""
        if paths:
            gone = self.spark.createDataFrame([(p,) for p in paths], "document_path string")
            self._change(name, self.spark.createDataFrame([], SCHEMA), paths=gone)
        return len(paths)

    def count(self, name: str) -> int:
        return self.nodes(name).count()
