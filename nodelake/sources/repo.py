"""A working tree as a DataFrame of documents.

Spark's file sources leave out names that begin with a dot or an underscore, which are wanted here, so the tree is a Python
data source: the driver lists it (ignored directories are never entered), executors read the files. The tree must be in a
place that executors see, such as a mounted checkout.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import RepoOptions, Settings
from ..errors import validate_git_repository
from ..functions import scalars as X
from ..operators import filters
from .ignore import DEFAULTS, Matcher

SCHEMA = "path string, size_bytes bigint, mtime double, raw binary"


def list_files(root: str, matcher: Matcher, max_size: int) -> Iterator[tuple[str, int, float]]:
    """Relative path, size and mtime of the files to read; what can't be read is left out. A directory that a link leads
    back to is not entered again."""
    seen = set()
    stack = [""]
    while stack:
        at = stack.pop()
        try:
            here = os.path.realpath(os.path.join(root, at))
            if here in seen:
                continue
            seen.add(here)
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{at}/{e.name}" if at else e.name
            try:
                if e.is_dir():
                    if not matcher.ignores(path + "/"):
                        stack.append(path)
                elif e.is_file() and not matcher.ignores(path) and 0 < (s := e.stat()).st_size <= max_size:
                    yield path, s.st_size, s.st_mtime
            except OSError:
                continue


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.patterns = options["path"], options.get("patterns", "").split("\n")
        self.max_size, self.bytes = int(options.get("maxsize", filters.MAX_FILE_SIZE)), int(options.get("partitionbytes", 32 << 20))

    def partitions(self):
        out, files, size = [], [], 0
        for f in list_files(self.root, Matcher(self.patterns), self.max_size):
            if files and size + f[1] > self.bytes:
                out.append(_Files(files))
                files, size = [], 0
            files.append(f)
            size += f[1]
        return [*out, _Files(files)]

    def read(self, partition):
        for path, size, mtime in partition.files:
            try:
                yield path, size, mtime, Path(self.root, path).read_bytes()
            except OSError:
                continue


class RepoSource(DataSource):
    @classmethod
    def name(cls):
        return "nodelake_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def documents(raw: DataFrame) -> DataFrame:
    """``path``, ``size_bytes``, ``mtime``, ``content``, ``hash`` from files' bytes."""
    kept = raw.filter(filters.readable(F.col("path"), F.col("size_bytes")))
    text = kept.withColumn("content", X.decode_text(F.col("raw"))).filter("content is not null")
    return text.select("path", "size_bytes", "mtime", "content", X.document_hash(F.col("path"), F.col("content")).alias("hash"))


def patterns(root: str, options: RepoOptions, defaults: tuple[str, ...] = DEFAULTS) -> list[str]:
    """Defaults, the root's ignore file, the repository's own patterns; later ones win."""
    own = Path(root, ".gitignore")
    try:
        lines = own.read_text().splitlines() if own.exists() else []
    except (OSError, UnicodeDecodeError):
        lines = []
    return [*defaults, *lines, *options.ignore_patterns]


def walk(spark: SparkSession, root: str, options: RepoOptions | None = None) -> DataFrame:
    """The documents of a working tree. What is ignored: the settings' patterns, the tree's own, those of its options."""
    root = str(Path(root).resolve())
    validate_git_repository(root)
    options = options or RepoOptions.from_repo(root)
    spark.dataSource.register(RepoSource)
    reader = spark.read.format("nodelake_tree").option("path", root).option("patterns", "\n".join(patterns(root, options, tuple(Settings.load().ignore_patterns)))).option("maxSize", str(options.max_file_size))
    return documents(reader.load())
