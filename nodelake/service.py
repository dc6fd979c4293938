"""Repositories: register, index, search, status, forget."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, parsers
from .errors import RepoExistsError, RepoNotFoundError, validate_git_repository
from .functions import scalars as X
from .operators import diff, embed, search
from .operators.store import SCHEMA, Store
from .sources import repo as tree


@dataclass
class IndexResult:
    files_synced: list[str] = field(default_factory=list)
    deleted: DataFrame | None = None  # paths; they aren't capped, so they are fetched only when asked for
    files_checked: int = 0
    skipped_files: int = 0
    nodes_added: int = 0
    nodes_deleted: int = 0
    nodes_updated: int = 0
    indexed_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    errors: list[str] = field(default_factory=list)

    @property
    def files_deleted(self) -> list[str]:
        return [] if self.deleted is None or not self.nodes_deleted else sorted(r["document_path"] for r in self.deleted.toLocalIterator())

    def to_dict(self) -> dict:
        """Values that JSON takes."""
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "deleted"}
        return own | {"files_deleted": self.files_deleted, "indexed_at": self.indexed_at.isoformat()}


def collection_of(name: str) -> str:
    return "nodelake_" + "".join(c if c.isalnum() else "_" for c in name.lower())


@dataclass(frozen=True)
class Repo:
    name: str
    path: str
    collection_name: str

    @staticmethod
    def _file() -> Path:
        return config.config_dir() / "repos.json"

    @classmethod
    def list(cls) -> list[Repo]:
        """All registered repositories; a registry that is missing or can't be read has none."""
        try:
            rows = json.loads(cls._file().read_text())["repos"]
            return [cls(r["name"], r["path"], r["collection_name"]) for r in rows]
        except (OSError, ValueError, KeyError, TypeError):
            return []

    @classmethod
    def _save(cls, repos: list[Repo]) -> None:
        cls._file().parent.mkdir(parents=True, exist_ok=True)
        cls._file().write_text(json.dumps({"repos": [r.__dict__ for r in repos]}, indent=2))

    @classmethod
    def init(cls, path: str | Path) -> Repo:
        """Register a working tree. The same path again gives its entry; another path may not take a name, or a collection,
        that is in use."""
        path = Path(path).resolve()
        validate_git_repository(path)
        repos, options = cls.list(), config.RepoOptions.from_repo(path)
        new = cls(path.name, str(path), options.collection or collection_of(path.name))
        for r in repos:
            if r.path == new.path:
                return r
            if r.name == new.name or r.collection_name == new.collection_name:
                raise RepoExistsError(f"{new.name} is taken by {r.path}")
        cls._save([*repos, new])
        return new

    @classmethod
    def get(cls, name: str) -> Repo:
        for r in cls.list():
            if r.name == name:
                return r
        raise RepoNotFoundError(f"no repository {name!r}")

    @classmethod
    def remove(cls, name: str, store: Store) -> None:
        store.drop(cls.get(name).collection_name)
        cls._save([r for r in cls.list() if r.name != name])

    def walk(self, spark: SparkSession) -> DataFrame:
        return tree.walk(spark, self.path)

    def index(self, store: Store, full: bool = False, embedder: embed.Embedder | None = None) -> IndexResult:
        """Bring the collection in step with the tree: parse what is new or modified, drop what is gone, in one commit that
        holds the changes alone. A file that can't be parsed is reported and keeps its old nodes."""
        spark, name, options = store.spark, self.collection_name, config.RepoOptions.from_repo(self.path)
        if full:
            store.drop(name)
        stored, walked = store.nodes(name), self.walk(spark).persist()
        planned = diff.plan(diff.classify(walked, diff.stored_hashes(stored)), options.max_sync_files).persist()
        todo = walked.join(planned.filter("action = 'sync'").select("path"), "path", "left_semi")
        parsed = parsers.nodes(todo, self.path).persist()
        failed = parsed.filter("error is not null").select("document_path", "error").collect()  # as many as the cap at most
        good = parsed.filter("error is null").drop("error")
        bad = spark.createDataFrame([(r["document_path"],) for r in failed], "path string")
        done = planned.join(bad, "path", "left_anti")
        by_path = good.groupBy(F.col("document_path").alias("path")).agg(F.count("*").alias("n"))
        counts = diff.summary(done, by_path).first()
        synced = [r["path"] for r in diff.synced_paths(done.filter("action = 'sync'"), by_path).collect()]  # as many as the cap at most
        deleted = None
        if synced or counts["nodes_deleted"] or not good.isEmpty():
            vectors = good.withColumn("embedding", embed.embed(F.col("content"), embedder or embed.embedder(config.Settings.load().embedding["model_name"]), options.upsert_batch_size))
            gone = store.sync(name, vectors.select(*SCHEMA.names), done.filter("action = 'delete' or action = 'sync' and status = 'modified'").select(F.col("path").alias("document_path")))
            modified = [r["path"] for r in done.filter("action = 'sync' and status = 'modified'").select("path").collect()]  # as many as the cap at most
            deleted = gone.filter(~F.col("document_path").isin(modified))
        result = IndexResult(
            sorted(synced), deleted, counts["files_checked"] + len(failed), counts["skipped_files"], counts["nodes_added"], counts["nodes_deleted"], counts["nodes_updated"],
            errors=[f"{r['document_path']}: {r['error']}" for r in failed])
        for df in (walked, planned, parsed):
            df.unpersist()
        return result

    def search(self, store: Store, query: str, limit: int | None = None, embedder: embed.Embedder | None = None, **conditions) -> DataFrame:
        """The best ``limit`` (10) nodes for a query, embedded as the settings have it unless an embedder is given."""
        embedder = embedder or embed.embedder(config.Settings.load().embedding["model_name"])
        return search.search(store.nodes(self.collection_name), embed.query_vector(query, embedder), X.effective_limit(limit), **conditions)

    def status(self, store: Store) -> dict:
        row = diff.status(store.nodes(self.collection_name), self.walk(store.spark)).first()
        return {"repository": self.name, "path": self.path} | row.asDict()


def preview(content: str) -> str:
    return re.sub(r"\n", " ", content.strip())[:50] + "..."
