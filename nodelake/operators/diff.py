"""Keeping stored nodes in step with a tree: what is new, modified, unchanged, deleted, by path and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SYNC_FILES = 500


def stored_hashes(nodes: DataFrame) -> DataFrame:
    """One hash for each stored path; nodes of a document share theirs. Empty paths and hashes don't count."""
    rows = nodes.select(F.col("document_path").alias("path"), "hash").filter("path <> '' and hash <> ''")
    return rows.groupBy("path").agg(F.min("hash").alias("hash"))


def classify(walked: DataFrame, stored: DataFrame) -> DataFrame:
    """``path``, ``hash`` (walked), ``stored_hash`` and ``status``: new, modified, unchanged or deleted."""
    w, s = walked.select("path", "hash"), stored.select(F.col("path").alias("_path"), F.col("hash").alias("stored_hash"))
    joined = w.join(s, F.col("path") == F.col("_path"), "full_outer")
    status = F.when(F.col("path").isNull(), "deleted").when(F.col("_path").isNull(), "new").when(F.col("hash") != F.col("stored_hash"), "modified").otherwise("unchanged")
    return joined.select(F.coalesce("path", "_path").alias("path"), "hash", "stored_hash", status.alias("status"))


def plan(classified: DataFrame, cap: int | None = MAX_SYNC_FILES) -> DataFrame:
    """``classified`` with ``action``: sync, skip (beyond the cap, by path), delete or none. Deletions aren't capped.

    The cap is a limit on purpose; only paths that compete for it are ordered, and each task sends its first ``cap``.
    Without one, all new and modified paths are synced."""
    changed = F.col("status").isin("new", "modified")
    if cap is None:
        action = F.when(F.col("status") == "deleted", "delete").when(changed, "sync").otherwise("none")
        return classified.select("path", "hash", "stored_hash", "status", action.alias("action"))
    work = classified.filter(changed)
    chosen = work.select("path").orderBy("path").limit(cap).select(F.col("path").alias("_chosen"))
    joined = classified.join(F.broadcast(chosen), F.col("path") == F.col("_chosen"), "left")  # cap rows at most
    action = F.when(F.col("status") == "deleted", "delete").when(F.col("status") == "unchanged", "none").when(F.col("_chosen").isNotNull(), "sync").otherwise("skip")
    return joined.select("path", "hash", "stored_hash", "status", action.alias("action"))


def summary(planned: DataFrame, nodes_by_path: DataFrame) -> DataFrame:
    """One row of counters, from a plan and the nodes parsed for each synced path (``path``, ``n``)."""
    counted = planned.join(nodes_by_path.select(F.col("path").alias("_path"), F.col("n").alias("_n")), F.col("path") == F.col("_path"), "left")
    n, sync = F.coalesce("_n", F.lit(0)), F.col("action") == "sync"
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    return counted.agg(
        F.count_if(F.col("status") != "deleted").alias("files_checked"), F.count_if(sync & (n > 0)).alias("files_synced"), F.count_if(F.col("action") == "skip").alias("skipped_files"),
        F.count_if(F.col("action") == "delete").alias("nodes_deleted"), total(sync & (F.col("status") == "new")).alias("nodes_added"), total(sync & (F.col("status") == "modified")).alias("nodes_updated"))


def synced_paths(planned: DataFrame, nodes_by_path: DataFrame) -> DataFrame:
    """Paths that were synced (with a node at least) or deleted, in rows: the lists of an index result."""
    some = nodes_by_path.filter("n > 0").select(F.col("path").alias("_path"))
    synced = planned.filter("action = 'sync'").join(some, F.col("path") == F.col("_path"), "left_semi")
    return synced.select("path", F.lit("synced").alias("kind")).unionByName(planned.filter("action = 'delete'").select("path", F.lit("deleted").alias("kind")))


def apply(stored: DataFrame, planned: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored nodes after a sync: those of synced and deleted paths out, parsed nodes in."""
    touched = planned.filter(F.col("action").isin("sync", "delete")).select(F.col("path").alias("_path"))
    kept = stored.join(touched, F.col("document_path") == F.col("_path"), "left_anti")
    return kept.unionByName(parsed)


def stale(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """Stored paths whose hash no walked document has."""
    return stored.join(walked.select(F.col("hash").alias("_hash")).distinct(), F.col("hash") == F.col("_hash"), "left_anti")


def status(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """``nodes_indexed``, ``documents_indexed``, ``documents_indexed_stale``, in one row."""
    hashes = stored_hashes(nodes)
    by_doc = hashes.agg(F.count("*").alias("documents_indexed")).crossJoin(stale(hashes, walked).agg(F.count("*").alias("documents_indexed_stale")))  # one row each
    return nodes.agg(F.count("*").alias("nodes_indexed")).crossJoin(by_doc)


def latest(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key, for upserts of several versions at once."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return nodes.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
