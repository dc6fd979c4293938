"""Continuous indexing: a stream of documents, applied to a collection batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import parsers
from ..operators import diff, embed
from ..operators.store import SCHEMA, Store


def sync(documents: DataFrame, store: Store, collection: str, checkpoint: str) -> StreamingQuery:
    """Start a query that parses each document (``path``, ``hash``, ``content``) of a stream and puts its nodes in place of
    the document's old ones. Node ids follow from path and position, so a batch that runs twice changes nothing. A batch writes its own nodes and no others."""

    def apply(batch: DataFrame, _: int) -> None:
        latest = batch.dropDuplicates(["path"]).persist()
        known = diff.stored_hashes(store.nodes(collection).join(latest.select(F.col("path").alias("_path")), F.col("document_path") == F.col("_path"), "left_semi"))
        planned = diff.plan(diff.classify(latest, known), None).filter("action = 'sync'").persist()
        parsed = parsers.nodes(latest.join(planned.select("path"), "path", "left_semi")).persist()
        good, failed = parsed.filter("error is null").drop("error"), parsed.filter("error is not null").select("document_path")
        gone = planned.filter("status = 'modified'").select(F.col("path").alias("document_path")).join(failed, "document_path", "left_anti")
        store.sync(collection, good.withColumn("embedding", embed.embed(F.col("content"))).select(*SCHEMA.names), gone)
        for df in (latest, planned, parsed):
            df.unpersist()

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
