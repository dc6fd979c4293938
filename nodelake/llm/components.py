"""Connected components of a graph given as a table of edges, joined up in tasks, and between them by alternating large and small stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Edges that a task joins up at once.
EDGES = 1 << 18


def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """As few edges as connect the same nodes: from each node to the smallest that these edges connect it with."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    order = np.asarray(pc.sort_indices(both.dictionary), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    index = rank[both.indices.to_numpy()]
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(order))
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(len(root)))
    return both.dictionary.take(pa.array(order[at])), both.dictionary.take(pa.array(order[root[at]]))


def _stars_task(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            a, b = (pa.concat_arrays([x.column(c) for x in held]) for c in ("a", "b"))
            held.clear()
            return pa.RecordBatch.from_arrays(list(stars(a, b)), ["a", "b"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield joined()
                rows = 0
        if held:
            yield joined()

    return run


def label(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """From edges (``a``, ``b``) of any comparable type: each ``node`` and the smallest node of its component (``root``).

    Tasks join up the edges that they come across (:func:`stars`), then in a task for each ``most`` of what is left. Between
    tasks, large and small stars alternate: in a large star, each node's greater neighbours are linked to its smallest
    neighbour; in a small star, its smaller ones are. This ends when each node that has a smaller neighbour has no other,
    which takes about log n rounds, and none where one task had all edges. Each round's minima and edges are written as
    tables, so that joins read both sides through exchanges whose hot keys Spark can split."""
    edges = edges.filter("a <> b").select("a", "b")
    now = scratch.table(edges.mapInArrow(_stars_task(most), edges.schema))
    while True:
        fewer = now.coalesce(max(1, math.ceil(now.count() / most)))
        now = scratch.table(fewer.mapInArrow(_stars_task(most), now.schema))
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("g"))
        least = scratch.table(least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"), F.expr("m < a AND m < g").alias("more")))
        if not least.agg(F.max("more")).first()[0]:
            return least.select(F.col("n").alias("node"), F.col("m").alias("root"))
        large = both.join(least.select("n", "m"), F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(large.distinct())
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"))
        small = large.join(least, F.col("a") == F.col("n")).select("b", "m").filter("b <> m")
        now = scratch.table(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m")).distinct())
