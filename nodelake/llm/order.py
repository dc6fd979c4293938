"""Numbering the rows of a table in a global order without gathering them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch


def number(df: DataFrame, by: list[str], weight: str | None = None, to: str = "rank") -> DataFrame:
    """``df`` with, in ``to``, the number (or summed weight) of rows before each in the order of ``by``.

    Rows are dealt out by ranges of the order and numbered within each range; the sums of the ranges (as many as
    partitions) are added up by the driver. Rows equal in ``by`` get different numbers."""
    shape = T.StructType([*df.schema.fields, T.StructField(to, T.LongType()), T.StructField("_part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(weight).to_numpy(zero_copy_only=False) if weight else np.ones(batch.num_rows, np.int64)
            sums = np.cumsum(own) + total
            before = sums - own
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before.astype(np.int64)), pa.array(np.full(batch.num_rows, part, np.int32))], shape.names)

    ranged = df.repartitionByRange(scratch.partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    out = scratch.table(ranged.mapInArrow(run, shape))
    sums = out.groupBy("_part").agg(F.sum(weight if weight else F.lit(1)).alias("n")).orderBy("_part").collect()
    before, rows = 0, []
    for s in sums:
        rows.append((s["_part"], before))
        before += s["n"]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    return out.join(F.broadcast(offsets), "_part").withColumn(to, F.col(to) + F.col("_before")).drop("_part", "_before")
