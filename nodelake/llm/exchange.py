"""Asking questions about sorted keys between blocks of texts and buckets of keys.

Some statistics need every occurrence of a key that most texts don't share (all windows of the corpus, all word pairs), too
many for a row each. So texts are dealt into blocks of bounded size; a block sends each bucket of keys one row with all of
its own distinct keys that fall into the bucket, packed; a bucket answers each block with one value for each key sent, in
the same order. However often a key occurs, a bucket gets it once from each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as B

#: Bytes of text in a block.
BLOCK = 12 << 20


def squeezed(raw) -> bytes:
    """Texts and numbers are packed before they are shuffled: most numbers are small, and what is sent is read several times."""
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def expanded(packed, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True) if size else b""


def texts(docs: DataFrame, text: str, weight: Column | None = None, size: int | None = None) -> tuple[DataFrame, int]:
    """Distinct texts dealt into blocks (``block``, ``digest``, ``text``: compressed, ``size``: its bytes, ``rows``, ``weight``: the sum over the rows of a
    0/1 column), and the number of blocks, of about ``size`` bytes of text each. Copies are merged as they are read, batch
    by batch, so that a text with many copies is sent a few times only; who gets a block merges the rest."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = int(total // (size or BLOCK)) + 1
    rows = docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.lit(1) if weight is None else weight.cast("int")).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first, inverse, count = np.unique(_digests(batch.column(0)), return_index=True, return_inverse=True, return_counts=True)
            weights = np.bincount(inverse, batch.column(2).to_numpy(), len(first)).astype(np.int64)
            own = batch.take(pa.array(first))
            block = np.frombuffer(b"".join(own.column(0).to_pylist()), "<u8")[::2] % B.U(blocks) if len(first) else np.zeros(0, np.int64)
            packed = pa.array([squeezed(x.as_buffer()) for x in own.column(1)], pa.binary())
            size = pa.array(np.asarray(pc.binary_length(own.column(1)), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), own.column(0), packed, size, pa.array(count.astype(np.int64)), pa.array(weights)], ["block", "digest", "text", "size", "rows", "weight"])

    return rows.mapInArrow(run, "block long, digest binary, text binary, size long, rows long, weight long"), blocks


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), [("a", "<u8"), ("b", "<u8")])


def merged(table: pa.Table) -> tuple[list[bytes], pa.Array, np.ndarray, np.ndarray]:
    """A block's texts in the order of their digests, each once: digests, texts, rows and weights."""
    if not table.num_rows:
        return [], pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    digest = table.column("digest").to_pylist()
    order: dict[bytes, int] = {}
    for i, d in enumerate(digest):
        order.setdefault(d, i)
    names = sorted(order)
    at = {d: k for k, d in enumerate(names)}
    place = np.array([at[d] for d in digest])
    first, size = [order[d] for d in names], table.column("size").to_numpy()
    body, edge = table.column("text"), np.concatenate([[0], np.cumsum(size[first])]).astype(np.int64)
    raw = b"".join(expanded(body[i].as_buffer(), int(size[i])) for i in first)
    texts = pa.Array.from_buffers(pa.large_string(), len(names), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(raw)])
    sums = [np.bincount(place, table.column(c).to_numpy(), len(names)).astype(np.int64) for c in ("rows", "weight")]
    return names, texts, *sums


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables in which no run of equal keys is cut."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = table.column(key).to_numpy()
        last = int(np.flatnonzero(keys[1:] != keys[:-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None:
        yield rest


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys; a bucket is a range of the keys."""
    bounds = np.array([(b << 64) // buckets for b in range(buckets)], B.U)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def small(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, compressed."""
    top = int(values.max(initial=0))
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if top < 1 << (8 * np.dtype(k).itemsize))
    raw = values.astype(kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + len(raw).to_bytes(5, "little") + squeezed(raw)


def large(packed: bytes) -> np.ndarray:
    raw = expanded(packed[6:], int.from_bytes(packed[1:6], "little"))
    return np.frombuffer(raw, f"<u{packed[0]}").astype(np.int64)
