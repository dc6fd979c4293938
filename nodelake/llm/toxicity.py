"""Toxicity by subword-bag embeddings and a linear softmax.

The subwords of a text are the character n-grams of its words, hashed to buckets that each have an embedding. The
embeddings of a passage are averaged and go through a linear softmax of two classes; embeddings and softmax are trained
jointly, so a word never seen shares the vectors of the n-grams it has in common with known ones. A text is cut into
passages of equally many words, each is scored, and the text's score is its highest: one insult in a long text counts
as much as in a short one. In training, too, a text is represented by its highest passage (its mean, in the first
rounds).

Training uses a bounded sample (``Settings.rows_each`` texts of each label, those lowest by a hash of the id, as far as
``Settings.bytes`` go; a text that doesn't fit is passed over) and runs in numpy on the driver. Since the softmax has two classes, a passage's log-odds are the mean over its n-grams of one
number by bucket, embedding . (difference of the softmax's rows); only these numbers go to the executors.

Defined results: a null, empty or wordless text has the score of an average of nothing (the bias alone); with labels of
one class only, or none, that is a constant score; repeated labels of an id count as toxic if one does; of several rows with
a labelled id the least text is learned from; repeated rows are scored each; other columns
are ignored. Long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewise as B
from . import scratch


@dataclass(frozen=True)
class Settings:
    shortest: int = 4
    longest: int = 6
    bucket_bits: int = 18
    size: int = 8
    words: int = 3
    weight: float = 4.0  # of a row with label 1
    rows_each: tuple[int, int] = (5000, 2000)  # of label 0, of label 1, at most
    bytes: int = 20 << 20  # of their texts together, at most
    rounds: int = 12
    batch: int = 128
    mean_rounds: int = 3
    rate: float = 0.15
    decay: float = 2e-3


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # log-odds by bucket
    bias: float
    settings: Settings


def passages(raw: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams in the order of passages, the passages' offsets in them, and the passages' texts."""
    grams = B.Grams(raw, off, B.LETTERS_DIGITS)
    begins = np.concatenate([np.zeros(1, bool), ~grams.space[1:] & grams.space[:-1]])
    word = np.cumsum(begins) - 1  # number of the word at or before a place
    starts = np.flatnonzero(begins)
    first_word = np.searchsorted(grams.text[starts], np.arange(len(off) - 1))
    passage_of_word = (np.arange(len(starts)) - first_word[grams.text[starts]]) // s.words
    bucket, owner = [], []
    for n in range(s.shortest, s.longest + 1):
        code, at, text = grams.of(n)
        own = word[at + grams.space[at]]
        bucket.append((B.mix(code + B.U(n << 56)) >> B.U(64 - s.bucket_bits)).astype(np.int32))
        owner.append(text << 32 | passage_of_word[own])
    bucket, owner = np.concatenate(bucket), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]]))
    return bucket[order], np.append(first, len(owner)), owner[first] >> 32


def _logits(weight: np.ndarray, bias: float, bucket: np.ndarray, edge: np.ndarray) -> np.ndarray:
    if len(edge) < 2:
        return np.zeros(0)
    return np.add.reduceat(weight[bucket], edge[:-1]) / np.diff(edge) + bias


def fit(texts: pa.Array, labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Train embeddings and softmax jointly by Adam on texts with labels 0 and 1."""
    size = 1 << s.bucket_bits
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), 0.0 if not len(labels) else (8.0 if labels.min() else -8.0), s)
    buckets, edges, owners, texts_before, grams_before = [], [], [], 0, 0
    for first, end, raw, off in B.steps(texts):
        b, e, t = passages(raw, off, s)
        buckets.append(b)
        edges.append(e[:-1] + grams_before)
        owners.append(t + first)
        grams_before += len(b)
    bucket, edge, owner = np.concatenate(buckets), np.append(np.concatenate(edges), grams_before), np.concatenate(owners)
    del buckets, edges, owners
    random = np.random.default_rng(7)
    embedding = random.normal(0, 0.1, (size, s.size)).astype(np.float32)
    softmax = random.normal(0, 1, (2, s.size)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (embedding, softmax, bias)]
    of_text = np.searchsorted(owner, np.arange(len(labels) + 1))
    batches = max(1, len(labels) // s.batch, min(64, len(labels) // 8))
    step, steps = 0, s.rounds * batches
    for round_ in range(s.rounds):
        if round_ >= s.mean_rounds:
            logit = _logits((embedding @ (softmax[1] - softmax[0])), float(bias[1] - bias[0]), bucket, edge)
            order = np.lexsort((-logit, owner))
            top = np.full(len(labels), -1)
            top[owner[order[::-1]]] = order[::-1]  # the first of each text is written last
        for batch in np.array_split(random.permutation(len(labels)), batches):
            if round_ >= s.mean_rounds:
                chosen, row = top[batch], np.arange(len(batch))
                row, chosen = row[chosen >= 0], chosen[chosen >= 0]
            else:
                lengths = of_text[batch + 1] - of_text[batch]
                row = np.repeat(np.arange(len(batch)), lengths)
                chosen = np.repeat(of_text[batch] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            n = edge[chosen + 1] - edge[chosen]
            at = np.repeat(edge[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
            ids, rows = bucket[at], np.repeat(row, n)
            total = np.maximum(np.bincount(rows, minlength=len(batch)), 1)
            value = 1.0 / total[rows]
            delta = softmax[1] - softmax[0]
            z = np.bincount(rows, value * (embedding @ delta)[ids], len(batch)) + bias[1] - bias[0]
            wrong = (1 / (1 + np.exp(-z)) - labels[batch]) * np.where(labels[batch] == 1, s.weight, 1.0) / len(batch)  # d loss / d log-odds
            pull = np.bincount(ids, value * wrong[rows], size).astype(np.float32)
            d_delta = pull @ embedding
            gradients = (pull[:, None] * delta, np.stack([-d_delta, d_delta]), np.array([-wrong.sum(), wrong.sum()], np.float32))
            step += 1
            for x, g, m in zip((embedding, softmax, bias), gradients, moments):
                if x is embedding:
                    g = g + np.float32(s.decay / len(labels)) * x
                m[0] += np.float32(0.1) * (g - m[0])
                m[1] += np.float32(0.01) * (g * g - m[1])
                x -= np.float32(s.rate * (1.02 - step / steps) / (1 - 0.9**step)) * m[0] / (np.sqrt(m[1] / np.float32(1 - 0.99**step)) + np.float32(1e-7))
    return Model((embedding @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0]), s)


def sample(docs: DataFrame, labels: DataFrame, s: Settings, id: str, text: str, label: str) -> tuple[pa.Array, np.ndarray]:
    """The bounded training sample: ids are chosen first, then their texts are fetched."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).alias("_toxic")).dropna().groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = None
    for value, rows in enumerate(s.rows_each):
        part = known.filter(F.col("_toxic") == value).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.toPandas()  # of sum(rows_each) rows at most, so they can be broadcast
    few = docs.sparkSession.createDataFrame(ids, T.StructType([T.StructField("_id", docs.schema[id].dataType), T.StructField("_toxic", T.IntegerType())]))
    found = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(few), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    found = scratch.table(found.withColumn("_bytes", F.coalesce(F.octet_length("_text"), F.lit(0))))
    left, fits = s.bytes, []
    for r in found.select("_id", "_bytes", F.xxhash64("_id").alias("_hash")).orderBy("_hash", "_id").collect():  # sizes alone
        if r["_bytes"] <= left:
            left -= r["_bytes"]
            fits.append((r["_id"],))
    kept = F.broadcast(docs.sparkSession.createDataFrame(fits, T.StructType([T.StructField("_id", docs.schema[id].dataType)])))
    got = found.join(kept, "_id", "left_semi").select("_id", "_toxic", F.lower("_text").alias("_text")).toArrow().sort_by([("_id", "ascending")])
    return got["_text"].combine_chunks(), got["_toxic"].to_numpy().astype(np.int64)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (the probability of label 1, from the text alone) and ``predicted`` in place of the text."""
    kept = [c for c in docs.columns if c not in (text, "score", "predicted")]
    shape = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            logit = np.full(batch.num_rows, -np.inf)
            for first, _, raw, off in B.steps(batch.column(batch.num_columns - 1)):
                bucket, edge, owner = passages(raw, off, m.settings)
                np.maximum.at(logit, owner + first, _logits(m.weight, m.bias, bucket, edge))
            logit[np.isinf(logit)] = m.bias
            out = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out), pa.array((out >= threshold).astype(np.int32))], shape.names)

    return docs.select(*kept, F.lower(F.col(text))).mapInArrow(run, shape)


def detect(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Learn from labels outside the held-out fold, score all documents: id, ``held_out``, ``score``, ``predicted``."""
    held_out = F.coalesce(F.crc32(F.col(id).cast("string")) % folds == fold, F.lit(False))
    model = fit(*sample(docs, labels.filter(~held_out), settings, id, text, label), settings)
    return score(docs.select(F.col(id), held_out.alias("held_out"), F.col(text)), model, text=text)
