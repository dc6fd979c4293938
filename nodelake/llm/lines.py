"""Deduplication of runs of lines by a suffix array over line ids.

All documents' lines stand behind each other in one global sequence, in the order of (id, digest of the text), with an
empty place between documents. Lines that occur once can be in no repeated run and drop out; the others get ranks in the
order of their fingerprints. Prefix doubling then ranks pairs of neighbouring runs: the rank of the 2h lines from a place
on is that of (rank of its first h lines, rank of the next h), found by a distributed sort of the distinct pairs; pairs
that occur once drop out again. Places of equal rank at length h form an interval of the suffix array whose longest
common prefix is h lines or more.

A run counts if it has ``Settings.words`` words. Each line in a repeated run that counts is in a shortest such run that
starts or ends at some place, and whether that has an earlier copy is read off the ranks: two runs of n lines are equal if
the ranks of their first and of their last 2^k lines are, with 2^k the largest power up to n. The lines of all runs with an
earlier copy, which together make up the maximal repeated runs, are deleted; the first copy stays.

Defined results: a null text has no lines and stays null; an empty text has one empty line; rows equal in id and text are
one document and get equal results; rows with equal ids and other texts are different documents; null ids come first in
the order; other columns stay as they are. A document may lose all of its lines; its text is then empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from . import order, scratch


@dataclass(frozen=True)
class Settings:
    words: int = 50  # of a run that counts


def _shortest(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line of one document, the lines in the shortest run that counts and starts (ends) there; 0: none."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    last = np.searchsorted(sums, sums[:-1] + least, "left")
    forward = np.where(last <= n, last - np.arange(n), 0)
    first = np.searchsorted(sums, sums[1:] - least, "right") - 1
    backward = np.where(sums[1:] >= least, np.arange(n) + 1 - first, 0)
    return np.maximum(forward, 0), backward


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the number of the first line of each text."""
    breaks = np.flatnonzero(raw == 10)
    owner = B.text_of(off, breaks)
    n = np.bincount(owner, minlength=len(off) - 1) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    at = np.arange(len(breaks)) + owner
    ends[at], starts[at + 1] = breaks, breaks + 1
    starts[first[:-1]], ends[first[1:] - 1] = off[:-1], off[1:]
    return starts, ends, first


def _lines_task(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, raw, off in B.steps(batch.column(2)):
                starts, ends, first = line_spans(raw, off)
                spans = B.Spans(raw)
                name = spans(starts, ends)
                words, _ = B.word_spans(raw, off)
                inside = np.searchsorted(words, ends) - np.searchsorted(words, starts)
                forward, backward = np.zeros(len(name), np.int64), np.zeros(len(name), np.int64)
                for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                    forward[a:z], backward[a:z] = _shortest(inside[a:z], s.words)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (name.view(np.int64), forward, backward)]
                rows = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], ["id", "digest", "name", "forward", "backward"])

    return run


def _levels(places: DataFrame, longest: int) -> Iterator[tuple[int, DataFrame]]:
    """For h = 1, 2, 4, ... up to ``longest``: (``place``, ``rank``) of the runs of h lines that occur twice or more."""
    names = scratch.table(places.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"))
    ranked = scratch.table(order.number(names, ["name"]))
    level, h = scratch.table(places.join(ranked, "name").select("place", "rank")), 1
    while True:
        yield h, level
        if 2 * h > longest:
            return
        after = level.select((F.col("place") - h).alias("place"), F.col("rank").alias("next"))
        pairs = scratch.table(level.join(after, "place"))
        twice = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rank").alias("r"), F.col("next").alias("x"))
        ranked = scratch.table(order.number(twice, ["r", "x"], to="both"))
        level = scratch.table(pairs.join(ranked, (F.col("rank") == F.col("r")) & (F.col("next") == F.col("x"))).select("place", F.col("both").alias("rank")))
        h *= 2


def runs(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of lines to delete: the document's ``id`` and ``digest`` (MD5 of the text), and ``runs`` (first line, lines)."""
    own = docs.select(F.col(id).alias("id"), F.unhex(F.md5(F.col(text))).alias("digest"), F.col(text).alias("text")).filter("text is not null")
    shape = f"id {docs.schema[id].dataType.simpleString()}, digest binary, name array<bigint>, forward array<bigint>, backward array<bigint>"
    listed = scratch.table(own.mapInArrow(_lines_task(settings), shape))
    sizes = listed.groupBy("id", "digest").agg((F.max(F.size("name")) + 1).cast("long").alias("n"))
    base = scratch.table(order.number(sizes, ["id", "digest"], "n", "base").select(F.col("id").alias("i"), F.col("digest").alias("d"), "base"))
    placed = listed.dropDuplicates(["id", "digest"]).join(base, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")))
    exploded = placed.select("base", F.posexplode(F.arrays_zip("name", "forward", "backward")).alias("at", "x"))
    lines = scratch.table(exploded.select((F.col("base") + F.col("at")).alias("place"), "base", "x.name", "x.forward", "x.backward"))

    longest = lines.agg(F.max(F.greatest("forward", "backward"))).first()[0] or 1
    levels = list(_levels(lines, longest))
    able = lines.join(levels[0][1].select("place"), "place")
    windows = able.filter("forward > 0").select(F.col("place").alias("start"), F.col("forward").alias("n"), "base").union(
        able.filter("backward > 0").select((F.col("place") - F.col("backward") + 1).alias("start"), F.col("backward").alias("n"), "base"))
    windows = scratch.table(windows.distinct())
    later = None
    for h, level in levels:
        head, tail = level.select(F.col("place").alias("start"), F.col("rank").alias("head")), level.select(F.col("place").alias("last"), F.col("rank").alias("tail"))
        mine = windows.filter(F.col("n").between(h, 2 * h - 1)).withColumn("last", F.col("start") + F.col("n") - h)
        mine = scratch.table(mine.join(head, "start").join(tail, "last"))
        first = scratch.table(mine.groupBy("n", "head", "tail").agg(F.min("start").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("n").alias("n1"), F.col("head").alias("h1"), F.col("tail").alias("t1"), "first"))
        part = mine.join(first, (F.col("n") == F.col("n1")) & (F.col("head") == F.col("h1")) & (F.col("tail") == F.col("t1"))).filter("start > first")
        part = part.select("base", F.struct((F.col("start") - F.col("base")).alias("line"), "n").alias("run"))
        later = part if later is None else later.union(part)
    of_doc = later.groupBy("base").agg(F.collect_list("run").alias("runs"))  # as many as a document has lines, twice at most
    return scratch.table(of_doc.join(base, "base").select(F.col("i").alias("id"), F.col("d").alias("digest"), "runs"))


def _delete(text: str, found: list[dict]) -> tuple[str, int, int, int]:
    """The lines that stay; how many there were, how many went, and in how many maximal runs."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for run in found:
        gone[run["line"]] += 1
        gone[run["line"] + run["n"]] -= 1
    out = np.cumsum(gone)[:-1] > 0
    return "\n".join(line for line, x in zip(lines, out) if not x), len(lines), int(out.sum()), int((np.diff(np.concatenate([[0], out])) > 0).sum())


def _joined(docs: DataFrame, settings: Settings, id: str, text: str) -> DataFrame:
    found = runs(docs, settings, id, text).select(F.col("id").alias("__own_id"), F.col("digest").alias("__own_digest"), F.col("runs").alias("__runs"))
    digest = F.unhex(F.md5(F.col(text)))
    found = found.hint("merge")  # grows with the documents, so the plan shouldn't turn on its size
    return docs.join(found, docs[id].eqNullSafe(F.col("__own_id")) & (digest == F.col("__own_digest")), "left").drop("__own_id", "__own_digest")


def dedup(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of later copies deleted from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(text).to_pylist()
            out = [x if not f else _delete(x, f)[0] for x, f in zip(texts, found)]
            columns = [pa.array(out, pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns)][:-1]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return _joined(docs, settings, id, text).mapInArrow(run, docs.schema)


def report(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its id, ``n_lines``, ``n_removed``, ``n_runs`` (maximal), ``kept_sha256`` of the lines that stay."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [("", 0, 0, 0) if x is None else _delete(x, f or []) for x, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, B.strings([hashlib.sha256(r[0].encode()).hexdigest() for r in rows])], ["id", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    slim = _joined(docs.select(id, text), settings, id, text)
    return slim.mapInArrow(run, f"id {kind}, n_lines long, n_removed long, n_runs long, kept_sha256 string").withColumnRenamed("id", id)
