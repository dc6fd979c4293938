"""Removal of repeated byte strings by longest-previous-factor arrays over sparse, truncated suffixes.

The longest previous factor of a place is the longest string from there that starts at an earlier place, too. It follows
from the suffix order: of the suffixes that start earlier, the longest common prefix is had with the one that stands nearest
before (the previous smaller position) or behind (the next smaller position). Only strings of ``Settings.length`` bytes
count, so suffixes are truncated to that many, and equal ones stand in the order of their places: the previous smaller
position of a suffix then has a common prefix of full length if and only if it is its left neighbour, and no next smaller
position has. The longest next factor, to later places, is the mirror image, with the right neighbour. A byte goes if it is
covered by a string with an earlier copy (``keep="first"``: the first copy stays) or with any copy (``keep="none"``).

No suffix meets others that it can't equal. Each string of full length has an anchor: the place in its first ``span`` bytes
with the smallest fingerprint of ``gram`` bytes. Equal strings have equal anchors, and a common core of ``length - span + 1``
bytes from there. The strings of a text with one anchor form a *part*, which holds about 1.4 times ``length`` bytes. So

1. blocks of texts name the cores of their parts, a row for each different one; what occurs once in the corpus is set aside;
2. the parts with the other cores are listed, equal ones of a block in one row, with all of their places, and dealt by core;
3. the parts of a core are suffix-sorted together by prefix doubling, which gives factors as above. A core with more than
   ``Settings.group`` rows (a passage in countless contexts) is taken apart: its parts are cut by the distance of strings from
   their anchor, in steps of the next of ``Settings.spans``. These smaller parts have longer cores, equal ones are merged, and
   they are sorted in their turn. At steps of 1, a part is one string, and there is but one for each core;
4. answers go back to the blocks, which cut the texts.

The rows of each exchange grow with the keys, not with the number of blocks. Fingerprints of 64 bits only choose who meets
whom; bytes decide (and MD5, for which parts are the same).

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; matches never cross texts; rows
with equal texts count as different places; with ``keep="first"``, of equal texts the one with the smallest id stays, and
the order of different texts is that of their digests; other columns are ignored. Long texts are worked on whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewise as B
from . import exchange as X
from . import scratch


@dataclass(frozen=True)
class Settings:
    length: int = 400  # bytes of a string that counts
    spans: tuple[int, ...] = (300, 40, 5, 1)  # bytes from a string's start in which its anchor lies, and steps for large cores
    gram: int = 16  # bytes that an anchor is chosen by
    keep: str = "none"
    block: int | None = 8 << 20  # bytes of text in a block
    group: int = 512  # rows that are suffix-sorted together, at most


#: Bits of an anchor's key that hold its place, the same for all texts: equal strings must have equal anchors.
PLACE = B.U(32)


def anchors(raw: np.ndarray, off: np.ndarray, spans: B.Spans, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all strings of full length that lie in one text, and the place of each one's anchor."""
    n = len(raw) - s.length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.repeat(off[1:], np.diff(off))[:n] - np.arange(n)
    starts = np.flatnonzero(left >= s.length)
    low = spans.windows(s.gram) >> PLACE << PLACE
    low |= np.arange(len(low), dtype=B.U)
    width = 1
    while 2 * width <= s.spans[0]:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[starts], low[starts + s.spans[0] - width])
    return starts, (low & ((B.U(1) << PLACE) - B.U(1))).astype(np.int64)


class Parts:
    """The parts of a run of texts: their first places, sizes, anchors (from there), fingerprints of cores, and texts."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, s: Settings):
        self.spans = B.Spans(raw)
        starts, anchor = anchors(raw, off, self.spans, s)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.start, at = starts[first], anchor[first]
        self.anchor = at - self.start
        self.size = np.diff(np.append(first, len(starts))) + s.length - 1
        self.core = self.spans(at, at + s.length - s.spans[0] + 1).view(np.int64)
        self.text = B.text_of(off, self.start)


def _name_cores(s: Settings):
    """The different cores of a block: how often each occurs (2: or more), and in how many different parts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, column, rows, _ = X.merged(table)
        cores, bodies, weights = [np.zeros(0, np.int64)], [np.zeros(0, B.U)], [np.zeros(0, np.int64)]
        for first, _, raw, off in B.steps(column):
            parts = Parts(raw, off, s)
            cores.append(parts.core)
            bodies.append(parts.spans(parts.start, parts.start + parts.size))
            weights.append(rows[first + parts.text])
        core, number = np.unique(np.concatenate(cores), return_inverse=True)
        n = np.minimum(np.bincount(number, np.concatenate(weights), len(core)), 2).astype(np.int32)
        different = np.unique(np.concatenate(bodies), return_index=True)[1]
        parts = np.bincount(number[different], minlength=len(core)).astype(np.int64)
        return pa.table({"core": core, "block": pa.array([key[0].as_py()] * len(core), pa.int64()), "n": n, "parts": parts})

    return run


_PART = "core long, large boolean, block long, row binary, n long, digest binary, place long, digests array<binary>, places array<bigint>, anchor int, body binary"


def _list_parts(s: Settings):
    """The parts of a block whose cores occur twice in the corpus: a row for each different one, with its places."""
    names = [x.split()[0] for x in _PART.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(key: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        block = key[0].as_py()
        digests, column, rows, _ = X.merged(table)
        order = np.argsort(wanted.column("core").to_numpy())
        cores, large = wanted.column("core").to_numpy()[order], wanted.column("large").to_numpy(zero_copy_only=False)[order]
        found: dict[bytes, list] = {}
        for first, _, raw, off in B.steps(column):
            parts = Parts(raw, off, s)
            at = np.minimum(np.searchsorted(cores, parts.core), max(0, len(cores) - 1))
            own = np.flatnonzero(cores[at] == parts.core) if len(cores) else np.zeros(0, np.int64)
            body = raw.tobytes()
            place = parts.start - off[parts.text]
            for core, big, text, start, size, anchor, p in zip(*(x[own].tolist() for x in (parts.core, large[at], parts.text, parts.start, parts.size, parts.anchor, place))):
                part = body[start : start + size]
                row = found.setdefault(hashlib.md5(part).digest(), [core, big, 0, [], [], anchor, part])
                row[2] += int(rows[first + text])
                row[3].append(digests[first + text])
                row[4].append(p)
        name = block.to_bytes(8, "big", signed=True)
        out = [(core, big, block, name + id, n, d[0], p[0], d, p, anchor, part) for id, (core, big, n, d, p, anchor, part) in found.items()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def suffix_ranks(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes from ``at``, truncated to ``length`` bytes (8 or more), in their lexicographic order; equal
    ones have equal ranks. From words of eight bytes by prefix doubling, or faster: as many ranks as fit 63 bits are joined."""
    rank = np.zeros(max(0, len(raw) - 7), B.U)
    for k in range(8):
        rank <<= B.U(8)
        rank |= raw[k : len(rank) + k]
    rank, width, bits = np.unique(rank, return_inverse=True)[1].astype(np.int64), 8, len(raw).bit_length()
    while 2 * width <= length:
        times = min(63 // bits, length // width)
        n = len(rank) - (times - 1) * width
        joined = rank[:n].copy()
        for k in range(1, times):
            joined <<= bits
            joined |= rank[k * width : n + k * width]
        rank, width = np.unique(joined, return_inverse=True)[1], width * times
    return np.unique(rank[at] << bits | rank[at + length - width], return_inverse=True)[1]


def factors(group: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous factor, and the longest next factor, of each suffix have full length, from the suffixes'
    ranks and places; suffixes of different groups don't meet."""
    order = np.lexsort((place, rank, group))
    full = np.zeros(len(order) + 1, bool)  # whether neighbours have a common prefix of full length
    full[1:-1] = (rank[order[1:]] == rank[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    previous, following = np.empty(len(order), bool), np.empty(len(order), bool)
    previous[order], following[order] = full[:-1], full[1:]
    return previous, following


def _runs(flags: np.ndarray, part: np.ndarray, offset: np.ndarray, parts: int) -> pa.Array:
    """By part, the runs of flagged strings: first and end of each, as a list."""
    at = np.flatnonzero(flags)
    new = np.ones(len(at), bool)
    new[1:] = (part[at[1:]] != part[at[:-1]]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    values = np.stack([offset[at[head]], offset[at[tail]] + 1], 1).ravel().astype(np.int32)
    edge = 2 * np.searchsorted(part[at[head]], np.arange(parts + 1))
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values))


def _same(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of parts named by rows (which end in the MD5 of the part), the first of each different one, and each one's number."""
    names = np.frombuffer(b"".join(r[-16:] for r in rows), "<u8").reshape(-1, 2)
    order = np.lexsort((names[:, 1], names[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (names[order[1:]] != names[order[:-1]]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.full(int(new.sum()), len(order))
    np.minimum.at(first, number, np.arange(len(order)))
    back = np.argsort(first)  # numbered in the order of their first places
    rank = np.empty_like(back)
    rank[back] = np.arange(len(back))
    return first[back], rank[number]


def _sort_task(s: Settings, keep: list[str]):
    """For the parts of each core, the runs of their strings that have factors of full length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in X.whole_groups(batches, "core"):
            core = table.column("core").to_numpy()
            count, n = table.column("n").to_numpy(), np.diff(np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1], [True]])))
            table = table.filter(pa.array((np.repeat(n, n) > 1) | (count > 1)))
            if not table.num_rows:
                continue
            table = table.take(pc.sort_indices(table.select(["core", "digest", "place"]), [("core", "ascending"), ("digest", "ascending"), ("place", "ascending")]))
            core, count = table.column("core").to_numpy(), table.column("n").to_numpy()
            same, number = _same(table.column("row").to_pylist())  # equal parts are sorted once, at the first of their places
            copies = np.bincount(number, count)
            alone = np.bincount(core_number := np.unique(core[same], return_inverse=True)[1])[core_number] == 1
            size = np.asarray(pc.binary_length(table.column("body")), np.int64)[same]
            strings = size - s.length + 1
            part = np.repeat(np.arange(len(same)), strings)
            offset = np.arange(len(part)) - np.repeat(np.cumsum(strings) - strings, strings)
            flags = np.zeros(len(part), bool)
            if not alone.all():  # a core's only part meets no other
                own = np.flatnonzero(~alone)
                raw = np.frombuffer(b"".join(table.column("body").take(pa.array(same[own])).to_pylist()), np.uint8)
                inside = ~alone[part]
                at = np.repeat(np.cumsum(size[own]) - size[own], strings[own]) + offset[inside]
                previous, following = factors(core[same][part[inside]], suffix_ranks(raw, at, s.length), np.arange(len(at)))
                flags[inside] = previous if s.keep == "first" else previous | following
            if s.keep != "first":
                flags |= copies[part] > 1
            runs = _runs(flags, part, offset, len(same)).take(pa.array(number))
            if s.keep == "first":
                first = np.isin(np.arange(len(number)), same).tolist()
                runs = pa.array([r if f else [0, n] for r, f, n in zip(runs.to_pylist(), first, strings[number].tolist())], runs.type)
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in keep), runs], [*keep, "hits"])

    return run


def _cut_task(s: Settings, span: int):
    """Parts cut by the distance of their strings from the anchor, in steps of ``span``."""
    names = ["core", "parent", "offset", "n", "digest", "place", "anchor", "body"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, n, digest, place, anchor, body in zip(*(batch.column(c).to_pylist() for c in ("row", "n", "digest", "place", "anchor", "body"))):
                strings = len(body) - s.length + 1
                for step in range((anchor - strings + 1) // span, anchor // span + 1):
                    head = anchor - step * span  # the last string of this step starts here
                    a, z = max(0, head - span + 1), min(strings - 1, head)
                    core = hashlib.md5(b"%d %d " % (span, step) + body[head : head - span + 1 + s.length]).digest()
                    out.append((int.from_bytes(core[:8], "little", signed=True), row, a, n, digest, place + a, anchor - a, body[a : z + s.length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def _sorted(parts: DataFrame, s: Settings, keep: list[str], shape: str) -> DataFrame:
    """Columns ``keep`` of parts, and ``hits``: the runs of their strings with factors of full length (with
    ``keep="first"``, longest previous ones)."""
    dealt = parts.select(*dict.fromkeys(["core", "row", "n", "digest", "place", "body", *keep])).repartition(scratch.partitions(parts.sparkSession), "core").sortWithinPartitions("core")
    return dealt.mapInArrow(_sort_task(s, keep), shape)


def _taken_apart(large: DataFrame, s: Settings, level: int = 1) -> DataFrame:
    """``row`` and ``hits`` of parts (``row``, ``n``, ``digest``, ``place``, ``anchor``, ``body``) with large cores."""
    smaller = large.mapInArrow(_cut_task(s, s.spans[level]), "core long, parent binary, offset int, n long, digest binary, place long, anchor int, body binary")
    smaller = scratch.table(smaller.withColumn("row", F.unhex(F.md5("body"))).withColumn("strings", F.octet_length("body") - s.length + 1))
    different = smaller.groupBy("core", "row").agg(F.sum("n").alias("n"), F.min(F.struct("digest", "place")).alias("first"), F.first("anchor").alias("anchor"), F.first("body").alias("body"))
    different = scratch.table(different.select("core", "row", "n", "first.digest", "first.place", "anchor", "body"))
    shape = "row binary, hits array<int>"
    if level + 1 < len(s.spans):
        sizes = scratch.table(different.groupBy("core").agg(F.count("*").alias("parts")).filter(F.col("parts") > s.group).select(F.col("core").alias("_core")))
        answers = _sorted(different.join(sizes, F.col("core") == F.col("_core"), "left_anti"), s, ["row"], shape)
        if not sizes.isEmpty():
            answers = answers.union(_taken_apart(different.join(sizes, F.col("core") == F.col("_core"), "left_semi"), s, level + 1))
    else:
        answers = _sorted(different, s, ["row"], shape)
    firsts = different.select(F.col("row").alias("_row"), F.struct("digest", "place").alias("_first"))
    firsts = firsts.join(answers, F.col("_row") == F.col("row"), "left").select("_row", "_first", F.coalesce("hits", F.array().cast("array<int>")).alias("_hits"))
    hits = F.col("_hits")
    if s.keep == "first":
        hits = F.when(F.struct("digest", "place") == F.col("_first"), hits).otherwise(F.array(F.lit(0), F.col("strings")))
    told = smaller.select("row", "parent", "offset", "digest", "place", "strings").join(firsts, F.col("row") == F.col("_row"))
    moved = F.transform(hits, lambda x: x + F.col("offset"))
    together = told.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("offset", moved.alias("hits")))).alias("x"))  # a few steps each
    return together.select(F.col("parent").alias("row"), F.flatten(F.transform("x", lambda x: x["hits"])).alias("hits"))


def _cut_texts(s: Settings):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        digests, column, _, _ = X.merged(table)
        number = {d: i for i, d in enumerate(digests)}
        marks: list[list[tuple[int, int]]] = [[] for _ in digests]
        for found, places, strings, hits in zip(*(answers.column(c).to_pylist() for c in ("digests", "places", "strings", "hits"))):
            for k, (digest, place) in enumerate(zip(found, places)):
                runs = hits if not k or s.keep != "first" else [0, strings]  # copies in a block are listed in order
                marks[number[digest]] += [(place + a, place + z + s.length - 1) for a, z in zip(runs[::2], runs[1::2])]
        out = []
        for first, end, raw, off in B.steps(column):
            gone = np.zeros(len(raw) + 1, np.int64)
            edges = np.array([(off[i - first] + a, off[i - first] + z) for i in range(first, end) for a, z in marks[i]], np.int64).reshape(-1, 2)
            np.add.at(gone, edges[:, 0], 1)
            np.add.at(gone, edges[:, 1], -1)
            gone = np.cumsum(gone)[:-1] > 0
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                own = gone[a:z]
                if not own.any():
                    out.append(([], 0, raw[a:z].tobytes()))
                    continue
                change = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                spans = np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)], 1)
                out.append((spans.ravel().tolist(), int(own.sum()), raw[a:z][~own].tobytes()))
        return pa.table({
            "digest": pa.array(digests, pa.binary()), "n_bytes": pa.array([len(k) + n for _, n, k in out], pa.int64()), "spans": pa.array([x for x, _, _ in out], pa.list_(pa.int64())),
            "n_removed": pa.array([n for _, n, _ in out], pa.int64()), "kept": pa.array([k for _, _, k in out], pa.binary()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for _, _, k in out]),
        })

    return run


def find(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """For each distinct text: ``digest`` (MD5), ``n_bytes``, ``spans`` (maximal removed runs, as starts and ends),
    ``n_removed``, ``kept`` (the remaining bytes) and ``kept_sha256``."""
    s = settings
    blocks, _ = X.texts(docs, text, size=s.block)
    of_block = blocks.groupBy("block")
    every = Window.partitionBy("core")
    cores = of_block.applyInArrow(_name_cores(s), "core long, block long, n int, parts long").withColumns({"copies": F.sum("n").over(every), "rows": F.sum("parts").over(every)})
    wanted = cores.filter("copies > 1").select("block", "core", (F.col("rows") > s.group).alias("large"))
    listed = scratch.table(of_block.cogroup(wanted.groupBy("block")).applyInArrow(_list_parts(s), _PART)).withColumn("strings", F.octet_length("body") - s.length + 1)
    told = ["block", "digests", "places", "strings"]
    answers = _sorted(listed.filter("not large"), s, told, "block long, digests array<binary>, places array<bigint>, strings int, hits array<int>")
    large = listed.filter("large")
    if not large.isEmpty():
        apart = _taken_apart(large, s).select(F.col("row").alias("_row"), "hits")
        answers = answers.union(large.join(apart, F.col("row") == F.col("_row")).select(*told, "hits"))
    shape = "digest binary, n_bytes long, spans array<bigint>, n_removed long, kept binary, kept_sha256 string"
    return of_block.cogroup(answers.groupBy("block")).applyInArrow(_cut_texts(s), shape)


def report(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    found = scratch.table(find(docs, settings, text).select(F.col("digest").alias("_digest"), "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256"))
    rows = docs.select(F.col(id), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"))
    if settings.keep == "first":
        smallest = scratch.table(rows.groupBy("digest").agg(F.min(id).alias("_first")).withColumnRenamed("digest", "_own"))
        rows = rows.join(smallest, F.col("digest") == F.col("_own")).withColumn("_later", ~F.col(id).eqNullSafe(F.col("_first")))
        copy = F.col("_later") & (F.col("n_bytes") >= settings.length)
        none = F.sha2(F.lit(""), 256)
        joined = rows.join(found, F.col("digest") == F.col("_digest"))
        return joined.select(id, "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(copy, none).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    return rows.join(found, F.col("digest") == F.col("_digest")).select(id, "n_bytes", "n_removed", "n_spans", "kept_sha256")
