"""Benchmark decontamination by q-gram filtering and banded alignment.

Passages of a benchmark text are parts of equal size, of ``Settings.passage`` bytes at most (a short text is one), and
besides windows of ``Settings.window`` bytes, one every ``Settings.stride``. So a verbatim copy of any
window + stride - 1 bytes holds a passage whole. A passage of m bytes that occurs in a document with at most e edits
shares at least m + 1 - q (e + 1) of its q-grams with the place where it occurs, all on diagonals at most e apart (the
q-gram lemma). So shared q-grams are counted by section of a benchmark text and diagonal band, then by passage of the
sections that hold enough of them; bands overlap by half, so that any such group of diagonals is whole in one of them.
Regions whose count reaches the bound are aligned with the passage in a band of diagonals, and kept if the alignment
takes at most e edits. A benchmark text of less than ``Settings.least`` bytes is searched as it is, without edits, and
counts where no letter or digit goes on at either end. Case is folded for all of Unicode and any run of
white space counts as one space before comparison; edits are counted in bytes of the folded text.

The benchmark is read in blocks of bounded size, each compared with all documents; all texts of an item are in one block (an
item of more than that makes a larger one). Where a q-gram is frequent in a document and in the benchmark, shared q-grams are
counted in portions, so that repetitive text takes time but no more memory.

Defined results: null and empty documents match nothing, nor do blank benchmark texts; of passages that overlap in their
benchmark text, that with fewest edits counts; a document with several copies of a passage yields one row with the best of them; repeated
rows yield repeated results; an empty benchmark yields no rows; other columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import bytewise as B


@dataclass(frozen=True)
class Settings:
    passage: int = 128  # bytes of a passage, at most
    window: int = 64  # bytes of the passages that overlap
    stride: int = 16  # bytes from one of those to the next
    least: int = 40  # bytes of a benchmark text that is searched with edits, at least
    edits: float = 0.08  # of a passage's bytes
    block: int = 2 << 20  # bytes of the benchmark that are compared at once
    portion: int = 1 << 21  # shared q-grams that are counted at once


#: Bytes of a q-gram: eight fill one 64-bit number.
Q = 8
#: Bytes of a benchmark text in which the passages of a section begin.
SECTION = 1024


def _table() -> np.ndarray:
    out = B.LOWER.copy()
    out[B.SPACE] = 32
    out[0] = 32
    return out


FOLD = _table()


@cache
def _uneven() -> tuple[re.Pattern, dict[str, int]]:
    """The characters whose folded form takes another number of bytes, and by how many more."""
    more = {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        if (low := c.casefold()) != c and (n := len(low.encode()) - len(c.encode())):
            more[c] = n
    return re.compile(f"[{''.join(map(re.escape, more))}]"), more


def folded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int], int]]:
    """A run of texts with case folded and single spaces, the offsets of its texts, and what takes a place in it back to one
    in ``raw``."""
    out, off, back = _case_folded(raw, off)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[off[:-1][off[:-1] < len(out)]] = True  # a text's first byte
    if keep.all():
        return out, off, back
    place, after = np.append(np.flatnonzero(keep), len(out)), np.concatenate([[0], np.cumsum(keep)])
    return out[keep], after[off], lambda z: back(int(place[z]))


def _case_folded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int], int]]:
    if not (raw >= 0x80).any():
        return FOLD[raw], off, int
    text = raw.tobytes().decode("utf-8", "surrogateescape")
    out = FOLD[np.frombuffer(text.casefold().encode("utf-8", "surrogateescape"), np.uint8)]
    pattern, more = _uneven()
    odd = [(m.start(), more[m.group()]) for m in pattern.finditer(text)] if (raw >= 0xC4).any() else []
    if not odd:  # characters below U+0100 keep their size
        return out, off, int
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xDC80) & (code <= 0xDCFF)] = 1  # a byte that is no UTF-8
    before = np.concatenate([[0], np.cumsum(size)])
    at, n = np.array(odd).T
    size[at] += n
    after = np.concatenate([[0], np.cumsum(size)])

    def back(z: int) -> int:
        k = int(np.searchsorted(after, z, "right")) - 1
        return min(int(before[k]) + z - int(after[k]), int(before[min(k + 1, len(code))]))

    return out, after[np.searchsorted(before, off)], back


def _grams(a: np.ndarray) -> np.ndarray:
    """All q-grams as 64-bit numbers."""
    n = len(a) - Q + 1
    out = np.empty(max(0, n), B.U)
    for shift in range(min(Q, max(0, n))):
        out[shift::Q] = np.frombuffer(a.tobytes(), "<u8", (len(a) - shift) // Q, shift)[: len(out[shift::Q])]
    return out


def _goes_on(a: str, b: str) -> bool:
    """Whether two neighbouring characters are within one word, or number, of a script with case."""
    inner = lambda c: c.isdigit() or c.lower() != c.upper()
    return bool(a and b) and inner(a) and inner(b)


class Passages:
    """The passages of a block of benchmark texts and an index of their q-grams."""

    def __init__(self, items: list[tuple[object, str]], s: Settings):
        self.items, self.row, self.short = [], [], []
        begin, size, sections, texts, bodies, codes, places = [], [], [], [], [], [], []
        base = 0
        for row, (item, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            a = folded(raw, np.array([0, len(raw)]))[0]
            if len(a) < s.least:
                if a.tobytes().strip():
                    self.short.append((row, item, a.tobytes().strip()))
                continue
            edge = np.cumsum([0, *(len(x) for x in np.array_split(a, max(1, -(-len(a) // s.passage))))]).tolist()
            parts = set(zip(edge[:-1], edge[1:]))
            if len(a) > s.window:
                parts |= {(i, i + s.window) for i in (*range(0, len(a) - s.window, s.stride), len(a) - s.window)}
            parts = sorted(parts)
            grams, reach = _grams(a), max(z - i for i, z in parts)
            for first in range(0, len(a), SECTION):
                own = parts[bisect(parts, (first,)) : bisect(parts, (first + SECTION,))]
                if not own:
                    continue
                within = grams[first : first + SECTION + reach]
                codes.append(within)
                places.append(len(sections) << 32 | np.arange(len(within)))
                sections.append((len(self.items), len(self.items) + len(own)))
                for i, z in own:
                    self.items.append(item)
                    self.row.append((row, i, z))
                    begin.append(i - first)
                    size.append(z - i)
                    bodies.append(base + i)
            texts.append(a)
            base += len(a)
        self.body = np.concatenate([np.zeros(0, np.uint8), *texts])
        self.body_at = np.array(bodies, np.int64)
        self.begin, self.sizes = np.array(begin, np.int64), np.array(size, np.int64)
        self.sections = np.array(sections, np.int64).reshape(-1, 2)
        self.edits = (self.sizes * s.edits).astype(np.int64)
        self.bound = np.maximum(self.sizes + 1 - Q * (self.edits + 1), 1)
        self.least = np.minimum.reduceat(self.bound, self.sections[:, 0]) if len(self.sections) else self.bound
        self.reach, self.portion = int(self.edits.max(initial=0)) + 1, s.portion
        every = np.concatenate([np.zeros(0, B.U), *codes])
        order = np.argsort(every, kind="stable")
        self.codes, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        place = np.concatenate([np.zeros(0, np.int64), *places])[order]
        self.section, self.offset = place >> 32, place & ((1 << 32) - 1)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self._slot(self.codes)] = True
        self.n_long = len(self.items)
        for row, item, text in self.short:
            self.items.append(item)
            self.row.append((row, 0, len(text)))
        self._scan = None

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * B.U(0x9E3779B97F4A7C15)) >> B.U(44)

    def candidates(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and first diagonals of the bands that hold as many shared q-grams as the bound asks for."""
        codes = _grams(a)
        at = np.flatnonzero(self.bitmap[self._slot(codes)])
        place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        known = self.codes[place] == codes[at]
        at, place = at[known], place[known]
        n = self.count[place]
        cut = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), self.portion), "left")
        portions = [slice(a, z) for a, z in zip(np.unique(cut), [*np.unique(cut)[1:], len(n)]) if z > a]

        def shared(p: slice) -> tuple[np.ndarray, np.ndarray]:
            """Section and diagonal band, and offset in the section, of each shared q-gram."""
            m = n[p]
            entry = np.repeat(self.first[place[p]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            offset = self.offset[entry]
            return self.section[entry] << 32 | (np.repeat(at[p], m) - offset + (1 << 30)) // self.reach, offset

        # a band's pair holds its own diagonals and the next band's
        keys, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in portions:
            key, _ = shared(p)
            some, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys, number = np.unique(np.concatenate([keys, some]), return_inverse=True)
            sizes = np.bincount(number, np.concatenate([sizes, count]), len(keys)).astype(np.int64)
        keys = keys[sizes >= self.least[keys >> 32]] if len(keys) else keys
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = []
        for p in portions:
            key, offset = shared(p)
            for k in (key, key - 1):
                group = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                own = keys[group] == k
                held.append(np.unique(group[own] << 32 | offset[own]))
        held = np.unique(np.concatenate(held))  # each q-gram of a passage counts once in a band
        passages, groups = [], []
        for a in range(0, len(keys), 1 << 12):
            span = self.sections[keys[a : a + (1 << 12)] >> 32]
            m = span[:, 1] - span[:, 0]
            group = np.repeat(np.arange(a, a + len(m)), m)
            passage = np.repeat(span[:, 0] - np.cumsum(m) + m, m) + np.arange(m.sum())
            low = group << 32 | self.begin[passage]
            enough = np.searchsorted(held, low + self.sizes[passage] - Q, "right") - np.searchsorted(held, low) >= self.bound[passage]
            passages.append(passage[enough])
            groups.append(group[enough])
        passage, band = np.concatenate(passages), keys[np.concatenate(groups)] & ((1 << 32) - 1)
        return passage, band * self.reach - (1 << 30) + self.begin[passage]

    def align(self, a: np.ndarray, passage: np.ndarray, diagonal: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits between each passage and a part of ``a`` in [low, high) near its diagonals, and that part's end.

        The rows of all alignments are filled together; column k of row i stands for the text's first i + k bytes from
        ``start``."""
        width = 4 * self.reach + 1
        start = diagonal - self.reach
        columns = np.arange(width)
        size = self.sizes[passage]
        place = self.body_at[passage][:, None] + np.arange(int(size.max(initial=0)))
        pattern = self.body[np.minimum(place, len(self.body) - 1)]  # what goes beyond a passage's end is not looked at
        cost = np.zeros((len(passage), width), np.int32)
        cost[(start[:, None] + columns < low[:, None]) | (start[:, None] + columns > high[:, None])] = 1 << 20
        best, end = np.full(len(passage), 1 << 20), np.zeros(len(passage), np.int64)
        for i in range(pattern.shape[1]):
            at = start[:, None] + i + columns
            inside = (at >= low[:, None]) & (at < high[:, None])
            text = np.where(inside, a[np.clip(at, 0, len(a) - 1)], 0)
            new = cost + (text != pattern[:, i : i + 1]) + np.where(inside, 0, 1 << 20)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = (np.minimum.accumulate(new - columns, 1) + columns).astype(np.int32)
            done = size == i + 1
            if done.any():
                k = cost.argmin(1)
                best[done], end[done] = cost[done, k[done]], (start + i + 1 + k)[done]
        return best, end

    def matches(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Text, passage, edits, start and end (bytes in its text) of each passage found in a run of texts."""
        if not len(raw):
            return []
        a, off, back = folded(raw, off)
        place = lambda t, z: back(max(int(off[t]), z)) - back(int(off[t]))
        out = [(t, p, 0, place(t, start), place(t, end)) for t, p, start, end in self.whole(a, off)]
        if len(a) < Q or not len(self.codes):
            return out
        passage, diagonal = self.candidates(a)
        # a band near the border of two texts can belong to either
        first = B.text_of(off, np.clip(diagonal, 0, len(a) - 1))
        last = B.text_of(off, np.clip(diagonal + 2 * self.reach + self.sizes[passage], 0, len(a) - 1))
        n = last - first + 1
        text = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        passage, diagonal = np.repeat(passage, n), np.repeat(diagonal, n)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i in range(0, len(text), 256):
            part = slice(i, i + 256)
            edits, end = self.align(a, passage[part], diagonal[part], off[text[part]], off[text[part] + 1])
            for t, p, e, z in zip(text[part].tolist(), passage[part].tolist(), edits.tolist(), end.tolist()):
                if e <= self.edits[p]:
                    best[t, p] = min(best.get((t, p), (e, z)), (e, z))
        return out + [(t, p, e, place(t, z - int(self.sizes[p])), place(t, z)) for (t, p), (e, z) in sorted(best.items())]

    def whole(self, a: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Text, number, start and end of the first place of each short benchmark text in each of a run of texts."""
        if not self.short:
            return []
        if self._scan is None:  # each worker builds its own
            self._scan = ahocorasick.Automaton()
            for k, (_, _, text) in enumerate(self.short):
                key = text.decode("latin-1")
                self._scan.add_word(key, (len(key), [*(self._scan.get(key, (0, []))[1]), k]))
            self._scan.make_automaton()
        found: dict[tuple[int, int], tuple[int, int]] = {}
        body = a.tobytes()
        character = lambda low, high, k: body[low:high].decode(errors="ignore")[k : k + 1 or None]
        for last, (size, numbers) in self._scan.iter(body.decode("latin-1")):
            start, end = last + 1 - size, last + 1
            t = int(B.text_of(off, np.int64(start)))
            if end > off[t + 1] or all((t, self.n_long + k) in found for k in numbers):
                continue
            before, after = character(max(int(off[t]), start - 4), start, -1), character(end, min(int(off[t + 1]), end + 4), 0)
            if not _goes_on(before, character(start, min(end, start + 4), 0)) and not _goes_on(character(max(start, end - 4), end, -1), after):
                for k in numbers:
                    found.setdefault((t, self.n_long + k), (start, end))
        return [(t, p, start, end) for (t, p), (start, end) in sorted(found.items())]

    def __getstate__(self):
        return self.__dict__ | {"_scan": None}


def blocks(benchmark: DataFrame, s: Settings, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of about ``s.block`` bytes, chosen by a hash of the item."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = total // s.block + 1
    for part in range(parts):
        yield [(r.i, r.t) for r in sorted(rows.filter(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(parts)) == part).collect(), key=lambda r: (str(r.i), r.t))]


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark text of which it holds a passage: the document's id, the item's id,
    ``passages`` (how many that don't overlap), ``edits`` (in them), ``start`` and ``end`` (bytes; within the edits)."""
    spark = docs.sparkSession
    shape = T.StructType([docs.schema[id], benchmark.schema[item], *(T.StructField(n, T.LongType()) for n in ("passages", "edits", "start", "end"))])
    found = None
    for rows in blocks(benchmark, settings, item, item_text):
        part = docs.select(F.col(id), F.col(text)).mapInArrow(_search(spark.sparkContext.broadcast(Passages(rows, settings)), shape), shape)
        found = part if found is None else found.unionByName(part)
    return found


def _search(shared, shape: T.StructType):
    kind = to_arrow_type(shape.fields[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Passages = shared.value
        for batch in batches:
            out: dict[tuple[int, object], list[int]] = {}
            taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for first, _, raw, off in B.steps(batch.column(1)):
                for t, p, edits, start, end in sorted(index.matches(raw, off), key=lambda m: (m[0], m[2], m[1])):
                    got = out.setdefault((first + t, index.items[p]), [0, 0, start, end])
                    row, a, z = index.row[p]
                    others = taken.setdefault((first + t, row), [])
                    k = bisect(others, (a, z))
                    if (not k or others[k - 1][1] <= a) and (k == len(others) or others[k][0] >= z):
                        others.insert(k, (a, z))
                        got[:2] = got[0] + 1, got[1] + edits
                    got[2:] = min(got[2], start), max(got[3], end)
            rows = sorted(out.items(), key=lambda x: (x[0][0], str(x[0][1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k[0] for k, _ in rows], pa.int64())), pa.array([k[1] for k, _ in rows], kind), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(4))],
                shape.names,
            )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns."""
    spark, out = docs.sparkSession, docs
    for rows in blocks(benchmark, settings, item, item_text):
        out = out.mapInArrow(_without(spark.sparkContext.broadcast(Passages(rows, settings)), text), docs.schema)
    return out


def _without(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, _, raw, off in B.steps(batch.column(text)):
                keep[[first + m[0] for m in shared.value.matches(raw, off)]] = False
            yield batch.filter(pa.array(keep))

    return run
