"""Vectorised work on the bytes of a column of texts.

The operators that need Python take Arrow batches and treat the texts of a batch as one byte array with offsets, so no
Python object is made per word or character. A null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. The arrays of 8 bytes per byte then stay small.
STEP = 1 << 19
#: Bytes of text after which a worker gives freed memory back, so that it doesn't hold it while the JVM needs it.
RELEASE = 8 << 20

U = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _word_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


#: Bytes between words.
SPACE = _word_space()
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column and the offsets of its texts in them (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_since = [0]
_kept: dict[Hashable, object] = {}


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def release(worked: int) -> None:
    """Give freed memory back to the system, once in ``RELEASE`` bytes of text."""
    _since[0] += worked
    if _since[0] >= RELEASE:
        _since[0] = 0
        _trim()


def keep[X](key: Hashable, make: Callable[[], X]) -> X:
    """What an operator keeps in a worker from task to task: one thing at a time, until a task of another operator comes."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Give back what another operator kept in this worker; workers live on, and are handed to any later task."""
    if _kept:
        _kept.clear()
        gc.collect()  # what was kept may refer to itself
        _trim()


def steps(column: pa.Array | pa.ChunkedArray, most: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of texts of ``most`` bytes together (or one longer text): first, end, bytes, offsets."""
    forget()
    raw, off = buffer_of(column)
    first, n = 0, len(off) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end
    release(len(raw))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; words end where their text ends."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    return starts, np.flatnonzero(word & (~after | edge[1:])) + 1


def text_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(off, at, "right") - 1


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP + STEP // 4)
        _powers[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, p, U))]) for p in (_PRIME, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on all input bits (the public splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Spans:
    """64-bit fingerprints of any spans of a byte array, from one pass over it."""

    def __init__(self, raw: np.ndarray):
        self.power, self.inverse = _power_tables(len(raw) + 1)
        sums = np.empty(len(raw) + 1, U)
        sums[0] = 0
        np.cumsum(_byte_values()[raw] * self.power[: len(raw)], out=sums[1:])
        self.sums = sums

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(out + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))

    def windows(self, length: int) -> np.ndarray:
        """The fingerprint of each window of this length, in order of the windows' starts."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as differences without the bytes that are zero in all of them."""
    if not len(keys):
        return b"\x00"
    gaps = np.empty_like(keys)
    gaps[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=gaps[1:])
    first, rest = int(gaps[0]), gaps[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    planes = np.ascontiguousarray(rest.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + first.to_bytes(8, "little") + planes.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    width = packed[0]
    if not width:
        return np.zeros(0, U)
    planes = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(planes) + 1, 8), np.uint8)
    gaps[1:, :width] = planes
    out = gaps.view("<u8").ravel().astype(U)
    out[0] = int.from_bytes(packed[1:9], "little")
    return np.cumsum(out, dtype=U)


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def _letters(digits: bool) -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    if digits:
        out[48:58] = np.arange(48, 58)
    return out


#: Letters (any byte beyond ASCII counts as one) in lower case, all else as a space.
LETTERS = _letters(False)
#: The same, with digits kept.
LETTERS_DIGITS = _letters(True)


class Grams:
    """Character n-grams (of bytes) of the words of some texts; a word's border is one space on either side."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, keep: np.ndarray = LETTERS):
        texts = len(off) - 1
        at = np.repeat(np.arange(1, texts + 1), np.diff(off))
        self.raw = np.full(len(raw) + texts + 1, 32, np.uint8)
        self.raw[np.arange(len(raw)) + at] = keep[raw]
        self.text = np.empty(len(self.raw), np.int64)
        self.text[-1] = max(0, texts - 1)
        self.text[:-1] = np.repeat(np.arange(texts), np.diff(off) + 1)
        self.space = self.raw == 32

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all n-grams (n up to 8), the places of their first bytes, and the texts they are in."""
        m = len(self.raw) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bad = self.space[:m].copy() if n == 1 else self.space[:m] & self.space[1 : m + 1]
        for k in range(1, n - 1):
            bad |= self.space[k : m + k]
        at = np.flatnonzero(~bad)
        code = self.raw[at].astype(U)
        for k in range(1, n):
            code <<= U(8)
            code |= self.raw[at + k]
        return code, at, self.text[at + self.space[at]]
