"""Byte-level BPE encoding and decoding without running the merges.

A byte string is mapped to Latin-1, so that each byte is one character of a pyahocorasick automaton over the whole
vocabulary. One scan gives the longest token that starts at each byte. A sequence of tokens is what the merges produce
exactly when each adjacent pair is (a pair is *compatible* if merging its two byte strings, joined, yields these two
tokens), so the encoder takes longest matches from left to right, checks each pair, and falls back to the next shorter
token, or to an earlier position, where a pair isn't compatible. Positions found to lead nowhere are not tried again,
and compatibility is memoised, which makes the work linear in the length of the piece.

Defined results: a null or empty text has no tokens; a text of any length is encoded whole; equal rows get equal
results; other columns are ignored by :func:`digests` and kept by :func:`encode`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewise as B

#: Entries that the memory of pieces, and that of pairs, may hold; beyond it the memory starts afresh.
MEMORY = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file with a base64 token and a rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class Pieces(dict):
    """What is known of each piece of text: number of ids, the ids in decimal, the bytes they stand for."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        if len(self) >= MEMORY:
            self.clear()
        ids = self.encoder.piece(piece.encode())
        self[piece] = out = (len(ids), " ".join(map(str, ids)), self.encoder.decode(ids))
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.scan = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.scan.add_word(token.decode("latin-1"), (rank, len(token)))
        self.scan.make_automaton()
        self.shorter = {rank: self._prefix(token) for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def _prefix(self, token: bytes) -> int | None:
        """The longest proper prefix that is a token."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves; only pairs of tokens come here."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.ranks[joined], i) for i in range(len(parts) - 1) if (joined := parts[i] + parts[i + 1]) in self.ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [0] * n
        for last, (rank, size) in self.scan.iter(piece.decode("latin-1")):
            longest[last - size + 1] = rank  # matches come by their ends, so the last of a start is its longest
        out: list[int] = []
        blocked = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + len(self.bytes_of[token])
            if not blocked[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            shorter = self.shorter[token]
            while shorter is None:
                blocked[at] = 1
                token = out.pop()
                at -= len(self.bytes_of[token])
                shorter = self.shorter[token]
            token = shorter

    def encode(self, text: str) -> list[int]:
        return [rank for piece in self.split(text) for rank in self.piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of what the ids decode to."""
        known = [self.pieces[p] for p in self.split(text)]
        ids, decoded = hashlib.sha256(" ".join([k[1] for k in known]).encode()), hashlib.sha256(b"".join([k[2] for k in known]))
        return sum([k[0] for k in known]), ids.hexdigest(), decoded.hexdigest()


def _encoder(ranks, pattern: str) -> Encoder:
    """One encoder for each Python worker, and vocabulary by its content, until the worker works for another operator."""
    digest, known = ranks.value
    return B.keep((digest, pattern), lambda: Encoder(known, pattern))


def _shared(df: DataFrame, path: str):
    """The vocabulary is a file of fixed size, read once by the driver: tens of thousands of short byte strings."""
    known = read_ranks(path)
    digest = hashlib.sha256(b"".join(b"%d %s\n" % (rank, token.hex().encode()) for token, rank in known.items())).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, known))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text (``array<int>``) in the new column ``to``."""
    ranks = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = pa.array([encoder.encode(x or "") for x in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, to])

    return df.drop(to).mapInArrow(run, T.StructType([*df.drop(to).schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", names: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """``df`` with the ids of each whole text and the bytes that these ids decode to in place of the text, and of any of those
    ``names``. Like :func:`encode` and then :func:`decode`, but in one worker, where those take two for each task."""
    ranks = _shared(df, path)
    kept = [c for c in df.columns if c not in (text, *names)]
    shape = T.StructType([*(df.schema[c] for c in kept), T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = [encoder.encode(x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                decoded = pa.array([encoder.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32())), decoded], shape.names)
            B.release(batch.nbytes)

    return df.select(*kept, text).mapInArrow(run, shape)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each row's ids stand for in the new column ``to``; null ids give no bytes."""
    ranks = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: x for x, rank in ranks.value[1].items()}
        for batch in batches:
            out = pa.array([b"".join([token[i] for i in row or []]) for row in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, to])

    return df.drop(to).mapInArrow(run, T.StructType([*df.drop(to).schema.fields, T.StructField(to, T.BinaryType())]))


def _parts(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def digests(df: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return counts and digests of both: the row's id, ``n_tokens``,
    ``ids_sha256``, ``decoded_sha256``."""
    ranks = _shared(df, path)
    shape = T.StructType([df.schema[id], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            for part in _parts(batch):
                rows = [encoder.digest(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))], shape.names)

    return df.select(F.col(id), F.col(text)).mapInArrow(run, shape)
