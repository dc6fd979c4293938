"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language by falling frequency. A text gets such a list too;
its distance from a language is the sum, over its n-grams, of how far each one's rank is out of place in the profile
(the length of the profile where it isn't listed). The nearest language wins; the score is the margin by which it does:
1 - nearest / second nearest distance.

Profiles are counted over all training texts: each task counts its own texts, counts are summed by n-gram, and only the
heads of the lists (languages x ``size`` entries) come to the driver and go out again.

Defined results: a null text, or one without a letter, gets the language ``und`` and score 0, as do all texts when
nothing is learned; of languages at equal distance the first in alphabetical order wins (score 0); with one language the
score is 1 - distance / largest possible distance. Repeated rows are counted and predicted each. Long texts are read whole, in
memory that grows with the longest. Other columns are ignored.
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

#: n-grams of 1 to this many bytes. Three make codes of 24 bits.
LONGEST = 3
CODE_BITS = 8 * LONGEST
#: Entries of a profile.
SIZE = 300


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    codes: np.ndarray  # all codes in a profile, sorted
    ranks: np.ndarray  # by language and code; the size of a profile where a code isn't listed
    size: int


def _counts(raw: np.ndarray, off: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (group << CODE_BITS | code) of all n-grams and their counts; ``group`` is by text."""
    grams = B.Grams(raw, off)
    keys = []
    for n in range(1, LONGEST + 1):
        code, _, text = grams.of(n)
        keys.append(group[text].astype(B.U) << B.U(CODE_BITS) | code)
    keys = np.concatenate(keys)
    keys.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return [key], [np.bincount(inverse, np.concatenate(counts)).astype(np.int64)]


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    languages: dict[str, int] = {}
    keys, counts = [np.zeros(0, B.U)], [np.zeros(0, np.int64)]
    for batch in batches:
        group = np.array([languages.setdefault(x, len(languages)) for x in batch.column(1).to_pylist()], np.int64)
        for first, end, raw, off in B.steps(batch.column(0)):
            k, c = _counts(raw, off, group[first:end])
            keys, counts = _add([*keys, k], [*counts, c])
    names = np.array([*languages, ""], object)
    yield pa.RecordBatch.from_arrays([B.strings(list(names[(keys[0] >> B.U(CODE_BITS)).astype(int)])), pa.array((keys[0] & B.U((1 << CODE_BITS) - 1)).astype(np.int64)), pa.array(counts[0])], ["lang", "code", "n"])


def _heads(size: int):
    def run(frames):
        for frame in frames:
            yield frame.sort_values(["lang", "n", "code"], ascending=[True, False, True]).groupby("lang").head(size)

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> Profiles:
    """Profiles of all languages that occur, from all rows with a language and a text."""
    rows = docs.select(F.lower(F.col(text)).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counted = rows.mapInArrow(_count_task, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    heads = counted.mapInPandas(_heads(size), "lang string, code long, n long").toPandas()
    heads = heads.sort_values(["lang", "n", "code"], ascending=[True, False, True])
    languages, codes = sorted(heads["lang"].unique()), []
    for lang_name in languages:
        codes.append(heads["code"][heads["lang"] == lang_name].to_numpy()[:size].astype(B.U))
    every = np.unique(np.concatenate([np.zeros(0, B.U), *codes]))
    ranks = np.full((len(languages), len(every)), size, np.int64)
    for row, own in zip(ranks, codes):
        row[np.searchsorted(every, own)] = np.arange(len(own))
    return Profiles(languages, every, ranks, size)


def _distances(profiles: Profiles, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distances by language and text, and by text the number of n-grams they are sums over."""
    texts = len(off) - 1
    keys, counts = _counts(raw, off, np.arange(texts))
    text, code = (keys >> B.U(CODE_BITS)).astype(np.int64), keys & B.U((1 << CODE_BITS) - 1)
    bits = 64 - CODE_BITS - max(1, texts.bit_length())
    falling = (1 << bits) - 1 - np.minimum(counts, (1 << bits) - 1)
    order = (text.astype(B.U) << B.U(64 - max(1, texts.bit_length()))) | (falling.astype(B.U) << B.U(CODE_BITS)) | code
    order.sort()
    text = (order >> B.U(64 - max(1, texts.bit_length()))).astype(np.int64)
    rank = np.arange(len(order)) - np.searchsorted(text, np.arange(texts))[text]
    head = rank < profiles.size
    text, code, rank = text[head], order[head] & B.U((1 << CODE_BITS) - 1), rank[head]
    at = np.minimum(np.searchsorted(profiles.codes, code), len(profiles.codes) - 1)
    known = profiles.codes[at] == code
    out = np.zeros((len(profiles.languages), texts))
    for row, ranks in zip(out, profiles.ranks):
        place = np.where(known, ranks[at], profiles.size)
        row[:] = np.bincount(text, np.where(place == profiles.size, profiles.size, np.abs(place - rank)), texts)
    return out, np.bincount(text, minlength=texts)


def _verdicts(profiles: Profiles, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far, grams = _distances(profiles, raw, off)
    best = far.argmin(0)
    near = far.min(0)
    second = np.sort(far, 0)[1] if len(far) > 1 else grams * float(profiles.size)
    return best, np.where(second > 0, 1 - near / np.maximum(second, 1e-9), 0.0)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with its own columns and, in place of any of those ``names``, the language and the score, from the text alone."""
    kept = [c for c in docs.columns if c not in names]
    shape = T.StructType([*(docs.schema[c] for c in kept), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*profiles.languages, "und"], object)
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(known) - 1), np.zeros(batch.num_rows)
            if profiles.languages:
                for first, end, raw, off in B.steps(batch.column(batch.num_columns - 2)):
                    lang[first:end], score[first:end] = _verdicts(profiles, raw, off)
            none = ~np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            lang[none], score[none] = len(known) - 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], B.strings(list(known[lang])), pa.array(score)], shape.names)

    lower, letter = F.lower(F.col(text)).alias("_lower"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    return docs.select(*kept, lower, letter).mapInArrow(run, shape)


def identify(docs: DataFrame, fold: int = 1, folds: int = 3, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all: id, ``held_out``, ``lang_pred``, ``score``."""
    held_out = F.coalesce(F.crc32(F.col(id).cast("string")) % folds == fold, F.lit(False))
    profiles = train(docs.filter(~held_out), text, lang)
    return predict(docs.select(F.col(id), held_out.alias("held_out"), F.col(text)), profiles, text).drop(text)
