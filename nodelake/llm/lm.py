"""Scoring texts with a weighted backoff automaton over smoothed n-grams (up to trigrams).

The automaton's states are contexts: the root, each word that something follows in training (and the start of a text), and each
pair of words that occurs ``Settings.least`` times or more there. With absolute discounting D, a state h has an arc for each
word w that follows it in training, weighted with

    p(w | h) = (c(h w) - D) / c(h) + f(h) p(w | h'),    f(h) = D t(h) / c(h)

(c: counts, t: distinct followers, h': h without its first word). The arc leads to the longest state that the words so far end
with. For other words, a failure arc leads to the state h', weighted with f(h). The root has an arc for each known word, with
(c(w) - D) / N, and one for the unknown, with D V / N (N: training tokens, V: distinct ones; the unknown word stands for all
words not in training). A text is traversed once from left to right: the state is carried from token to token, and the
logarithms of the weights of all arcs on the way are added up (:class:`Automaton`).

No task holds the model. Blocks of texts send the n-grams that they hold to buckets of keys and get the corpus's counts back:
pairs first; then words, with the followers of each, and those triples whose first two words are a state; then the followers
of pairs. Which followers are distinct is known since a bucket names for each n-gram the first block that has it. A block
then has the part of the automaton that its texts can reach, builds it and traverses its texts. A message holds all keys
of a block that fall into a bucket; there are none without keys, so messages can't outgrow the keys.

Defined results: a null text is empty and has only its end; texts with equal bytes get equal scores; without any training
token the unknown word has probability 1; A-Z count as lower case; other columns are ignored. Long texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from . import exchange as X
from . import scratch


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    least: int = 3  # occurrences of a pair that is a state
    block: int | None = 8 << 20  # bytes of text in a block


START, END = (int(x) for x in B.mix(np.array([0x5354415254, 0x454E44], B.U)))
_PRIME = B.U(0x9E3779B97F4A7C15)


class Block:
    """The tokens of a block's texts as numbers of its own words, pairs and triples."""

    def __init__(self, table: pa.Table):
        self.digests, column, _, self.weights = X.merged(table)
        hashes, sizes = [], []
        for _, _, raw, off in B.steps(column):
            low = B.LOWER[raw]
            starts, ends = B.word_spans(low, off)
            n = np.bincount(B.text_of(off, starts), minlength=len(off) - 1) + 1
            tokens = np.full(n.sum(), END, B.U)
            last = np.cumsum(n) - 1
            word = np.ones(len(tokens), bool)
            word[last] = False
            tokens[word] = B.Spans(low)(starts, ends)
            hashes.append(tokens)
            sizes.append(n)
        self.tokens = tokens = np.concatenate([np.zeros(0, B.U), *hashes])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.trained = np.repeat(self.weights, self.sizes).astype(np.int32)  # training rows of each token's text
        self.words, number = np.unique(np.append(tokens, B.U(START)), return_inverse=True)
        self.token, self.start = number[:-1].astype(np.int32), int(number[-1])
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first] = self.start
        self.pairs, at, number = np.unique(B.mix(self.words[self.context] * _PRIME + tokens), return_index=True, return_inverse=True)
        self.pair, self.pair_context = number.astype(np.int32), self.context[at]
        self.before = np.empty_like(self.pair)  # the pair of the two words before each token
        self.before[1:] = self.pair[:-1]
        self.before[self.first] = -1

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair, self.trained, len(self.pairs)).astype(np.int64)

    def word_counts(self) -> np.ndarray:
        out = np.bincount(self.token, self.trained, len(self.words)).astype(np.int64)
        out[self.start] += self.weights.sum()
        return out

    def find_triples(self, states: np.ndarray) -> None:
        """Number the triples whose first two words are a state, given which pairs are."""
        self.at = np.flatnonzero((self.before >= 0) & states[self.before])
        before = self.before[self.at]
        self.triples, first, number = np.unique(B.mix(self.pairs[before] * _PRIME + self.tokens[self.at]), return_index=True, return_inverse=True)
        self.triple, self.triple_context = number.astype(np.int32), before[first]

    def triple_counts(self) -> np.ndarray:
        return np.bincount(self.triple, self.trained[self.at], len(self.triples)).astype(np.int64)


_ASK = "bucket long, part int, block long, body binary"
_ANSWER = "block long, bucket long, part int, body binary"
#: Parts of the exchange, and the block that stands for all when totals are added up.
PAIRS, WORDS, TRIPLES, FOLLOWERS = range(4)
_TOTALS = -1


def _pack(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpack(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _messages(part: int, block: int, bodies: list[bytes | None]) -> pa.Table:
    rows = [(b, body) for b, body in enumerate(bodies) if body is not None]
    return pa.table([pa.array([b for b, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "part", "block", "body"])


def _asks(part: int, block: int, keys: np.ndarray, buckets: int, total: int, *columns: np.ndarray) -> pa.Table:
    """A row for each bucket, with the keys and the columns along them. The total goes to all buckets, so that a bucket
    knows it even where no block has keys for it."""
    edge = X.bucket_edges(keys, buckets)
    return _messages(part, block, [_pack(total.to_bytes(8, "little", signed=True), B.pack_sorted(keys[a:z]), *(X.small(c[a:z]) for c in columns)) if z > a or total >= 0 else None for a, z in zip(edge[:-1], edge[1:])])


class _Gathered:
    """What blocks sent to a bucket: the blocks, the total, the distinct keys, each sent key's number, edges of blocks, columns."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("block")
        sent = [_unpack(body) for body in table.column("body").to_pylist()]
        keys = [B.unpack_sorted(x[1]) for x in sent]
        self.blocks, self.total = table.column("block").to_pylist(), max(int.from_bytes(x[0], "little", signed=True) for x in sent)
        self.keys, self.number = np.unique(np.concatenate(keys), return_inverse=True)
        self.edge = np.cumsum([0, *(len(k) for k in keys)])
        self.columns = [np.concatenate([X.large(x[i]) for x in sent]) for i in range(2, len(sent[0]))]

    def sums(self, column: np.ndarray) -> np.ndarray:
        return np.bincount(self.number, column, len(self.keys)).astype(np.int64)

    def each(self, column: np.ndarray, *more: np.ndarray) -> list[bytes]:
        """Answers, block by block, along the keys that it sent: of columns along the distinct keys; of a boolean one, along
        all keys sent, the bits."""
        out = []
        for a, z in zip(self.edge[:-1], self.edge[1:]):
            out.append(_pack(*(np.packbits(c[a:z]).tobytes() if c.dtype == bool else X.small(c[self.number[a:z]]) for c in (column, *more))))
        return out


def _answers(blocks: list[int], bucket: int, part: int, bodies: list[bytes]) -> pa.Table:
    n = len(blocks)
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * n, pa.int64()), "part": pa.array([part] * n, pa.int32()), "body": pa.array(bodies, pa.binary())})


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """Of each pair or triple sent: its count in training; and whether the block is the first to have it, who counts it as
    one distinct. Of each word: its count and its distinct followers, and N. Sums go to the totals."""
    bucket, part = key[0].as_py(), key[1].as_py()
    sent = _Gathered(table)
    sums = sent.sums(sent.columns[0])
    if part == WORDS:
        after = sent.sums(sent.columns[1])
        known = int((sums[sent.keys != B.U(START)] > 0).sum()) if len(sent.keys) else 0
        send = [(b, sent.total.to_bytes(8, "little", signed=True) + x) for b, x in zip(sent.blocks, sent.each(sums, after)) if b != _TOTALS]
        return _answers([*(b for b, _ in send), _TOTALS], bucket, part, [*(x for _, x in send), known.to_bytes(8, "little") + max(sent.total, 0).to_bytes(8, "little")])
    first = np.zeros(len(sent.number), bool)
    first[np.unique(sent.number, return_index=True)[1]] = True
    owner = first & (sums[sent.number] > 0)
    out = _answers(sent.blocks, bucket, part, sent.each(sums, owner))
    return pa.concat_tables([out, _answers([_TOTALS], bucket, part, [int(sums.sum()).to_bytes(8, "little")])]) if part == PAIRS else out


def _count_followers(key: tuple, asked: pa.Table, told: pa.Table) -> pa.Table:
    """Of each pair sent before: its distinct followers, from what blocks tell of those that they own, along the same keys."""
    sent, own = _Gathered(asked), dict(zip(told.column("block").to_pylist(), told.column("body").to_pylist()))
    columns = [X.large(own[b]) if b in own else np.zeros(z - a, np.int64) for b, a, z in zip(sent.blocks, sent.edge[:-1], sent.edge[1:])]
    return _answers(sent.blocks, key[0].as_py(), FOLLOWERS, sent.each(sent.sums(np.concatenate(columns))))


def _of(table: pa.Table, part: int) -> list[tuple[int, bytes]]:
    return [(b, x) for p, b, x in zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), table.column("body").to_pylist()) if p == part]


def _read(table: pa.Table, part: int, keys: np.ndarray, buckets: int, *kinds: type) -> list[np.ndarray]:
    """The answers along all keys of a block, by column: numbers or bits."""
    edge, out = X.bucket_edges(keys, buckets), [np.zeros(len(keys), k) for k in kinds]
    for b, body in _of(table, part):
        a, z = edge[b : b + 2]
        for column, kind, packed in zip(out, kinds, _unpack(body)):
            column[a:z] = np.unpackbits(np.frombuffer(packed, np.uint8), count=z - a).astype(bool) if kind is bool else X.large(packed)
    return out


class Automaton:
    """The part of the automaton that a block's texts can reach.

    A state is a number: the root -1, words by their numbers, pairs after them. Arcs are kept by the tokens that they are for:
    of each token, the arc from the pair before it, from the word before it and from the root, where there are such."""

    def __init__(self, block: Block, pair_count: np.ndarray, word_count: np.ndarray, followers: np.ndarray, triple_count: np.ndarray, pair_followers: np.ndarray, tokens: int, s: Settings):
        d, n, words = s.discount, max(tokens, 1), len(block.words)
        inner = (word_count > 0) & (followers > 0)
        pair_states = (pair_count >= s.least) & (pair_followers > 0)
        # failure arcs, by state: words, then pairs
        self.failure = np.concatenate([np.full(words, -1, np.int32), self._ends(block)])
        with np.errstate(divide="ignore", invalid="ignore"):
            fail = np.concatenate([np.where(inner, d * followers / np.maximum(word_count, 1), 1.0), np.where(pair_states, d * pair_followers / np.maximum(pair_count, 1), 1.0)])
            self.failure_log = np.log10(fail)
            # arcs, by token: weights; a weight of 0 stands for no arc
            root = np.maximum(word_count[block.token] - d, 0) / n
            known = word_count[block.token] > 0
            arc = pair_count[block.pair]
            from_word = np.where(arc > 0, (arc - d) / np.maximum(word_count[block.context], 1) + fail[block.context] * root, 0.0)
            lower = np.where(arc > 0, from_word, fail[block.context] * root)
            from_pair = np.zeros(len(arc))
            three = triple_count[block.triple]
            before = block.before[block.at]
            found = (three > 0) & pair_states[before]
            from_pair[block.at] = np.where(found, (three - d) / np.maximum(pair_count[before], 1) + fail[words + before] * lower[block.at], 0.0)
            self.arc_logs = np.stack([np.log10(from_pair), np.log10(from_word), np.where(known, np.log10(root), 0.0)])
        self.has = np.stack([from_pair > 0, from_word > 0, np.ones(len(arc), bool)])
        self.source = np.stack([np.where(block.before >= 0, words + block.before, -2), block.context, np.full(len(arc), -1)]).astype(np.int32)  # the states that the arcs start from
        # the longest state that the words up to a token end with
        self.target = np.where(pair_states[block.pair], words + block.pair, np.where(inner[block.token], block.token, -1)).astype(np.int32)
        self.unknown = ~known
        self.block, self.inner = block, inner

    @staticmethod
    def _ends(block: Block) -> np.ndarray:
        """By pair, its second word."""
        out = np.empty(len(block.pairs), np.int32)
        out[block.pair] = block.token
        return out

    def traverse(self, steps: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """By text, the log-probability without that of unknown words, and how many of these there are.

        All texts are traversed together, a token of each at a time. A text of more than ``steps`` tokens goes in several
        pieces, of which the later begin in the state that the words before them lead to."""
        block = self.block
        pieces = -(-block.sizes // steps)
        text = np.repeat(np.arange(len(block.sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = block.first[text] + nth * steps
        size = np.minimum(block.sizes[text] - nth * steps, steps)
        order = np.argsort(-size, kind="stable")
        text, begin, size, nth = text[order], begin[order], size[order], nth[order]
        start = block.start if self.inner[block.start] else -1
        state = np.where(nth > 0, self.target[begin - 1], np.int32(start))
        total = np.zeros(len(text))
        for i in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -i, "left"))  # pieces with a token left
            at, now = begin[:live] + i, state[:live]
            log, open_ = np.zeros(live), np.ones(live, bool)
            for level in range(3):
                own = open_ & (now == self.source[level][at])
                take = own & self.has[level][at]
                log[take] += self.arc_logs[level][at[take]]
                open_ &= ~take
                fail = own & open_
                log[fail] += self.failure_log[now[fail]]
                now = np.where(fail, self.failure[now], now)
            total[:live] += log
            state[:live] = self.target[at]
        logs = np.bincount(text, total, len(block.sizes))
        return logs, np.add.reduceat(self.unknown.astype(np.int64), block.first) if len(block.first) else np.zeros(0, np.int64)


def score(docs: DataFrame, trained: Column, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the documents for which ``trained`` holds and score all: id, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-one unigrams) and ``score`` (log10 probabilities)."""
    s = settings
    blocks, n = X.texts(docs, text, F.coalesce(trained, F.lit(False)), s.block)
    buckets = -(-n // 2)

    def ask_pairs(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table)
        return _asks(PAIRS, key[0].as_py(), block.pairs, buckets, -1, block.pair_counts())

    def with_triples(table: pa.Table, answers: pa.Table) -> tuple[Block, np.ndarray, np.ndarray]:
        block = Block(table)
        count, owner = _read(answers, PAIRS, block.pairs, buckets, np.int64, bool)
        block.find_triples(count >= s.least)
        return block, count, owner

    def ask_more(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        own = key[0].as_py()
        if own == _TOTALS:
            total = sum(int.from_bytes(x, "little") for _, x in _of(answers, PAIRS))
            return _asks(WORDS, _TOTALS, np.zeros(0, B.U), buckets, total, np.zeros(0, np.int64), np.zeros(0, np.int64))
        block, _, owner = with_triples(table, answers)
        followers = np.bincount(block.pair_context[owner], minlength=len(block.words))
        words = _asks(WORDS, own, block.words, buckets, -1, block.word_counts(), followers)
        return pa.concat_tables([words, _asks(TRIPLES, own, block.triples, buckets, -1, block.triple_counts())])

    def tell_followers(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if key[0].as_py() == _TOTALS:
            return _messages(FOLLOWERS, _TOTALS, [])
        block, _, _ = with_triples(table, answers)
        _, owner = _read(answers, TRIPLES, block.triples, buckets, np.int64, bool)
        followers = np.bincount(block.triple_context[owner], minlength=len(block.pairs))
        edge = X.bucket_edges(block.pairs, buckets)
        return _messages(FOLLOWERS, key[0].as_py(), [X.small(followers[a:z]) if followers[a:z].any() else None for a, z in zip(edge[:-1], edge[1:])])

    def conclude(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if key[0].as_py() == _TOTALS:
            parts = [(int.from_bytes(x[:8], "little"), int.from_bytes(x[8:], "little")) for _, x in _of(answers, WORDS)]
            known, tokens = sum(p[0] for p in parts), max((p[1] for p in parts), default=0)
            rows = [[None], [known], [tokens], [0.0], [0.0], [0]]
        else:
            block, pair_count, _ = with_triples(table, answers)
            triple_count, _ = _read(answers, TRIPLES, block.triples, buckets, np.int64, bool)
            (pair_followers,) = _read(answers, FOLLOWERS, block.pairs, buckets, np.int64)
            words, tokens = [], 0
            for b, body in _of(answers, WORDS):
                tokens = int.from_bytes(body[:8], "little", signed=True)
                words.append((WORDS, b, body[8:]))
            told = pa.table({"part": [w[0] for w in words], "bucket": [w[1] for w in words], "body": pa.array([w[2] for w in words], pa.binary())})
            word_count, followers = _read(told, WORDS, block.words, buckets, np.int64, np.int64)
            logs, unknown = Automaton(block, pair_count, word_count, followers, triple_count, pair_followers, tokens, s).traverse()
            count = word_count[block.token]
            base = np.add.reduceat(np.log10(count + 1.0), block.first)
            rows = [block.digests, block.sizes, np.add.reduceat((count > 0).astype(np.int64), block.first), base, logs, unknown]
        return pa.table([pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], ["digest", "n_tokens", "n_known", "base", "logs", "unknown"])

    # each answer is dealt by block once, and unions of answers keep that; so are the keys asked by bucket
    parts = scratch.partitions(docs.sparkSession)
    asked = blocks.groupBy("block").applyInArrow(ask_pairs, _ASK).repartition(parts, "bucket")
    first = asked.groupBy("bucket", "part").applyInArrow(_count, _ANSWER).repartition(parts, "block")
    more = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_more, _ASK).repartition(parts, "bucket")
    second = first.union(more.groupBy("bucket", "part").applyInArrow(_count, _ANSWER).repartition(parts, "block"))
    told = blocks.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(tell_followers, _ASK)
    third = second.union(asked.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_count_followers, _ANSWER).repartition(parts, "block"))
    shape = "digest binary, n_tokens long, n_known long, base double, logs double, unknown long"
    found = scratch.table(blocks.groupBy("block").cogroup(third.groupBy("block")).applyInArrow(conclude, shape).withColumnRenamed("digest", "_digest"))
    totals = found.filter("_digest is null").first()
    known, tokens = (totals["n_tokens"], totals["n_known"]) if totals else (0, 0)
    unknown = F.log10(F.lit(s.discount * known / tokens)) if tokens else F.lit(0.0)
    rows = docs.select(F.col(id), F.coalesce(trained, F.lit(False)).alias("trained"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"))
    return rows.join(found, F.col("digest") == F.col("_digest")).select(
        id, "trained", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + known + 1)))).alias("base_score"),
        (F.col("logs") + F.col("unknown") * unknown).alias("score"))


def report(docs: DataFrame, settings: Settings = Settings(), fold: int = 2, folds: int = 7, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from all documents outside the held-out fold and score all."""
    held_out = F.coalesce(F.crc32(F.col(id).cast("string")) % folds == fold, F.lit(False))
    return score(docs, ~held_out, settings, id, text).withColumn("held_out", ~F.col("trained")).drop("trained")
