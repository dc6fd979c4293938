"""Similarity join of documents on word shingles by a MinHash LSH forest and exact verification.

A document's set holds its shingles of ``Settings.shingle`` words (one shingle of all words if it has fewer). Documents
with equal sets form a *text*, and from here on a text stands for its copies, however many. Texts get a MinHash label of
``Settings.longest`` minima in each of ``Settings.trees`` tries; texts whose labels in a trie begin with the same d minima
are under one node at depth d. Nodes are found by grouping on prefixes, hashed to 64 bits, instead of sorting the labels.

The forest is walked from the longest prefixes upwards. At each depth looked at, every pair of texts that share a node there
is compared once, in the first trie where they do, by the share of minima that agree. A pair of similarity s shares a node at
depth d with the probability 1 - (1 - s^d)^trees. So the least similar pair found tells how short prefixes must be for
``Settings.recall``; they are shortened to that, and the pairs that are found then are judged in the same way, until no shorter
prefix is called for. Where no pair near the threshold has been found, prefixes are shortened at least until one would have
been seen with the probability ``Settings.seen`` (:func:`needed`).

Texts whose labels agree well enough are linked; connected texts form a neighbourhood; and all pairs of a neighbourhood are
verified exactly, by products of 0/1 matrices of its texts and shingles. Nodes and neighbourhoods of any size are cut into
blocks, each pair of blocks is a task's work, and tasks return counts and links to the smallest neighbour, never the
pairs. Nothing is capped or sampled.

Defined results: a document without words (null or empty text) is linked to none and is a class of its own; rows equal in
id and text count as copies of each other; the class id is the smallest id in the class (null if all its ids are null);
other columns are ignored. Long texts are read whole. Words are separated by white space, A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from . import components, scratch


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    trees: int = 24
    longest: int = 8  # minima in a label
    recall: float = 0.99999  # of the least similar pairs that there are
    seen: float = 0.999  # probability of seeing a pair at the threshold, where none has been seen
    near: float = 0.03  # above the threshold
    slack: float = 0.2  # how far a signature's estimate may lie below the threshold
    rows: int = 512  # of a block of a neighbourhood
    node: int = 512  # rows of a block of a trie node
    bytes: int = 4 << 20  # of the texts of a block


def meets(similarity: float, depth: int, s: Settings) -> float:
    """The probability that two texts share a node at a depth."""
    return 1 - (1 - similarity**depth) ** s.trees


def needed(found: dict[float, int], depth: int, s: Settings) -> int:
    """The longest prefixes, up to ``depth``, that reach the recall for the least similar pairs found at that depth; and
    with which a single pair at the threshold would be seen, if none is near it."""
    least = max(s.similarity, min(found, default=1.0))
    for d in range(depth, 1, -1):
        if meets(least, d, s) >= s.recall and (meets(s.similarity, d, s) >= s.seen or least < s.similarity + s.near):
            return d
    return 1


def shingles(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and the texts' offsets in them."""
    low = B.LOWER[raw]
    starts, ends = B.word_spans(low, off)
    word = B.Spans(low)(starts, ends)
    text = B.text_of(off, starts)
    first = np.searchsorted(text, np.arange(len(off)))
    left = first[text + 1] - np.arange(len(word)) if len(word) else np.zeros(0, np.int64)  # words from here to the text's end
    is_first = np.arange(len(word)) == first[text] if len(word) else np.zeros(0, bool)
    heads = np.flatnonzero((left >= size) | is_first)
    code = np.zeros(len(heads), B.U)
    for k in range(size):
        at = heads + k
        inside = left[heads] > k
        code = np.where(inside, B.mix(code * B.U(0x9E3779B97F4A7C15) + word[np.minimum(at, len(word) - 1)] + B.U(k + 1)), code)
    owner = text[heads]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(off)))


def _minima(code: np.ndarray, edge: np.ndarray, count: int) -> np.ndarray:
    """By text with shingles and hash function, the smallest hash of the text's shingles (32 bits)."""
    rng = np.random.default_rng(20)
    salt, odd = rng.integers(0, 1 << 32, count, np.uint32), rng.integers(0, 1 << 31, (count, 2), np.uint32) * np.uint32(2) + np.uint32(1)
    x = (code ^ (code >> B.U(32))).astype(np.uint32)
    out = np.empty((len(edge) - 1, count), np.uint32)
    for j in range(count):
        h = (x ^ salt[j]) * odd[j, 0]
        h ^= h >> np.uint32(15)
        h *= odd[j, 1]
        out[:, j] = np.minimum.reduceat(h, edge[:-1])
    return out


def _sign_task(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, raw, off in B.steps(batch.column(2)):
                code, edge = shingles(raw, off, s.shingle)
                n = np.diff(edge)
                some = np.flatnonzero(n > 0)
                label = np.zeros((len(n), s.trees * s.longest), np.uint16)
                set_of = np.zeros((len(n), 2), B.U)
                if len(some):
                    label[some] = _minima(code, np.append(edge[some], len(code)), s.trees * s.longest).astype(np.uint16)
                    for part, salt in enumerate((0, 0xA5A5A5A5)):
                        set_of[some, part] = np.add.reduceat(B.mix(code ^ B.U(salt)), edge[some])
                rows = batch.slice(begin, end - begin)
                texts = [bytes(x) if c else None for x, c in zip(set_of.view(np.uint8).reshape(len(n), 16), n)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.binary()), pa.array(n), pa.array([x.tobytes() for x in label], pa.binary()), pa.array(np.diff(off))], ["id", "digest", "text", "size", "label", "bytes"])

    return run


def _labels(column, s: Settings) -> np.ndarray:
    """Minima by text, trie and place in the label."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, s.trees, s.longest)


def _prefixes(labels: np.ndarray, depth: int) -> np.ndarray:
    """By text and trie, the first minima of the label as one number (exact up to four of them)."""
    out = np.zeros(labels.shape[:2], B.U)
    for k in range(depth):
        if k and k % 4 == 0:
            out = B.mix(out)
        out ^= labels[:, :, k].astype(B.U) << B.U(16 * (k % 4))
    return out


def _node_task(s: Settings, depth: int):
    """The nodes of each text: one in each trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = _prefixes(_labels(batch.column("label"), s), depth)
            node = B.mix(B.mix(prefix) + np.arange(1, s.trees + 1, dtype=B.U) * B.U(0x9E3779B97F4A7C15))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(np.repeat(np.arange(n), s.trees))), pa.array(np.tile(np.arange(s.trees), n).astype(np.int32)), pa.array(node.ravel().view(np.int64))], ["text", "tree", "node"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of rows that are equal in the first columns, in tables of whole runs with the runs' offsets. A run is as large
    as a pair of blocks at most."""
    rest = None

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for i in range(keys):
            x = table.column(i).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        edge = edges(table)
        if len(edge) > 2:
            yield table.slice(0, edge[-2]), edge[:-1]
        rest = table.slice(edge[-2])
    if rest is not None and rest.num_rows:
        yield rest, edges(rest)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric 0/1 matrix, the first node of its component."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label, len(label)).min(1, initial=len(label))
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sides(side: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs of a group are its own to look at: all in a block with itself, else those between the two blocks (none
    if one of them is empty)."""
    return side[:, None] != side[None, :] if i != j else ~np.eye(len(side), dtype=bool)


def _agree(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima of texts ``a`` and ``b`` are the same, pair by pair."""
    flat, out = labels.reshape(len(labels), -1), np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 14):
        out[k : k + (1 << 14)] = (flat[a[k : k + (1 << 14)]] == flat[b[k : k + (1 << 14)]]).sum(1)
    return out


def _pivoted(labels: np.ndarray, least: float, pivots: int = 16) -> np.ndarray:
    """A number for each text of a block, the same for texts that a few of them, taken as pivots, are linked with."""
    out, left = np.arange(len(labels)), np.arange(len(labels))
    for _ in range(pivots):
        if len(left) < 2:
            break
        near = _agree(labels, np.full(len(left), left[0]), left) >= least
        out[left[near]] = left[0]
        left = left[~near]
    return out


def _near_task(s: Settings, depth: int):
    """Links between texts that share a node (as many as join them), and the number of pairs by agreeing minima."""
    minima = s.trees * s.longest
    least, counted = (s.similarity - s.slack) * minima, int(s.similarity * minima)

    def group(labels: np.ndarray, prefix: np.ndarray, tree: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs, and how well all pairs agree, of those that meet first in this trie. ``side``: which of two blocks
        a text is in, where the pairs between two blocks are looked at."""
        met = prefix[:, None, tree] == prefix[None, :, tree]
        for t in range(tree):
            met &= prefix[:, None, t] != prefix[None, :, t]
        met &= np.triu(np.ones(met.shape, bool), 1)
        if side is not None:
            met &= side[:, None] != side[None, :]
        a, b = np.nonzero(met)
        agree = _agree(labels, a, b)
        near = agree >= least
        a, b = a[near], b[near]
        if side is not None and len(a):  # links inside each block are another task's; here only what joins them
            own = np.empty(len(side), np.int64)
            for x in (0, 1):
                at = np.flatnonzero(side == x)
                own[at] = at[_pivoted(labels[at], least)]
            a, b = np.unique(np.stack([own[a], own[b]]), axis=1)
        if len(a) > 1:  # a tree of links is enough
            linked = np.zeros(met.shape, bool)
            linked[a, b] = linked[b, a] = True
            root = _roots(linked)
            a = np.flatnonzero(root != np.arange(len(root)))
            b = root[a]
        return a, b, agree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(minima + 1, np.int64)
        for table, edge in _groups(batches, 3):
            texts, labels = table.column("text").to_pylist(), _labels(table.column("label"), s)
            prefix = _prefixes(labels, depth)
            side, tree, i_of, j_of = (table.column(c).to_numpy() for c in ("side", "tree", "i", "j"))
            first, size = edge[:-1], np.diff(edge)
            two = first[(size == 2) & ((i_of[first] == j_of[first]) | (side[first] != side[np.minimum(first + 1, len(side) - 1)]))]
            same = prefix[two] == prefix[two + 1]
            two = two[same[np.arange(len(two)), tree[two]] & (same.argmax(1) == tree[two])]
            agree = _agree(labels, two, two + 1)
            pairs += np.bincount(agree, minlength=minima + 1)
            a, b = [two[agree >= least]], [two[agree >= least] + 1]
            for begin, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                own, apart = slice(begin, begin + n), i_of[begin] != j_of[begin]
                if apart and (side[own] == side[begin]).all():
                    continue  # the other block is empty
                x, y, agree = group(labels[own], prefix[own], int(tree[begin]), side[own] if apart else None)
                pairs += np.bincount(agree, minlength=minima + 1)
                a.append(x + begin)
                b.append(y + begin)
            a, b = np.concatenate(a).tolist(), np.concatenate(b).tolist()
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in a], pa.binary()), pa.array([texts[k] for k in b], pa.binary()), none, none], ["a", "b", "agree", "pairs"])
        some = counted + np.flatnonzero(pairs[counted:])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int64()), pa.array(pairs[some], pa.int64())], ["a", "b", "agree", "pairs"])

    return run


def _verify_task(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge in _groups(batches, 3):
            names, copies = table.column("text").to_pylist(), table.column("copies").to_numpy()
            side, i_of, j_of = (table.column(c).to_numpy() for c in ("side", "i", "j"))
            out: list[tuple] = []
            for first, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = _sides(side[first:end], int(i_of[first]), int(j_of[first]))
                if not own.any():
                    continue
                code, size = _sets(table.column("body").slice(first, end - first), s.shingle)
                both = _shared(code, size)
                n = size[:, None] + size[None, :]
                linked = (both * (1 + s.similarity) >= s.similarity * n - 1e-9) & own
                links = linked @ copies[first:end]
                order = sorted(range(end - first), key=lambda i: names[first + i])
                root = np.empty(end - first, np.int64)
                root[order] = np.array(order)[_roots(linked[np.ix_(order, order)])]
                out += [(names[first + i], int(links[i]), names[first + r]) for i, r in enumerate(root.tolist()) if links[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["text", "links", "root"])

    return run


def _sets(column, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    code = []
    for _, _, raw, off in B.steps(column):
        c, edge = shingles(raw, off, size)
        code += [c[a:z] for a, z in zip(edge[:-1], edge[1:])]
    return code, np.array([len(c) for c in code])


def _shared(code: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """How many shingles each two sets share."""
    every, owner = np.concatenate(code), np.repeat(np.arange(len(code)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    out = np.zeros((len(code), len(code)), np.float64)
    for first in range(0, int(column.max(initial=-1)) + 1, 2048):
        a, z = np.searchsorted(column, [first, first + 2048])
        x = np.zeros((len(code), min(2048, int(column[-1]) + 1 - first)), np.float32)
        x[owner[a:z], column[a:z] - first] = 1
        out += x @ x.T
    return out


def _in_blocks(df: DataFrame, group: str, parts: Column, text: str = "text") -> DataFrame:
    """Rows of a group cut into ``parts`` blocks by a hash: one row for each pair of blocks that its own takes part in,
    with the pair (``i``, ``j``) and the side (0: in block i, 1: in block j)."""
    own = df.withColumn("_m", parts.cast("int")).withColumn("_own", F.pmod(F.xxhash64(text), F.col("_m")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return other.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_m", "_own", "_other")


def _dealt(df: DataFrame, group: str) -> DataFrame:
    return df.repartition(scratch.partitions(df.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def under(texts: DataFrame, depth: int, s: Settings) -> DataFrame:
    """What :func:`_near_task` returns of all nodes at a depth with two texts or more."""
    nodes = texts.select("text", "label").mapInArrow(_node_task(s, depth), "text binary, tree int, node long")
    shared = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias("shared"), "n")
    shared = shared.hint("merge")  # grows with the texts, so the plan shouldn't turn on its size
    members = nodes.join(shared, F.col("node") == F.col("shared")).drop("shared")
    labels = texts.select(F.col("text").alias("_text"), "label")
    met = _in_blocks(members.join(labels, F.col("text") == F.col("_text")), "node", F.ceil(F.col("n") / s.node))
    dealt = _dealt(met.select("node", "i", "j", "side", "tree", "text", "label"), "node")
    return scratch.table(dealt.mapInArrow(_near_task(s, depth), "a binary, b binary, agree long, pairs long"))


def forest(texts: DataFrame, s: Settings) -> DataFrame:
    """Links (``a``, ``b``) that connect all similar texts (``text``, ``label``) with the recall of the settings."""
    depth = s.longest
    while True:
        found = under(texts, depth, s)
        pairs = found.filter("pairs is not null").groupBy("agree").agg(F.sum("pairs").alias("n")).collect()  # as many as minima
        shorter = needed({r["agree"] / (s.trees * s.longest): r["n"] for r in pairs}, depth, s)
        if shorter == depth:
            return found.filter("a is not null").select("a", "b")
        depth = shorter


def join(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``id``, ``digest`` (MD5 of its text), ``text`` (what stands for its set; null without
    words), ``class_id`` (smallest id of all documents that links connect it with), ``root`` (names the class),
    ``n_copies`` (documents with the same set, itself included), ``n_links`` (other documents at or above the similarity)."""
    s = settings
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.unhex(F.md5(F.col(text))).alias("digest"), F.col(text).alias("body"))
    signed = scratch.table(rows.mapInArrow(_sign_task(s), f"id {kind}, digest binary, text binary, size long, label binary, bytes long"))
    some = signed.filter("text is not null")
    texts = scratch.table(some.groupBy("text").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.min("digest").alias("digest"), F.max("bytes").alias("bytes"), F.first("label").alias("label")))
    edges = forest(texts, s)
    around = components.label(edges)

    placed = scratch.table(around.join(texts.select(F.col("text").alias("_text"), "digest", "copies", "bytes"), F.col("node") == F.col("_text")).select("root", F.col("node").alias("text"), "digest", "copies", "bytes"))
    sizes = scratch.table(placed.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / s.rows), F.ceil(F.sum("bytes") / s.bytes)).alias("parts")).select(F.col("root").alias("_root"), "parts"))
    placed = placed.join(sizes, F.col("root") == F.col("_root")).drop("_root")
    bodies = rows.filter("body is not null").groupBy("digest").agg(F.first("body").alias("body")).withColumnRenamed("digest", "_digest")
    whole = placed.join(bodies, F.col("digest") == F.col("_digest"))
    work = _in_blocks(whole, "root", F.col("parts")).select("root", "i", "j", "side", "text", "copies", "body")
    found = scratch.table(_dealt(work, "root").mapInArrow(_verify_task(s), "text binary, links long, root binary"))
    classes = components.label(found.select(F.col("text").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("text").agg(F.sum("links").alias("links")).withColumnRenamed("text", "_text")
    of_text = texts.select("text", "copies", "least").join(classes.withColumnRenamed("root", "_root"), F.col("text") == F.col("node"), "left").join(linked, F.col("text") == F.col("_text"), "left")
    of_text = scratch.table(of_text.select(F.col("text").alias("_text"), F.coalesce("_root", "text").alias("root"), "copies", "least", F.coalesce("links", F.lit(0)).alias("links")))
    smallest = scratch.table(of_text.groupBy("root").agg(F.min("least").alias("class_id")).withColumnRenamed("root", "_root"))
    of_text = of_text.join(smallest, F.col("root") == F.col("_root")).select("_text", "root", "class_id", "copies", "links")

    alone = F.col("text").isNull()
    return signed.select("id", "digest", "text").join(of_text, F.col("text") == F.col("_text"), "left").select(
        "id", "digest", "text", "root", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.col("links")).alias("n_links"))


def report(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its id, ``class_id``, ``n_copies`` and ``n_links``."""
    return join(docs, settings, id, text).select(F.col("id").alias(id), "class_id", "n_copies", "n_links")


def dedup(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest (id, digest)."""
    found = join(docs, settings, id, text)
    rows = found.groupBy("id", "digest").agg(F.count("*").alias("rows"), F.min("root").alias("root"))
    rows = scratch.table(rows)
    best = scratch.table(rows.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best")))
    keep = best.join(rows.withColumnRenamed("root", "_root"), F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.digest") == F.col("digest"))).select("id", "digest", "rows")
    keep = scratch.table(keep.union(rows.filter("root is null").select("id", "digest", F.lit(1))).select(F.col("id").alias("__own_id"), F.col("digest").alias("__own_digest"), F.col("rows").alias("__rows")))
    same = docs[id].eqNullSafe(F.col("__own_id")) & F.unhex(F.md5(docs[text])).eqNullSafe(F.col("__own_digest"))
    once = docs.join(keep.filter("__rows = 1"), same, "left_semi")
    again = docs.join(keep.filter("__rows > 1"), same, "left_semi").dropDuplicates([id, text])
    return once.union(again)
