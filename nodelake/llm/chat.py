"""Turns and roles of raw transcripts by a hidden Markov model, and canonical rendering of the turns.

Each line is observed as a symbol: which speaker's marker it begins with, if any (``User:``, ``### Response``,
``<|assistant|>``, ``Q:`` ...), joined with features of the line (a question mark at its end, how many words, whether it
is blank). The hidden states are the roles, each as first line of a turn and as a later line. Transition and emission
probabilities are counted over labelled transcripts (:func:`train`). :func:`parse` takes texts alone: the Viterbi path
through all lines of a transcript gives its turns. One begins where the path says so, or where the role changes.

Transcripts of many lines are cut into segments of bounded length and solved exactly by them: the best weights between
any two states at the ends of a segment form a small matrix, matrices of a transcript are combined in order, and that
fixes the states at each segment's borders, between which each segment is then solved on its own. Short transcripts are
solved together, many at a time.

A marker is taken off a turn only where the transcript shows that it is one: the same shape of marker stands at half of its
turns or more, for two roles at least, and the marker's role is the one that was decoded. All other text is kept as it is.

The query (:func:`recover`) writes labelled turns as transcripts, one text for each conversation, parses those of each half of
the conversations with tables trained on the other half, and then looks up which parsed turns hold the lines of each true one. Defined results: rows equal in conversation,
turn, role and text are one turn, with their number in ``n_rows``; turns equal in number are ordered by a hash of their
texts; a null turn counts as turn 0; a row without a conversation is a conversation of its own; a null text is one blank
line; a role other than the three known ones is taken as unknown; other columns are ignored. Without any labelled turn all
states are equally likely, and lines follow their markers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

ROLES = ("system", "user", "assistant")
#: Names of speakers that begin a turn, by role.
MARKERS = {
    "system": "system|instructions|context",
    "user": "user|human|customer|question|prompt|instruction|q",
    "assistant": "assistant|ai|bot|agent|answer|response|model|a",
}
#: How a speaker's name is set off: ``Name:``, ``**Name:**``, ``### Name``, ``<|name|>``, ``[NAME]``.
SHAPES = (r"(?i)^\s*(?:\*\*)?(?:{0})(?:\*\*)?\s*:(?:\*\*)?", r"(?i)^\s*#+\s*(?:{0})\b:?", r"(?i)^\s*<\|?(?:{0})\|?>", r"(?i)^\s*\[(?:{0})\]")
#: Ways in which :func:`transcripts` writes turns; in the last, blank lines alone set them off.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Context\n", "user": "### Instruction\n", "assistant": "### Response\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "Instructions: ", "user": "Q: ", "assistant": "A: "},
    {"system": "\n", "user": "\n", "assistant": "\n"},
)
STATES = 2 * len(ROLES)  # by role: first line of a turn, later line
FEATURES = 10
SYMBOLS = (len(ROLES) + 1) * FEATURES
#: Weight, in lines, of what is expected of a symbol before it is counted.
PRIOR = 10
#: Lines in a segment.
LINES = 256


def _pattern(role: str) -> str:
    return "|".join(f"(?:{shape.format(MARKERS[role])})" for shape in SHAPES)


def symbol(line: Column) -> Column:
    """What is observed of a line."""
    marker = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES))):
        marker = F.when(line.rlike(_pattern(role)), i + 1).otherwise(marker)
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    length = F.when(words == 0, 0).when(words <= 4, 1).when(words <= 12, 2).when(words <= 40, 3).otherwise(4)
    return (marker * FEATURES + length * 2 + line.rlike(r"\?\s*$").cast("int")).cast("int")


#: Markers as they may be taken off a turn's first line: a heading only where it is the whole line.
_OFF = tuple({role: re.compile(shape.format(names)) for role, names in MARKERS.items()} for shape in (SHAPES[0] + r"\s?", r"(?i)^\s*#+\s*(?:{0})\s*:?\s*$", SHAPES[2], SHAPES[3] + r"\s*:?"))


def unmarked(roles: list[str], firsts: list[str]) -> list[str]:
    """First lines of a transcript's turns, without the markers that it uses."""
    found = [next(((i, role, m.end()) for i, shape in enumerate(_OFF) for role, pattern in shape.items() if (m := pattern.match(line))), None) for line in firsts]
    out = list(firsts)
    for i in range(len(_OFF)):
        own = [k for k, f in enumerate(found) if f and f[0] == i]
        if 2 * len(own) >= len(firsts) and len({found[k][1] for k in own}) > 1:
            for k in own:
                if found[k][1] == roles[k]:
                    out[k] = firsts[k][found[k][2] :]
    return out


def transcripts(turns: DataFrame) -> DataFrame:
    """Turns with ``raw``, the turn as a transcript would have it: in a style chosen by a hash of the conversation."""
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES)))
    mark = F.lit("")
    for i, names in enumerate(STYLES):
        for role, name in names.items():
            mark = F.when((style == i) & (F.col("role") == role), name).otherwise(mark)
    return turns.withColumn("raw", F.concat(mark, F.coalesce("text", F.lit(""))))


def observe(transcripts: DataFrame) -> DataFrame:
    """Transcripts with ``symbols``, what is observed of each line of ``text``."""
    return transcripts.withColumn("symbols", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), symbol))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The members of all lists of a column, and where each list begins."""
    return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _symbols(column: pa.Array) -> list[np.ndarray]:
    flat, edge = _lists(column)
    return np.split(flat.to_numpy(zero_copy_only=False), edge[1:-1]) if len(column) else []


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    emit, move = np.zeros((STATES, SYMBOLS), np.int64), np.zeros((STATES, STATES), np.int64)
    for batch in batches:
        flat, edge = _lists(batch.column("symbols"))
        symbols = flat.to_numpy(zero_copy_only=False)
        role = np.array([ROLES.index(r) if r in ROLES else -1 for r in _lists(batch.column("roles"))[0].to_pylist()], np.int64)
        size = _lists(batch.column("sizes"))[0].to_numpy(zero_copy_only=False)
        state = np.repeat(role * 2, size) + 1
        state[np.cumsum(size) - size] -= 1
        known = np.repeat(role >= 0, size)
        np.add.at(emit, (state[known], symbols[known]), 1)
        inner = np.ones(len(symbols), bool)
        inner[edge[:-1]] = False  # nothing goes before a transcript's first line
        at = np.flatnonzero(inner & known & np.concatenate([[False], known[:-1]]))
        np.add.at(move, (state[at - 1], state[at]), 1)
    rows = [(0, i, j, int(emit[i, j])) for i, j in zip(*np.nonzero(emit))] + [(1, i, j, int(move[i, j])) for i, j in zip(*np.nonzero(move))]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["kind", "i", "j", "n"])


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of emission and transition probabilities, counted over transcripts whose turns are known: ``symbols`` of
    all lines, and of each turn its role (``roles``) and its lines (``sizes``)."""
    counted = labelled.select("symbols", "roles", "sizes").mapInArrow(_count_task, "kind long, i long, j long, n long")
    count, move = np.zeros((STATES, SYMBOLS)), np.full((STATES, STATES), 0.1)
    for r in counted.groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect():  # as many as the matrices have fields
        (move if r["kind"] else count)[r["i"], r["j"]] += r["n"]
    for i in range(STATES):  # a later line follows a line of the same role
        for j in range(1, STATES, 2):
            if i // 2 != j // 2:
                move[i, j] = 1e-9
    # rare symbols: as if markers and features were independent; before anything is counted, turns begin with their markers
    marker = count.reshape(STATES, -1, FEATURES).sum(2) + 0.01
    for i in range(STATES):
        marker[i, i // 2 + 1 if i % 2 == 0 else 0] += 1
    feature = count.reshape(STATES, -1, FEATURES).sum(1) + 1
    apart = (marker / marker.sum(1, keepdims=True))[:, :, None] * (feature / feature.sum(1, keepdims=True))[:, None]
    emit = count + PRIOR * apart.reshape(STATES, SYMBOLS)
    return np.log(emit / emit.sum(1, keepdims=True)), np.log(move / move.sum(1, keepdims=True))


def weights(symbols: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best weight of a path through all lines by the state before the first line and the state of the last."""
    out = move + emit[:, symbols[0]]
    for x in symbols[1:]:
        out = (out[:, :, None] + move[None]).max(1) + emit[:, x]
    return out


def paths(symbols: list[np.ndarray], emit: np.ndarray, move: np.ndarray, before: list[int], last: list[int]) -> list[np.ndarray]:
    """Viterbi paths of many sequences at once; -1: nothing before (a turn begins), or any last state."""
    order = sorted(range(len(symbols)), key=lambda i: len(symbols[i]))
    out: list[np.ndarray] = [np.zeros(0, int)] * len(symbols)
    for a in range(0, len(order), 512):
        own = order[a : a + 512]
        size = np.array([len(symbols[i]) for i in own])
        grid = np.zeros((len(own), size.max()), np.int64)
        for row, i in zip(grid, own):
            row[: len(symbols[i])] = symbols[i]
        begin = np.where(np.arange(STATES) % 2 == 0, 0.0, -30.0)
        best = np.stack([begin if before[i] < 0 else move[before[i]] for i in own]) + emit[:, grid[:, 0]].T
        back = np.zeros((grid.shape[1], len(own), STATES), np.int8)
        final = np.where((size == 1)[:, None], best, 0)
        for t in range(1, grid.shape[1]):
            step = best[:, :, None] + move[None]
            back[t] = step.argmax(1)
            best = step.max(1) + emit[:, grid[:, t]].T
            final = np.where((size == t + 1)[:, None], best, final)
        state = np.array([final[k].argmax() if last[i] < 0 else last[i] for k, i in enumerate(own)])
        path = np.zeros(grid.shape, np.int64)
        rows = np.arange(len(own))
        for t in range(grid.shape[1] - 1, -1, -1):
            path[:, t] = state
            state = np.where(t <= size - 1, back[t, rows, state], state) if t else state
        for k, i in enumerate(own):
            out[i] = path[k, : size[k]]
    return out


def _weigh_task(emit: np.ndarray, move: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [weights(x, emit, move).tobytes() for x in _symbols(batch.column("symbols"))]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("segment"), pa.array(body, pa.binary())], ["conv", "segment", "weights"])

    return run


def _borders(key: tuple, table: pa.Table) -> pa.Table:
    """States around each segment of a transcript on its best path."""
    names = [c for c in table.column_names if c != "weights"]
    table = table.sort_by([("segment", "ascending")])
    matrices = [np.frombuffer(x, float).reshape(STATES, STATES) for x in table.column("weights").to_pylist()]
    best, back = np.where(np.arange(STATES) % 2 == 0, 0.0, -30.0), []
    for i, m in enumerate(matrices):
        step = m.max(0)[None] + best[:, None] if i == 0 else best[:, None] + m
        back.append(step.argmax(0))
        best = m.max(0) if i == 0 else step.max(0)
    last = [int(best.argmax())]
    for b in back[:0:-1]:
        last.append(int(b[last[-1]]))
    last.reverse()
    return pa.table([*(table.column(c) for c in names), pa.array([-1, *last[:-1]], pa.int32()), pa.array(last, pa.int32())], [*(f"_{c}" for c in names), "before", "last"])


def _solve_task(emit: np.ndarray, move: np.ndarray, keep: tuple[str, ...]):
    """``states`` (a byte for each line) of whole transcripts, or of segments between known states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, last = (batch.column(c).to_pylist() if c in batch.schema.names else [-1] * batch.num_rows for c in ("before", "last"))
            found = paths(_symbols(batch.column("symbols")), emit, move, before, last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x.astype(np.int8).tobytes() for x in found], pa.binary())], [*keep, "states"])

    return run


def cut(states: np.ndarray) -> np.ndarray:
    """First lines of the turns: where the path begins one, or the role changes."""
    first = states % 2 == 0
    first[0] = True
    first[1:] |= states[1:] // 2 != states[:-1] // 2
    return np.flatnonzero(first)


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"first": pa.int64(), "lines": pa.int64(), "role": pa.string(), "body": pa.string()}
    for batch in batches:
        out, edge = {c: [] for c in kinds}, [0]
        for text, states in zip(batch.column("text").to_pylist(), batch.column("states").to_pylist()):
            path, lines = np.frombuffer(states, np.int8).copy(), (text or "").split("\n")
            first = cut(path)
            bounds = [*first.tolist(), len(lines)]
            out["first"] += bounds[:-1]
            out["lines"] += np.diff(bounds).tolist()
            out["role"] += [ROLES[i] for i in (path[first] // 2).tolist()]
            heads = unmarked(out["role"][edge[-1] :], [lines[a] for a in bounds[:-1]])
            out["body"] += ["\n".join([head, *lines[a + 1 : z]]).strip() for head, a, z in zip(heads, bounds, bounds[1:])]
            edge.append(len(out["first"]))
        members = pa.StructArray.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], list(kinds))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), members)], ["conv", "turns"])


def _turns(seen: DataFrame, emit: np.ndarray, move: np.ndarray) -> DataFrame:
    """Turns of observed transcripts (``conv``, a key; ``text``; ``symbols``): ``conv``, ``first``, ``lines``, ``role``,
    ``rendered``."""
    seen, n = seen.select("conv", "text", "symbols"), F.size("symbols")
    short = seen.filter(n <= LINES).mapInArrow(_solve_task(emit, move, ("conv", "text")), "conv long, text string, states binary")
    part = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LINES).cast("int")), lambda i: F.struct(i.cast("long").alias("segment"), F.slice("symbols", i * LINES + 1, LINES).alias("symbols")))
    pieces = seen.filter(n > LINES).select("conv", F.explode(part).alias("x")).select("conv", "x.segment", "x.symbols")
    pieces = scratch.table(pieces.repartition(scratch.partitions(seen.sparkSession), "conv", "segment"))
    weighed = pieces.mapInArrow(_weigh_task(emit, move), "conv long, segment long, weights binary")
    borders = weighed.groupBy("conv").applyInArrow(_borders, "_conv long, _segment long, before int, last int")
    bound = pieces.join(borders, (F.col("conv") == F.col("_conv")) & (F.col("segment") == F.col("_segment"))).drop("_conv", "_segment")
    solved = bound.mapInArrow(_solve_task(emit, move, ("conv", "segment")), "conv long, segment long, states binary")
    whole = solved.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("segment", "states"))).alias("x"))
    whole = whole.select(F.col("conv").alias("_conv"), F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["states"])).alias("states"))
    long = seen.filter(n > LINES).join(whole, F.col("conv") == F.col("_conv")).select("conv", "text", "states")
    each = short.unionByName(long).mapInArrow(_cut_task, "conv long, turns array<struct<first: long, lines: long, role: string, body: string>>")
    return each.select("conv", F.inline("turns")).withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))).drop("body")


def parse(transcripts: DataFrame, emit: np.ndarray, move: np.ndarray, id: str = "conv_id", text: str = "text") -> DataFrame:
    """Turns of raw transcripts, given the tables of :func:`train`: transcript, ``first`` (its first line, from 0), ``lines``
    (how many), ``role``, ``rendered``. Repeated rows yield repeated turns; a null text is one blank line."""
    rows = transcripts.select(F.monotonically_increasing_id().alias("conv"), F.col(id).alias("_id"), F.col(text).alias("text"))
    seen = scratch.table(observe(rows))  # read several times
    named = seen.select(F.col("conv").alias("_conv"), "_id")
    return _turns(seen, emit, move).join(named, F.col("conv") == F.col("_conv")).select(F.col("_id").alias(id), "first", "lines", "role", "rendered")


def _hold_task(names: list[str]):
    """For each true turn the parsed turns that hold its lines; both are in order, so one pass pairs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, (spans, turns) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("turns").to_pylist())):
                at = i = 0
                for span in spans:
                    end = at + span["size"]
                    while turns[i]["first"] + turns[i]["lines"] <= at:
                        i += 1
                    z = i
                    while z < len(turns) and turns[z]["first"] < end:
                        z += 1
                    row.append(k)
                    out.append((span["turn"], span["role"], span["n_rows"], turns[i]["role"], turns[i]["first"] == at, "".join(t["rendered"] for t in turns[i:z])))
                    at = end
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(row, pa.int64())), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names)

    return run


def written(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Labelled turns as one transcript for each conversation: ``conv_id``, ``text``, and by turn ``spans`` (turn, role,
    rows, lines)."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n_rows"))
    alone = F.concat(F.lit("row "), F.xxhash64("turn", "role", "text").cast("string"))
    raw = transcripts(rows.withColumn("conv", F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), alone)))
    one = F.struct(F.coalesce("turn", F.lit(0)).alias("at"), F.xxhash64("role", "text").alias("tie"), "turn", "role", "n_rows", "raw", F.size(F.split("raw", "\n")).alias("size"))
    whole = raw.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(one)).alias("x"))
    span = lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["n_rows"].alias("n_rows"), x["size"].alias("size"))
    return whole.select("conv_id", F.array_join(F.transform("x", lambda x: x["raw"]), "\n").alias("text"), F.transform("x", span).alias("spans"))


def recover(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Write turns as transcripts, parse each half of those with what the other half teaches, and look up the true turns: conversation, ``turn``, ``role``, ``n_rows``,
    ``role_pred`` (of its first line), ``starts`` (whether a parsed turn begins there), ``rendered`` (the parsed turns that
    hold its lines)."""
    told = scratch.table(observe(written(turns, conv, turn, role, text).withColumn("conv", F.monotonically_increasing_id())))  # read several times
    half, found = F.pmod(F.xxhash64("text"), F.lit(2)), None
    labelled = told.withColumns({"roles": F.col("spans.role"), "sizes": F.col("spans.size")})
    for k in (0, 1):
        part = _turns(told.filter(half == k), *train(labelled.filter(half != k)))
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("first", "lines", "role", "rendered"))).alias("turns"))
    truth = told.select(F.col("conv").alias("_conv"), "conv_id", "spans")
    joined = found.join(truth, F.col("conv") == F.col("_conv")).select("conv_id", "spans", "turns")
    names = [conv, "turn", "role", "n_rows", "role_pred", "starts", "rendered"]
    kind = turns.schema[conv].dataType.simpleString()
    return joined.mapInArrow(_hold_task(names), f"`{conv}` {kind}, turn long, role string, n_rows long, role_pred string, starts boolean, rendered string")
