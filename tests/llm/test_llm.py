"""Operators against plain versions, over a whole small table and cases that are easy to get wrong."""

from __future__ import annotations

import base64
import itertools
import random
import weakref
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from nodelake.llm import bpe, bytewise, chat, components, decontaminate, exchange, jaccard, language, lines, lm, order, quality, repeats, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, score double, block long, root string, _id long, rows long"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, "d", 7, 0.5, 1, "r", 3, 9) for i, t, lang, src in rows], SHAPE)


@pytest.fixture(scope="module")
def docs(spark):
    """The small table, and after it empty, null, very long, repeated and tied rows."""
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(1)
    long = "\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(200)) for _ in range(60))
    passage = " ".join(f"w{i}" for i in range(60))
    more = [
        (1000, "", "en", "s"), (1001, None, None, None), (1002, " \t\n", None, "s"), (1003, long, "en", None), (1004, long + " end", "en", "s"), (1005, "one", "xx", "s"), (1006, "One", "xx", "s"),
        (1007, f"start\n{passage}\nend", "en", "s"), (1008, f"other words\n{passage}", "en", "s"), (1009, f"x\n{passage[:150]}\n{passage[150:]}\n\ny", "en", "s"), (1010, "12345 !!! ###", "en", "s"),
        (1011, "é" * 900, "fr", "s"), (1012, "é" * 450, "fr", "s"), (1013, "a b c d e f g h " * 9, "en", "s"),
    ]
    return base + more


@pytest.fixture(scope="module")
def table(spark, docs):
    return frame(spark, docs).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_line_dedup(table, docs, empty):
    want, got = brute.line_dedup([(i, t) for i, t, _, _ in docs]), by_id(lines.report(table))
    for i, text, _, _ in docs:
        kept = want.get((i, text), "")
        assert got[i]["kept_sha256"] == brute.sha(kept), i
    assert got[1008]["n_removed"] == 1 and got[1007]["n_removed"] == 0 and got[1001]["n_lines"] == 0
    out = lines.dedup(table)
    assert out.columns == table.columns and by_id(out)[1008]["text"] == "other words" and by_id(out)[1001]["text"] is None
    assert lines.report(empty).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    run = "\n".join(f"line {i} " + "word " * 9 for i in range(8))
    rows = [(1, run, "en", "s"), (1, run, "en", "s"), (None, run, "en", "s"), (2, run + "\nmore", "en", "s")]
    got = [(r["doc_id"], r["n_removed"]) for r in lines.report(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == [(1, 8), (1, 8), (2, 8), (None, 0)]  # null ids come first


def test_language_model(table, docs, empty):
    got = by_id(lm.report(table, lm.Settings(block=100_000)))
    for i, (n, known, total, base, score) in brute.language_model([(i, t) for i, t, _, _ in docs]).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, brute.fold(i, 7) == 2)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.report(empty).count() == 0


def test_language_model_states_help(table):
    """With pairs as states, held-out texts are likelier than with words alone; long texts go in pieces."""
    with_pairs, without = (sum(r["score"] for r in lm.report(table, s).collect() if r["held_out"]) for s in (lm.Settings(), lm.Settings(least=1 << 40)))
    assert with_pairs > without


def test_exchange_messages(spark, table):
    """No message without keys; numbers and texts come out of their packing as they went in."""
    for x in ([], [0], [3, 1, 70_000], list(range(1000)), [1 << 40]):
        assert exchange.large(exchange.small(np.array(x, np.int64))).tolist() == x
    blocks, n = exchange.texts(table, "text", size=50_000)
    texts = {r["text"] or "" for r in table.select("text").collect()}
    got = [t for (_,), t in ((k, exchange.merged(pa.Table.from_pandas(v, preserve_index=False))[1].to_pylist()) for k, v in blocks.toPandas().groupby(["block"]))]
    assert n > 5 and sorted(x for t in got for x in t) == sorted(texts)


def test_language_model_without_training(spark):
    got = lm.score(frame(spark, [(1, "a b", "en", "s")]), F.lit(False)).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["score"], got["base_score"]) == (3, 0, 0, 0.0, 0.0)


def test_decontamination(spark, table, docs, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(table, items).collect()}
    whole = {(i, k) for i, t, _, _ in docs for k, b in bench if b in (t or "")}
    assert whole and whole <= found
    assert {i for i, _ in found} == {i for i, _ in whole}  # nothing else is touched
    text = bench[0][1]
    edited = [(1, "before. " + text.upper() + " after", "en", "s"), (2, text.replace("the", "teh", 2), "en", "s"), (3, text[::-1], "en", "s"), (4, "x " * 5000 + text.replace(" ", "\n"), "en", "s"), (5, None, "en", "s"), (None, text, "en", "s")]
    got = {r["doc_id"] for r in decontaminate.find(frame(spark, edited), items).collect()}
    assert got == {1, 2, 4, None}
    assert {r["doc_id"] for r in decontaminate.clean(frame(spark, edited), items).collect()} == {3, 5}
    none = items.filter("false")
    assert decontaminate.find(table, none).count() == 0 and decontaminate.clean(table, none).count() == table.count()
    assert decontaminate.find(empty, items).count() == 0
    small = decontaminate.Settings(block=2000)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(table, items, small).collect()} == found


def test_decontamination_folds_case_of_all_letters(spark):
    text = "L'été dernier, les élèves préférés du collège étaient très énervés à Noël, où la fête fut gâchée par la grêle"
    other = "Größere Straßen heißen außerhalb der Städte öfter Schnellstraßen, und niemand weiß genau, weshalb es so ist"
    items = spark.createDataFrame([(1, text), (2, other)], "item_id long, text string")
    rows = [(1, "İİK before. " + text.upper() + " after", "fr", "s"), (2, other.upper(), "de", "s"), (3, text.lower()[::-1], "fr", "s")]
    got = {r["doc_id"]: r for r in decontaminate.find(frame(spark, rows), items).collect()}
    assert {i: (r["item_id"], r["edits"]) for i, r in got.items()} == {1: (1, 0), 2: (2, 0)}
    assert rows[0][1].encode()[got[1]["start"] : got[1]["end"]].decode() == text.upper()
    assert [r["doc_id"] for r in decontaminate.clean(frame(spark, rows), items).collect()] == [3]


def test_decontamination_of_parts_and_short_items(spark):
    text = " ".join(f"{w}{i}" for i, w in enumerate(["amber", "basin", "cedar", "delta", "ember", "fjord", "glade", "heron"] * 30))
    size = decontaminate.Settings().window + decontaminate.Settings().stride - 1
    items = spark.createDataFrame([(1, text), (2, "Warum 7 Elche?"), (3, "né à"), (4, "  "), (5, None), (6, "né à")], "item_id long, text string")
    at = random.Random(4).sample(range(len(text) - size), 40) + [0, len(text) - size, 1024 - size, 1023, 1024]
    rows = [(k, "Z" * 70 + text[i : i + size] + "Q" * 70, "en", "s") for k, i in enumerate(at)]
    rows += [(100, "da: WARUM 7 ELCHE?", "de", "s"), (101, "warum 7 elches", "de", "s"), (102, "ligné à Paris", "fr", "s"), (103, "NÉ À", "fr", "s"), (104, "né àé né àù", "fr", "s"), (105, text, "en", "s")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(frame(spark, rows), items).collect()}
    assert set(got) == {(k, 1) for k in range(len(at))} | {(100, 2), (103, 3), (103, 6), (105, 1)}
    assert all(r["edits"] == 0 for r in got.values())
    assert len(text) // 128 <= got[105, 1]["passages"] <= len(text) // 64 and (got[105, 1]["start"], got[105, 1]["end"]) == (0, len(text))
    assert {r["doc_id"] for r in decontaminate.clean(frame(spark, rows), items).collect()} == {101, 102, 104}


def test_decontamination_of_items_of_any_type_and_repeated_ids(spark):
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(30))
    a, b, c = text(), text(), text()
    items = spark.createDataFrame([("x", a), ("x", b), ("y", c), ("y", c), (None, "short one")], "item_id string, text string")
    rows = [(1, f"{a} between {b}", "en", "s"), (2, c.replace(" ", "  \n "), "en", "s"), (2, c.replace(" ", "  \n "), "en", "s"), (3, "a short one", "en", "s"), (4, text(), "en", "s")]
    want = None
    for size in (decontaminate.Settings(), decontaminate.Settings(block=60), decontaminate.Settings(portion=50)):
        got = sorted((r["doc_id"], str(r["item_id"]), r["passages"], r["edits"]) for r in decontaminate.find(frame(spark, rows), items, size).collect())
        assert [g[:2] for g in got] == [(1, "x"), (2, "y"), (2, "y"), (3, "None")] and all(g[3] == 0 for g in got)
        want = want or got
        assert got == want


def test_decontamination_of_repetitive_text():
    """A document and an item full of one q-gram are compared in portions."""
    index = decontaminate.Passages([(0, "na" * 200), (1, "x" * 300)], decontaminate.Settings(portion=10_000))
    document = ("start " + "na" * 3000 + " end " + "y" * 5000).encode()
    found = index.matches(np.frombuffer(document, np.uint8), np.array([0, len(document)]))
    assert found and {index.items[p] for _, p, *_ in found} == {0} and all(e == 0 for _, _, e, *_ in found)


def test_decontamination_finds_what_plain_alignment_finds():
    """Best edits of each passage in a short text, by dynamic programming over the whole text."""
    rng = random.Random(13)
    words = ["tree", "river", "stone", "cloud", "sand", "fern", "moss"]
    for _ in range(12):
        item = " ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(14))
        index = decontaminate.Passages([(0, item)], decontaminate.Settings())
        copy = list(item)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(["", "q", "zz"])
        document = "some words before " + "".join(copy) + " and some after"
        raw = np.frombuffer(document.encode(), np.uint8)
        got = {p: e for _, p, e, *_ in index.matches(raw, np.array([0, len(raw)]))}
        want = {}
        for p in range(index.n_long):
            body = bytes(index.body[index.body_at[p] : index.body_at[p] + index.sizes[p]]).decode()
            row = [0] * (len(document) + 1)
            for i, x in enumerate(body, 1):
                row, last = [i], row
                for k, y in enumerate(document, 1):
                    row.append(min(last[k] + 1, row[k - 1] + 1, last[k - 1] + (x != y)))
            if min(row) <= index.edits[p]:
                want[p] = min(row)
        assert got == want


def test_alignment_counts_edits():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("abcd ") for _ in range(120))
        other, edits = list(text), rng.randint(0, 9)
        for _ in range(edits):
            k = rng.randrange(len(other))
            other[k : k + 1] = rng.choice(([], ["x"], [other[k], "y"]))
        document = ("q" * 50 + "".join(other) + "z" * 50).encode()
        index = decontaminate.Passages([(0, text)], decontaminate.Settings())
        found = index.matches(np.frombuffer(document, np.uint8), np.array([0, len(document)]))
        assert found and found[0][2] <= edits


def test_jaccard(table, docs, empty):
    got = by_id(jaccard.report(table))
    for i, want in brute.jaccard([(i, t) for i, t, _, _ in docs]).items():
        assert (got[i]["class_id"], got[i]["n_links"]) == want, i
    assert jaccard.report(empty).count() == 0 and jaccard.dedup(empty).count() == 0


def test_jaccard_of_large_groups_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:150], f"own{i}", *words[150:]]), "en", "s") for i in range(60)] + [(100, " ".join(words), "en", "s")] * 3 + [(None, "only words here", "en", "s"), (7777, "", "en", "s"), (7778, None, "en", "s")]
    table = frame(spark, rows)
    got = jaccard.report(table, jaccard.Settings(rows=16, node=8)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None and r["doc_id"] <= 100} == {(0, 62)}
    assert {(r["class_id"], r["n_links"]) for r in got if r["doc_id"] is None or r["doc_id"] > 100} == {(None, 0), (7777, 0), (7778, 0)}
    out = jaccard.dedup(table, jaccard.Settings(rows=16, node=8))
    assert out.columns == table.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [0, 7777, 7778, None]
    twice = jaccard.dedup(frame(spark, [(1, "a b c d e f", "en", "s")] * 2))
    assert twice.count() == 1


def test_jaccard_with_empty_blocks(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(10 * g + k, " ".join([f"g{g}", *(f"{g}{w}" for w in words[:150]), f"own{k}", *(f"{g}{w}" for w in words[150:])]), "en", "s") for g in range(12) for k in range(1 + g % 3)]
    want = brute.jaccard([(i, t) for i, t, _, _ in rows])
    for s in (jaccard.Settings(bytes=500), jaccard.Settings(bytes=2000), jaccard.Settings(node=1)):
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.report(frame(spark, rows), s).collect()} == want


def test_forest_shortens_prefixes_until_the_recall():
    s = jaccard.Settings()
    for found in ({0.8: 5}, {0.8: 1, 0.99: 10**7}, {0.7: 3}):
        d = jaccard.needed(found, s.longest, s)
        assert jaccard.meets(0.8, d, s) >= s.recall > jaccard.meets(0.8, d + 1, s)
    longer = jaccard.needed({0.98: 10}, s.longest, s)
    assert d < longer < s.longest and longer == jaccard.needed({}, s.longest, s) and jaccard.meets(0.8, longer, s) >= s.seen
    assert jaccard.needed({0.8: 5}, 3, s) == 3


def test_forest_recall(spark):
    """Pairs of every similarity from the threshold up share a node at the depth that is settled on."""
    rng = random.Random(6)
    rows = []
    for k in range(150):
        words = [f"{k}w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(200), rng.randint(0, 3)):
            other[at] = f"other{at}"
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, " ".join(other), "en", "s")]
    want = brute.jaccard([(i, t) for i, t, _, _ in rows])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.report(frame(spark, rows)).collect()}
    assert got == want and sum(n for _, n in want.values()) > 200


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components.label(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_components_in_portions_of_any_type(spark, monkeypatch):
    written, write = [], components.scratch.table
    monkeypatch.setattr(components.scratch, "table", lambda df: written.append(df) or write(df))
    rng = random.Random(4)
    path = list(range(150))
    rng.shuffle(path)
    pairs = [*zip(path, path[1:]), *((1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(30)), *((2000, 2001 + i) for i in range(60)), (2000, 2001), (2001, 2000)]
    for name, kind in ((lambda x: b"\xff\x01%05d" % x, "binary"), (lambda x: f"é{x:05d}", "string")):
        named = [(name(a), name(b)) for a, b in pairs] + [(None, name(3))]
        table = spark.createDataFrame(named, f"a {kind}, b {kind}").repartition(3)
        want = {r["node"]: r["root"] for r in components.label(table).collect()}
        assert want[name(77)] == name(0) and want[name(2060)] == want[name(2000)] == name(2000) and len(want) == len({x for p in named[:-1] if p[0] != p[1] for x in p})
        assert all(want[a] == want[b] for a, b in named[:-1] if a != b) and all(root == min(x for x in want if want[x] == root) for root in set(want.values()))
        if kind == "binary":  # tasks that see few edges leave more to the rounds between them
            written.clear()
            rows = components.label(table, 20).collect()
            assert len(written) >= 7 and {r["node"]: r["root"] for r in rows} == want and len(rows) == len(want)
    assert components.label(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_write_few_tables(spark, monkeypatch):
    written, table = [], components.scratch.table
    monkeypatch.setattr(components.scratch, "table", lambda df: written.append(df) or table(df))
    path = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long").repartition(4)
    assert {r["root"] for r in components.label(path).collect()} == {0}
    assert len(written) == 3


def test_numbering(spark):
    rows = [(i * 7919 % 1000, i % 5 + 1) for i in range(1000)]
    got = order.number(spark.createDataFrame(rows, "k long, w long"), ["k"], "w").orderBy("k").collect()
    total = 0
    for r in got:
        assert r["rank"] == total
        total += r["w"]


def test_repeats(spark, docs, empty):
    rows = [*docs, (2000, docs[0][1], "en", "s"), (None, "z" * 900, "en", "s"), (None, "z" * 900, "en", "s"), (3000, "ab" * 700, "en", "s")]
    want = sorted((str(i), *x) for (i, *_), x in zip(rows, brute.repeats([(i, t) for i, t, _, _ in rows])))
    for settings in (repeats.Settings(block=60_000), repeats.Settings(block=60_000, group=1), repeats.Settings(spans=(50, 9, 1), gram=8, block=60_000, group=3)):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.report(frame(spark, rows), settings).collect())
        assert got == want, settings
    assert repeats.report(empty).count() == 0


def test_repeats_sorts_suffixes():
    rng = random.Random(8)
    raw = "".join(rng.choice("ab") for _ in range(3000)).encode()
    raw += raw[500:900] + raw[600:800]
    at = np.arange(len(raw) - 100)
    rank = repeats.suffix_ranks(np.frombuffer(raw, np.uint8), at, 100)
    cut = [raw[i : i + 100] for i in at]
    names = {x: k for k, x in enumerate(sorted(set(cut)))}
    assert rank.tolist() == [names[x] for x in cut]
    previous, following = repeats.factors(np.zeros(len(at), int), rank, at)
    first, last = {x: i for i, x in reversed(list(enumerate(cut)))}, {x: i for i, x in enumerate(cut)}
    assert previous.tolist() == [first[x] < i for i, x in enumerate(cut)] and following.tolist() == [last[x] > i for i, x in enumerate(cut)]


def test_repeats_keeps_first(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, same = text(700), text(900)
    rows = [(1, text(300) + shared + text(200), "en", "s"), (2, text(100) + shared, "en", "s"), (3, same, "en", "s"), (4, same, "en", "s")]
    for group in (2048, 1):
        got = by_id(repeats.report(frame(spark, rows), repeats.Settings(keep="first", group=group)))
        assert sorted((got[1]["n_removed"], got[2]["n_removed"])) == [0, 700]
        assert (got[3]["n_removed"], got[4]["n_removed"], got[4]["n_spans"]) == (0, 900, 1)


def test_language(spark, table, docs, empty):
    got = by_id(language.identify(table))
    known = [(i, lang) for i, _, lang, _ in docs if i < 1000]
    held = [(i, lang) for i, lang in known if got[i]["held_out"]]
    assert held and sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(got[i]["held_out"] == (brute.fold(i, 3) == 1) and 0 <= got[i]["score"] <= 1 for i, *_ in docs)
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    assert language.identify(empty).count() == 0
    alone = language.identify(frame(spark, [(1, "some words", None, "s"), (None, "words", None, "s")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in alone} == {("und", 0.0)}


def test_language_against_plain_profiles(table, docs):
    got = by_id(language.identify(table))
    for (i, *_), (lang, score) in zip(docs, brute.language([(i, t, x) for i, t, x, _ in docs])):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score), i


def test_quality_verdicts_against_exact_quantiles(spark, table, docs):
    """Groups are smaller than the sketches here, so their quantiles are exact."""
    got = by_id(quality.judge(table))
    for (i, *_), kept in zip(docs, brute.quality_verdicts([(t, lang, src) for _, t, lang, src in docs])):
        assert got[i]["kept"] == kept, i
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    whole = by_id(quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    bad = [i for i, q in labels.items() if q == 0 and not whole[i]["base_failed"]]
    assert bad and sum(not whole[i]["kept"] for i in bad) >= 0.9 * len(bad)


def test_quality(spark, table, docs, empty):
    got = by_id(quality.judge(table))
    assert len(got) == len(docs)
    for i, text, _, _ in docs:
        n, chars, symbols, dups, repeated = brute.quality(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeated), i
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n) and not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in good) >= 0.98 * len(good)
    assert quality.judge(empty).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    rows = [(i, " ".join(["word"] * 5 + [f"tok{i}x{k}" for k in range(40)]), "en", "plain") for i in range(150)] + [(1000 + i, " ".join(f"a{i}{k} # $" for k in range(40)), "en", "code") for i in range(150)] + [(5000, " ".join(f"b{k} # $" for k in range(40)), "en", "plain")]
    got = by_id(quality.judge(frame(spark, rows)))
    assert all(got[i]["kept"] for i in range(150)) and all(got[1000 + i]["kept"] for i in range(150))
    assert not got[5000]["kept"]


def test_quality_bounds_differ_by_group_for_each_rate(spark):
    words = lambda i, n: [f"tok{i}x{k}" for k in range(n)]
    plain = lambda i: "\n".join(" ".join(words(f"{i}y{k}", 10)) for k in range(20))
    lively = lambda i: "\n".join([*(" ".join([*words(f"{i}y{k}", 9), "#" * (1 + i % 3)]) for k in range(16)), " ".join(words(i, 12)), " ".join(words(i, 12))])
    odd = [
        (1000, "\n".join(" ".join([*words(f"o{k}", 9), "###"]) for k in range(20)), "en", "plain"),  # 0.3 symbols a word
        (1001, "\n".join([*(" ".join(words(f"p{k}", 60)) for k in range(8)), *(f"line{k}" for k in range(4) for _ in range(3))]), "en", "plain"),  # 40 % duplicate lines
        (1002, " ".join([*words("q", 25), *words("q", 25), *words("r", 130)]), "en", "plain"),  # 28 % repeated words
    ]
    rows = [(i, plain(i), "en", "plain") for i in range(150)] + [(500 + i, lively(i), "en", "lively") for i in range(150)] + odd
    table = frame(spark, rows)
    got = by_id(quality.judge(table))
    assert all(got[i]["kept"] for i in [*range(150), *range(500, 650)])
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i, *_ in odd)
    limits = {r["_source"]: r for r in quality.thresholds(quality._rates(quality.features(table)), quality.Rules(), "lang", "source").collect()}
    assert all(limits["plain"][f"{r}_high"] < limits["lively"][f"{r}_high"] for r in ("symbol_rate", "dup_line_rate", "repeat_rate"))


def test_bpe(spark, table, docs, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digests(table, path, pattern))
    for i, text, _, _ in docs:
        ids = own.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text or "")), i
    assert bpe.digests(empty, path, pattern).count() == 0
    encoded = bpe.encode(table, path, pattern)
    assert encoded.columns == [*table.columns, "ids"]
    for r in bpe.decode(encoded, path).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_round_trip(spark, table, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    two = bpe.decode(bpe.encode(table, path, pattern), path).drop("text")
    one = bpe.round_trip(table, path, pattern)
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert bpe.round_trip(empty, path, pattern).count() == 0
    clash = table.select("text", F.lit(1).alias("ids"), F.lit(2).alias("decoded"))
    assert bpe.round_trip(clash, path, pattern).columns == ["ids", "decoded"]


def test_workers_drop_the_encoder_for_another_operator():
    """A worker is handed to tasks of any stage; it keeps one encoder for all tasks of operator 8, none for those of others."""
    ranks = SimpleNamespace(value=("one", {bytes([i]): i for i in range(256)}))
    known = weakref.ref(bpe._encoder(ranks, r"\S+|\s+"))
    assert known().encode("ab") == [97, 98] and bpe._encoder(ranks, r"\S+|\s+") is known()
    assert len(list(bytewise.steps(pa.array(["a text", None])))) == 1
    assert known() is None


def test_bpe_of_random_pieces():
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoder = bpe.Encoder(bpe.read_ranks(path), pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice("aeinorst \n'é漢0.x\U0001f600") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == own.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()
    assert encoder.encode("a" * 5000) == own.encode_ordinary("a" * 5000)


def test_viterbi_over_segments():
    """Best paths of a sequence and of its segments, joined at their borders, weigh the same."""
    rng = np.random.default_rng(2)
    emit, move = (np.log(rng.dirichlet(np.ones(n), chat.STATES)) for n in (chat.SYMBOLS, chat.STATES))
    for _ in range(10):
        x = rng.integers(0, chat.SYMBOLS, 50)
        whole = chat.paths([x], emit, move, [-1], [-1])[0]
        parts = np.split(x, [13, 20, 44])
        key = pa.table({"conv": ["c"] * 4, "segment": list(range(4)), "part": [0] * 4, "weights": pa.array([chat.weights(p, emit, move).tobytes() for p in parts], pa.binary())})
        first = chat.weights(parts[0][1:], emit, move)  # the first segment begins with its first line
        assert first.shape == (chat.STATES, chat.STATES)
        borders = chat._borders(("c",), key)
        before, last = borders.column("before").to_pylist(), borders.column("last").to_pylist()
        joined = np.concatenate(chat.paths(parts, emit, move, before, last))
        weigh = lambda p: np.where(p[0] % 2, -30.0, 0.0) + emit[p, x].sum() + move[p[:-1], p[1:]].sum()
        assert weigh(joined) == pytest.approx(weigh(whole))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    emit, move = (np.log(rng.dirichlet(np.ones(n), chat.STATES)) for n in (chat.SYMBOLS, chat.STATES))
    for n in (1, 2, 5):
        x = rng.integers(0, chat.SYMBOLS, n)
        begin = np.where(np.arange(chat.STATES) % 2 == 0, 0.0, -30.0)
        best = max(itertools.product(range(chat.STATES), repeat=n), key=lambda p: begin[p[0]] + sum(emit[a, b] for a, b in zip(p, x)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        assert chat.paths([x], emit, move, [-1], [-1])[0].tolist() == list(best)


def test_chat_accuracy_by_style(spark):
    """Roles of turns in each style, by tables that never saw the conversation."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    style = F.pmod(F.xxhash64(F.concat(F.lit("id "), F.col("conv_id").cast("string"))), F.lit(len(chat.STYLES)))
    got = chat.recover(turns).groupBy(style.alias("style")).agg(F.avg((F.col("role") == F.col("role_pred")).cast("int")).alias("right"), F.avg(F.col("starts").cast("int")).alias("starts")).collect()
    assert len(got) == len(chat.STYLES)
    for r in got:
        assert r["right"] >= (0.98 if r["style"] < 4 else 0.85) and r["starts"] >= (0.98 if r["style"] < 4 else 0.8), r


def test_chat_takes_off_markers_alone():
    assert chat.unmarked(["user", "assistant"], ["User: hi", "Assistant: # A guide"]) == ["hi", "# A guide"]
    assert chat.unmarked(["user", "assistant"], ["# A guide to bread", "Model: T-34 tank"]) == ["# A guide to bread", "Model: T-34 tank"]
    assert chat.unmarked(["user", "assistant", "user"], ["Q: hi", "A: [AI] winter", "[AI] winter"]) == ["hi", "[AI] winter", "[AI] winter"]
    assert chat.unmarked(["user", "assistant"], ["### Instruction", "### Response"]) == ["", ""]
    assert chat.unmarked(["assistant"], ["Model: T-34 tank"]) == ["Model: T-34 tank"] and chat.unmarked([], []) == []
    assert chat.unmarked(["system", "assistant"], ["User: a", "Assistant: b"]) == ["User: a", "b"]


def test_chat(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = chat.recover(turns).collect()
    assert len(got) == turns.distinct().count()
    assert sum(r["role"] == r["role_pred"] for r in got) >= 0.9 * len(got)
    assert all(r["rendered"].startswith(f"<|{r['role_pred']}|>\n") and r["rendered"].endswith("\n<|end|>\n") for r in got)


def test_chat_edge_cases(spark):
    shape = "conv_id long, turn long, role string, text string, raw string, symbols string"
    style = spark.range(100).select("id", F.pmod(F.xxhash64(F.concat(F.lit("id "), F.col("id").cast("string"))), F.lit(len(chat.STYLES))).alias("s"))
    marked = style.filter("s = 0 and id > 3").first()["id"]
    long = [(marked, i, "user" if i % 2 == 0 else "assistant", f"text {i}\nand more", "", "") for i in range(600)]
    ties = [(2, 0, "user", f"hello {i}", "", "") for i in range(600)]
    odd = [(3, 0, None, None, "", ""), (3, None, "other", "", "", ""), (None, 0, "user", "x", "", ""), (None, 0, "user", "x", "", "")]
    got = chat.recover(spark.createDataFrame([*long, *ties, *odd], shape)).collect()
    assert len(got) == 600 + 600 + 3
    assert [r["n_rows"] for r in got if r["conv_id"] is None] == [2]
    assert sum(r["role"] == r["role_pred"] for r in got if r["conv_id"] == marked) == 600
    assert chat.recover(spark.createDataFrame([], shape)).count() == 0


def test_chat_parses_raw_transcripts(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    told = chat.observe(chat.written(turns)).withColumns({"roles": F.col("spans.role"), "sizes": F.col("spans.size")})
    tables = chat.train(told)
    lines = [("system", "### Context\nBe brief."), ("user", "### Instruction\nWhat is rain?\nTell me more of it."), ("assistant", "### Response\nWater.")]
    long = lines[:1] + lines[1:] * 400
    raw = [(1, "\n".join(t for _, t in lines)), (2, "\n".join(t for _, t in long)), (3, None), (1, "\n".join(t for _, t in lines))]
    got = chat.parse(spark.createDataFrame(raw, "conv_id long, text string"), *tables).orderBy("conv_id", "first").collect()
    for i, want, copies in ((1, lines, 2), (2, long, 1)):
        own = [r for r in got if r["conv_id"] == i][::copies]
        assert [r["role"] for r in own] == [r for r, _ in want]
        assert [r["rendered"] for r in own] == [f"<|{r}|>\n{t.split(chr(10), 1)[1]}\n<|end|>\n" for r, t in want]
    assert len(got) == 2 * len(lines) + len(long) + 1
    # a role's change inside a row is a turn of its own; every line is rendered
    one = [(10**6, 0, "user", "Hello there\nUser: What is rain?\nAssistant: Water.\nUser: And what is snow?\nAssistant: Ice.")]
    more = turns.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(one, "conv_id long, turn long, role string, text string"))
    row = next(r for r in chat.recover(more).collect() if r["conv_id"] == 10**6)
    assert row["rendered"].count("<|end|>") > 1 and "<|assistant|>\nIce.\n<|end|>\n" in row["rendered"]
    assert all(x in row["rendered"] for x in ("Hello there", "What is rain?", "Water.", "And what is snow?"))


def test_chat_cuts_turns_by_states():
    assert chat.cut(np.array([2, 3, 2, 3, 5, 4, 1])).tolist() == [0, 2, 4, 5, 6] and chat.cut(np.array([3])).tolist() == [0]


def test_markers(spark):
    lines_ = ["User: hi", "**Assistant:** yes", "### Instruction", "<|system|>", "[AI]", "Q: what?", "a quick fox", "users: three", "", "Answer: x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines_], "x string").select(chat.symbol(F.col("x")) / chat.FEATURES).collect()]
    assert [int(x) for x in got] == [2, 3, 2, 1, 3, 2, 0, 0, 0, 3]


def test_toxicity_on_the_tables(spark):
    """Held-out documents of the larger table, with settings that were chosen on its training rows alone."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = by_id(toxicity.detect(spark.read.parquet(f"{sf}/documents.parquet"), labels))
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.02 * sum(not t for _, t in held)


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, f"text {i} " + "word " * 50, "en", "s") for i in range(50)] * 3 + [(99, "long " * 10_000, "en", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    texts, marks = toxicity.sample(frame(spark, rows), labels, toxicity.Settings(rows_each=(10, 60), bytes=5000), "doc_id", "text", "toxic")
    assert 0 < len(texts) == len(marks) < 25 and sum(len(x) for x in texts.to_pylist()) <= 5000


def test_toxicity(spark, table, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    rows, marks = [], []
    for i in range(600):
        text = [word() for _ in range(rng.randint(20, 300))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), "zxqwv" + word())  # a new word each time
        rows.append((i, " ".join(text), "en", "s"))
        marks.append((i, int(i % 4 == 0)))
    labels = spark.createDataFrame([*marks, (5, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    got = by_id(toxicity.detect(frame(spark, [*rows, (7000, None, "en", "s"), (7001, "", "en", "s")]), labels))
    held = [i for i in range(600) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (brute.fold(i, 3) == 1) for i in range(600))
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) >= 0.95
    assert got[7000]["score"] == got[7001]["score"] and got[7000]["predicted"] == 0
    assert toxicity.detect(empty, labels).count() == 0
    none = toxicity.detect(table, labels.filter("false"))
    assert {r["score"] for r in none.collect()} == {0.5}
