"""The pipeline's rows against the stages' definitions, computed the plain way."""

from __future__ import annotations

import base64

import corpus_pipeline
import public_tokenizers
import tiktoken

from nodelake.llm import scratch

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    told = brute.language([(None, *r[1:]) for r in rows])  # all are learned from
    docs = [d for d, (lang, margin) in zip(docs, told) if lang != "und" and margin >= corpus_pipeline.LEAST_MARGIN]
    kept = {i: t for (i, _), t in brute.line_dedup(docs).items() if t.strip()}
    classes = brute.jaccard(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i][0] == i and not any(b in t for b in bench)}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept)
    assert all(got[i] == own.encode_ordinary(t) for i, t in kept.items())


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_last_stage_decodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    want = {r["doc_id"]: brute.sha(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.encoded(spark, docs, SF).collect()} == want


def test_last_stage_takes_one_worker_a_task(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.encoded(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_stage_edge_cases(spark):
    """Null and empty texts, null and repeated ids, repeated rows, clashing columns, no ``n_chars``, empty tables."""
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(6).collect()]
    rows = [(i, t, "en", "s", 0.5, "own", i) for i, t in enumerate(good)] + [(1, good[1], "en", "s", 0.5, "own", 1), (None, good[2], "en", "s", 0.5, "own", 2), (90, None, None, None, 0.5, "own", 3), (91, "", "en", None, 0.5, "own", 4), (92, "1 2 3", None, "s", 0.5, "own", 5), (0, good[5] + " more", "en", "s", 0.5, "own", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, lang_pred string, digest long")
    empty = table.filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and {(r["score"], r["lang_pred"]) for r in out.collect()} == {(0.5, "own")}, name
        assert stage(spark, empty, SF).count() == 0, name
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())
    first, lines, near, clean, last = (stage for _, stage in corpus_pipeline.STAGES)
    assert not {90, 91, 92} & {i for _, i in ids(first(spark, table, SF))} and ids(first(spark, table, SF)).count((False, 1)) == 2
    assert not {90, 91} & {i for _, i in ids(lines(spark, table, SF))} and {92} <= {i for _, i in ids(lines(spark, table, SF))}
    kept = ids(near(spark, table, SF))
    assert {90, 91, 92} <= {i for _, i in kept} and kept.count((False, 1)) == 1 and (True, 0) not in kept or kept.count((False, 2)) == 0
    assert {90, 91, 92} <= {i for _, i in ids(clean(spark, table, SF))}
    assert last(spark, table, SF).count() == len(rows) and last(spark, empty, SF).count() == 0


def test_run_clears_what_stages_wrote(spark):
    before = scratch.tables(spark)
    out = corpus_pipeline.run(spark, SF)
    assert len(scratch.tables(spark) - before) == 1 and out.count() > 0
