"""The stages that turn ``documents`` into encoded training text, which the last of them decodes, too.

Each stage reads all that the one before it kept, as a table, and applies one operator of ``nodelake.llm``.

Defined results, of all stages: an empty table gives an empty one; documents keep their own columns, whatever their names, and
``doc_id`` may be null or repeated; texts are worked on whole. What each makes of null and empty texts, ties and repeated rows
is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodelake.llm import bpe, decontaminate, jaccard, language, lines, scratch

#: A document whose nearest language is nearer by less than this is in none of the languages.
LEAST_MARGIN = 0.03


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents are labelled with; others go (no letter, no clear language).

    Null and empty texts go, as do those as near to two languages; repeated rows stay or go together."""
    scratch.tune(spark)
    told = language.predict(docs, language.train(docs), names=("__lang", "__margin"))
    return told.filter((F.col("__lang") != "und") & (F.col("__margin") >= LEAST_MARGIN)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go. A document that loses all of its text goes with it.

    Null and blank texts go; of equal documents the first by id stays (by text among equal ids), and rows equal in both are one
    document, whose rows stay together. ``n_chars`` follows the text where there is such a column."""
    scratch.tune(spark)
    left = lines.dedup(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.filter(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Documents without words are in no group and stay; of ties and repeated rows, one stays."""
    scratch.tune(spark)
    return jaccard.dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none; repeated rows stay or go together; an empty benchmark keeps all."""
    scratch.tune(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and the SHA-256 of the bytes that they decode to: a row for each row.

    Null and empty texts have no ids."""
    scratch.tune(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", without_benchmark), ("byte-level BPE", encoded)]

#: SQL can express none of the last three stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as a table and read by the next."""
    docs = scratch.tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    others = scratch.tables(spark)
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.clear(spark, docs, names=others)  # what the stage read, and what it wrote besides
    return docs
