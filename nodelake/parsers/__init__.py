"""Parsers of source files into semantic nodes, and their use on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X
from ..operators import chunk
from . import data, markup, python, rust, script

PARSERS: dict[str, Callable[[str], list[dict]]] = {
    "css": markup.css, "html": markup.html, "javascript": script.javascript, "json": data.json, "markdown": markup.markdown, "python": python.python,
    "rust": rust.rust, "toml": data.toml, "typescript": script.typescript, "yaml": data.yaml,
}

NODE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("content", "node_type", "node_name")), *(T.StructField(n, T.LongType()) for n in ("start_byte", "end_byte", "start_line", "end_line")),
    *(T.StructField(n, T.StringType()) for n in ("documentation", "parent_scope", "signature")), T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])
_STRINGS, _NUMBERS = pa.string(), pa.int64()
_ARROW = {f.name: _STRINGS if isinstance(f.dataType, T.StringType) else _NUMBERS if isinstance(f.dataType, T.LongType) else pa.map_(_STRINGS, _STRINGS) for f in NODE}


def parse(language: str, text: str | None) -> list[dict]:
    """Nodes of one text by its language's parser, in document order. Raises what the parser raises."""
    return PARSERS[language](text) if text else []


def parse_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Nodes of documents (``language``, ``content``), with the columns ``keep``, ``language``, ``ordinal`` and ``error``.

    A document that can't be parsed yields one row that has nothing but the error; it doesn't stop the others. Texts of
    languages without a parser are cut into chunks, without Python."""
    shape = T.StructType([*(docs.schema[c] for c in keep), T.StructField("language", T.StringType()), T.StructField("ordinal", T.LongType()), *NODE.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple[int, str, int, dict, str | None]] = []
                for i, (language, text) in enumerate(zip(part.column("language").to_pylist(), part.column("content").to_pylist())):
                    try:
                        rows += [(i, language, k, node, None) for k, node in enumerate(parse(language, text))]
                    except Exception as e:  # one file's error is a row of the result
                        rows.append((i, language, 0, {}, f"{type(e).__name__}: {e}"))
                took = pa.array([r[0] for r in rows], pa.int64())
                own = [part.column(c).take(took) for c in keep]
                cells = [pa.array([list(r[3][n].items()) if n == "extra" and r[3] else r[3].get(n) for r in rows], t) for n, t in _ARROW.items()]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r[1] for r in rows], _STRINGS), pa.array([r[2] for r in rows], _NUMBERS), *cells, pa.array([r[4] for r in rows], _STRINGS)], shape.names)

    known = F.col("language").isin(*PARSERS)
    parsed = docs.filter(known).select(*keep, "language", "content").mapInArrow(run, shape)
    chunked = chunk.chunks(docs.filter(~known).select(*keep, F.col("content")))
    kind = F.lit("chunk")
    none = F.lit(None).cast("string")
    extra = F.create_map(F.lit("capture_name"), kind, F.lit("tree_sitter_type"), kind)
    chunked = chunked.select(*keep, kind.alias("language"), "ordinal", "content", kind.alias("node_type"), none.alias("node_name"), "start_byte", "end_byte", "start_line", "end_line", none.alias("documentation"), none.alias("parent_scope"), none.alias("signature"), extra.alias("extra"), none.alias("error"))
    return parsed.unionByName(chunked)


def nodes(docs: DataFrame, repo_path: str = "") -> DataFrame:
    """Nodes of documents (``path``, ``hash``, ``content``) as they are stored, with errors in ``error``."""
    told = docs.withColumn("language", X.language_of(F.col("path")))
    out = parse_documents(told, ["path", "hash"])
    name = F.col("node_name")
    id = X.node_id(F.lit(repo_path), F.col("path"), F.col("ordinal"), F.col("start_byte"), F.col("end_byte"), F.col("node_type"), X.stored(name))
    text = lambda c, otherwise="": F.coalesce(F.col(c), F.lit(otherwise)).alias(c)
    return out.select(
        id.alias("id"), text("content"), "hash", F.lit(repo_path).alias("repo_path"), F.col("path").alias("document_path"), text("language", "unknown"), text("node_type", "unknown"), text("node_name"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("start_byte", "end_byte", "start_line", "end_line")), *(text(c) for c in ("documentation", "parent_scope", "signature")),
        F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"), "error")
