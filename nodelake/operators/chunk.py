"""Fixed-size chunks of text, in characters, as projections without any Python.

A text is cut once into pieces as long as the step between chunks, so the work is linear in the text however long it is:
a chunk is its piece and the beginnings of the next, and its first line is counted from sums over groups of pieces and over
groups of groups, so at most three times ``GROUP`` numbers are added up for a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces in a group for which line breaks are summed.
GROUP = 256


def once(df: DataFrame, *columns: str, **new: Column) -> DataFrame:
    """Columns and new ones, each computed once: what follows a generator isn't merged into what is before it."""
    return df.select(*columns, F.inline(F.array(F.struct(*(c.alias(n) for n, c in new.items())))))


def chunks(docs: DataFrame, size: int = 250, overlap: int = 25, text: str = "content") -> DataFrame:
    """``docs`` without its text, and for each chunk ``ordinal``, ``start_byte``, ``end_byte`` (character offsets),
    ``start_line``, ``end_line``, ``content``. Empty and null texts have none; an overlap of the size or more steps by 1."""
    stride = max(1, size - overlap)
    keep = [c for c in docs.columns if c != text]
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    cut = once(docs.filter(F.col(text) != ""), *keep, _pieces=F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)))
    counted = once(cut, *keep, "_pieces", _breaks=F.transform("_pieces", breaks))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_pieces") - 1) / GROUP).cast("int")), lambda g: total(F.slice("_breaks", g * GROUP + 1, GROUP)))
    length = (F.size("_pieces") - 1) * stride + F.length(F.element_at("_pieces", -1))
    grouped = once(counted, *keep, "_pieces", "_breaks", _groups=groups, _length=length)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_groups") - 1) / GROUP).cast("int")), lambda b: total(F.slice("_groups", b * GROUP + 1, GROUP)))
    grouped = once(grouped, *keep, "_pieces", "_breaks", "_groups", "_length", _blocks=blocks)

    def one(i: Column) -> Column:
        group, block = F.floor(i / GROUP).cast("int"), F.floor(i / GROUP**2).cast("int")
        before = total(F.slice("_blocks", 1, block)) + total(F.slice("_groups", block * GROUP + 1, group - block * GROUP))
        line = before + total(F.slice("_breaks", group * GROUP + 1, i - group * GROUP)) + 1
        content = F.substring(F.array_join(F.slice("_pieces", i + 1, -(-size // stride)), ""), 1, size)
        return F.struct(
            i.cast("long").alias("ordinal"), (i * stride).cast("long").alias("start_byte"), F.least(i * stride + size, F.col("_length")).cast("long").alias("end_byte"),
            line.cast("long").alias("start_line"), content.alias("content"))

    rows = grouped.select(*keep, F.inline(F.transform(F.sequence(F.lit(0), F.size("_pieces") - 1), one)))
    return rows.select(*keep, "ordinal", "start_byte", "end_byte", "start_line", (F.col("start_line") + breaks(F.col("content"))).cast("long").alias("end_line"), "content")
