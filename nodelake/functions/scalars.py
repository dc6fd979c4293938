"""Scalar functions as column expressions; all stay in the JVM and mean the same in ANSI SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of heading names.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with")

#: Parser language by path suffix.
LANGUAGES = {
    ".css": "css", ".html": "html", ".js": "javascript", ".jsx": "javascript", ".json": "json", ".md": "markdown", ".mkd": "markdown",
    ".markdown": "markdown", ".py": "python", ".rs": "rust", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript", ".yaml": "yaml", ".yml": "yaml",
}

#: White space as Python's str methods see it.
_SPACE = r"(?U)\s"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_hash(path: Column, content: Column) -> Column:
    """Hash of path and content together: equal contents at two paths differ; null if either is null."""
    return F.sha2(F.concat(path, F.lit(":"), content), 256)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix of the last component, in lower case; dotfiles and names that end in a dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def relative_path(path: Column, root: str) -> Column:
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def collection_name(name: Column, prefix: str = "nodelake_") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "_"))


def line_number(before: Column) -> Column:
    """1-based line of an offset, from the text before it."""
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def normalize(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), f"{_SPACE}+", " "))


def drop_stopwords(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(*STOPWORDS) & (w != "")), " ")


def first_words(text: Column, n: int = 5, otherwise: Column | None = None) -> Column:
    words = F.array_join(F.slice(F.split(text, " "), 1, n), " ")
    return words if otherwise is None else F.when(words != "", words).otherwise(otherwise)


def truncate(text: Column, n: int = 100) -> Column:
    return F.substring(text, 1, n)


def is_constant_name(name: Column) -> Column:
    return (F.upper(name) == name) & (F.lower(name) != name)


def clean_doc_comment(comment: Column) -> Column:
    """Text of a ``/** ... */`` block: lines trimmed, one leading star off each, blank ones dropped."""
    body = F.regexp_replace(comment, r"^/\*+!?|\*+/$", "")
    lines = F.transform(F.split(body, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^\*", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_docstring(text: Column) -> Column:
    out = F.lit(None)
    for quote in ("'", '"', "'''", '"""'):
        n = len(quote)
        quoted = text.startswith(quote) & text.endswith(quote) & (F.length(text) >= 2 * n)
        out = F.when(quoted, F.substr(text, F.lit(n + 1), F.length(text) - 2 * n)).otherwise(out)
    return strip(F.coalesce(out, text))


def stored(text: Column) -> Column:
    """Nulls are stored as empty strings."""
    return F.coalesce(text, F.lit(""))


def payload(core: dict[str, Column], extra: Column) -> Column:
    """Core columns as a map of strings and, over them, the extra keys."""
    first = F.create_map(*(x for k, c in core.items() for x in (F.lit(k), stored(c.cast("string")))))
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(extra), k)), extra)


def preview(content: Column, n: int = 50) -> Column:
    return F.concat(F.substring(F.replace(strip(content), F.lit("\n"), F.lit(" ")), 1, n), F.lit("..."))


def nearest(x: Column, digits: int) -> Column:
    """``x`` to so many digits as DuckDB rounds: ``x * 10 ** digits`` to the nearest whole number, halves away from zero, and back.
    ``F.round`` goes by the shortest decimals instead: 0.145 is 0.15 there and 0.14 here, as 14.499999999999998 is nearer to 14."""
    unit = 10.0**digits
    size = F.abs(x.cast("double") * unit)
    whole = F.floor(size)
    return F.signum(x) * F.when(size - whole >= 0.5, whole + 1).otherwise(whole) / unit


def score_text(score: Column) -> Column:
    return F.format_string("%.4f", score)


def node_id(*parts: Column) -> Column:
    """A reproducible id in the form of a UUID, from what tells a node apart."""
    h = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts))


def language_of(path: Column) -> Column:
    """Parser for a path: by its suffix, else the chunker."""
    cases = reduce(lambda c, kv: c.when(suffix(path) == kv[0], kv[1]), LANGUAGES.items(), F)
    return cases.otherwise("chunk")


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-8 where valid, else Latin-1; line ends become LF."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def effective_limit(limit: int | None, default: int = 10) -> int:
    return limit or default
