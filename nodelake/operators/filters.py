"""Predicates on documents (which files are read) and on stored nodes (what a search looks at)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as X

#: Suffixes of files that are not text.
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".webm", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin", ".woff", ".woff2", ".ttf",
    ".eot", ".otf", ".sqlite", ".db", ".pickle", ".pkl",
)
MAX_FILE_SIZE = 10 * 1024 * 1024


def is_binary(path: Column) -> Column:
    return X.suffix(path).isin(*BINARY)


def is_minified(path: Column) -> Column:
    name = F.lower(X.base_name(path))
    return name.contains(".min.") | name.endswith(".min")


def readable(path: Column, size_bytes: Column, max_size: int = MAX_FILE_SIZE) -> Column:
    """Files that are read: not binary, not minified, not empty, not too large."""
    return ~is_binary(path) & ~is_minified(path) & (size_bytes > 0) & (size_bytes <= max_size)


def node_filter(
    file_path: str | None = None, language: str | None = None, node_type: str | None = None, node_name: str | None = None,
    has_documentation: bool | None = None, path_match: str = "prefix",
) -> Column | None:
    """The conjunction of the conditions that are given; none: no filter. A path that ends in ``/`` is a directory, matched
    as a prefix (or, with ``path_match="substring"``, anywhere). Empty strings count as not given."""
    found: list[Column] = []
    path = F.col("document_path")
    if file_path:
        directory = path.contains(file_path) if path_match == "substring" else path.startswith(file_path)
        found.append(directory if file_path.endswith("/") else path == file_path)
    found += [F.col(c) == v for c, v in (("language", language), ("node_type", node_type), ("node_name", node_name)) if v]
    if has_documentation is not None:
        found.append(F.col("documentation") != "" if has_documentation else F.col("documentation") == "")
    return reduce(Column.__and__, found) if found else None
