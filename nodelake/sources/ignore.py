"""Ignore patterns as regular expressions that Python and Java read alike."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that hold for every repository.
DEFAULTS = (
    ".git/", ".git", "__pycache__/", "*.pyc", ".DS_Store", "Thumbs.db", "node_modules/", ".venv/", "venv/", ".env/", "env/", "*.egg-info/", "dist/", "build/", ".tox/",
    ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "uv.lock",
)


def _glob(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[i + 2 :]:
            end = part.index("]", i + 2)
            body = part[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[^" + body[1:] + "]" if body[0] in "!^" else f"[{body}]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_pattern(line: str) -> tuple[bool, str] | None:
    """Whether a line of an ignore file ignores (or, with ``!``, includes again), and the regex of the paths it means."""
    line = line.rstrip("\n\r")
    line = line.rstrip(" ") if not line.endswith("\\ ") else line
    if not line or line.startswith("#"):
        return None
    ignore = not line.startswith("!")
    line = line if ignore else line[1:]
    directory = line.endswith("/")
    parts = line.strip("/").split("/")
    if not any(parts):
        return None
    anchored = line.startswith("/") or len(parts) > 1
    out = "" if anchored else "(?:.+/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "(?:.+/)?" if not last else ".+"
        else:
            out += _glob(part) + ("" if last else "/")
    return ignore, f"^{out}{'/.*' if directory else '(?:/.*)?'}$"


class Matcher:
    """Ordered patterns; the last that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(compile_pattern, lines) if r]
        self._compiled = [(ignore, re.compile(regex)) for ignore, regex in self.rules]

    def ignores(self, path: str) -> bool:
        return next((ignore for ignore, regex in reversed(self._compiled) if regex.match(path)), False)

    def column(self, path: Column) -> Column:
        """The same decision as an expression."""
        if not self.rules:
            return F.lit(False)
        ordered = list(reversed(self.rules))
        first = F.when(path.rlike(ordered[0][1]), ordered[0][0])
        return reduce(lambda c, r: c.when(path.rlike(r[1]), r[0]), ordered[1:], first).otherwise(False)
