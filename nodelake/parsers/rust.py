"""Rust: functions, methods, types, impls, constants, imports, modules."""

from __future__ import annotations

import re

from .base import Source, blank, doc_block, pairs

_COMMENT = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/)|/\*.*?\*/)*\*/", re.S)
_MASK = re.compile(_COMMENT.pattern + r"|b?r(#*)\".*?\"\1|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'", re.S)
_ID = r"[A-Za-z_\x80-\xff][\w\x80-\xff]*"
_VIS = r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?"
_ITEMS = (
    ("function", re.compile(rf"{_VIS}(?P<mods>(?:\b(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*)\bfn\s+(?P<name>{_ID})")),
    ("struct", re.compile(rf"{_VIS}\bstruct\s+(?P<name>{_ID})")),
    ("enum", re.compile(rf"{_VIS}\benum\s+(?P<name>{_ID})")),
    ("trait", re.compile(rf"{_VIS}(?P<mods>\bunsafe\s+)?\btrait\s+(?P<name>{_ID})")),
    ("impl", re.compile(rf"(?P<mods>\bunsafe\s+)?\bimpl\b(?P<generics>\s*<[^{{;]*?>(?=\s))?\s*(?:(?P<of>[^{{;]+?)\s+for\s+)?(?P<name>[^{{;]+?)\s*(?:\bwhere\b[^{{]*)?(?=\{{)")),
    ("constant", re.compile(rf"{_VIS}\bconst\s+(?P<name>{_ID})\s*:[^=;]*=")),
    ("static", re.compile(rf"{_VIS}\bstatic\s+(?:mut\s+)?(?P<name>{_ID})\s*:")),
    ("type_alias", re.compile(rf"{_VIS}\btype\s+(?P<name>{_ID})\s*(?:<[^=]*>)?\s*=")),
    ("import", re.compile(rf"{_VIS}\buse\s+(?P<path>(?:::)?{_ID}(?:::{_ID})*)(?:\s+as\s+(?P<alias>{_ID}))?\s*;")),
    ("module", re.compile(rf"{_VIS}\bmod\s+(?P<name>{_ID})\s*(?=[{{;])")),
)


def rust(text: str) -> list[dict]:
    src = Source(text)
    m = blank(src.s, _MASK)
    close = pairs(m)
    comments = [(c.start(), c.end()) for c in _COMMENT.finditer(src.s) if not m[c.start() : c.end()].strip()]
    attributes = [(a.start(), close[a.end() - 1] + 1) for a in re.finditer(r"#!?\[", m) if a.end() - 1 in close]
    impls: list[tuple[int, int, str]] = []
    found = []
    for kind, pattern in _ITEMS:
        for x in pattern.finditer(m):
            body = x.end() if kind == "impl" else _stop(m, x.end(), close)
            if kind in ("impl", "trait") and body in close:
                impls.append((body, close[body], src.text(x.start("name"), x.end("name")).strip()))
            found.append((kind, x, body))
    out = []
    for kind, x, body in found:
        start = x.start() + len(x[0]) - len(x[0].lstrip())
        if kind == "impl" and not re.fullmatch(_ID, x["name"].strip()):
            continue
        if kind == "import":
            if "::" not in x["path"]:
                continue
            name = x["alias"] or x["path"].split("::")[-1]
        else:
            name = x["name"].strip()
        has_body = body in close and m[body] == "{"
        if kind == "function" and not has_body:
            continue
        end = x.end() if kind == "import" else close[body] + 1 if has_body and kind not in ("constant", "static", "type_alias") else _semicolon(m, x.end(), close)
        inner = [s for s in impls if s[0] < start < s[1]]
        scope = max(inner)[2] if inner else None
        mods = (x.groupdict().get("mods") or "").split()
        signature = src.text(start, body).strip() if kind == "function" else None
        flags = {"attributes": _attributes(src, start, attributes, comments), "is_async": str("async" in mods).lower(), "is_unsafe": str("unsafe" in mods).lower(), "is_pub": str(bool(x.groupdict().get("vis"))).lower()}
        out.append(src.node(start, end, "method" if kind == "function" and scope else kind, _bytes(name), _bytes(scope), _doc(src, start, attributes, comments), signature, **flags))
    return sorted(out, key=lambda n: (n["start_byte"], -n["end_byte"]))


def _bytes(name: str | None) -> str | None:
    if name is None:
        return None
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return name


def _stop(m: str, at: int, close: dict[int, int]) -> int:
    """The brace that opens an item's body, or its semicolon."""
    while at < len(m) and m[at] not in "{;":
        at = close.get(at, at) + 1 if m[at] in "([" else at + 1
    return at


def _semicolon(m: str, at: int, close: dict[int, int]) -> int:
    while at < len(m) and m[at] != ";":
        at = close.get(at, at) + 1
    return min(at + 1, len(m))


def _above(src: Source, at: int, places: list[list[tuple[int, int]]]):
    """Comments and attributes right above an item, from the last to the first."""
    every = sorted((z, a, k) for k, own in enumerate(places) for a, z in own if z <= at)
    for z, a, k in reversed(every):
        if src.s[z:at].strip():
            return
        yield a, z, k
        at = a


def _doc(src: Source, at: int, attributes, comments) -> str | None:
    parts = []
    for a, z, kind in _above(src, at, [attributes, comments]):
        if kind == 0:
            continue
        text = src.text(a, z)
        if text.startswith(("///", "//!")) and not text.startswith("////"):
            parts.append(text[3:].strip())
        elif text.startswith(("/**", "/*!")):
            parts.append(doc_block(text))
        else:
            break
    return "\n".join(reversed(parts)) or None


def _attributes(src: Source, at: int, attributes, comments) -> str:
    return ",".join(reversed([src.text(a, z) for a, z, kind in _above(src, at, [attributes, comments]) if kind == 0]))
