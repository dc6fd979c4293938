"""JSON, YAML and TOML: containers with their paths."""

from __future__ import annotations

import re

from .base import Source

_JSON = re.compile(r'"(?:[^"\\\n]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[{}\[\],:]|[^\s]')


def json(text: str) -> list[dict]:
    """Objects and arrays. What holds an error is left out; whole containers inside it are not."""
    src, out, stack = Source(text), [], []
    # a frame: opening, position, path, number of values, key, what is expected, sound
    for m in _JSON.finditer(src.s):
        token, top = m[0], stack[-1] if stack else None
        if token in "{[":
            path = ["root"]
            if top:
                path = [*top["path"], top["key"] if top["open"] == "{" and top["key"] is not None else f"[{top['n']}]"]
                top["ok"] &= top["want"] in ("value", "value or end")
                top["n"], top["want"] = top["n"] + 1, "comma"
            stack.append({"open": token, "at": m.start(), "path": path, "n": 0, "key": None, "want": "key or end" if token == "{" else "value or end", "ok": True})
        elif token in "}]":
            if not top or (top["open"] == "{") != (token == "}"):
                for f in stack:
                    f["ok"] = False
                continue
            f = stack.pop()
            if f["ok"] and f["want"] in ("comma", "key or end", "value or end"):
                kind, extra = ("object", {}) if f["open"] == "{" else ("array", {"length": str(f["n"])})
                path = f["path"]
                out.append(src.node(f["at"], m.end(), kind, path[-1], path[-2] if len(path) > 1 else None, path=".".join(path), **extra))
            elif stack:
                stack[-1]["ok"] = False
        elif top is None:
            continue
        elif token == ",":
            top["ok"] &= top["want"] == "comma"
            top["want"] = "key" if top["open"] == "{" else "value"
        elif token == ":":
            top["ok"] &= top["want"] == "colon"
            top["want"] = "value"
        elif token[0] == '"' and len(token) > 1 and top["want"] in ("key", "key or end"):
            top["key"], top["want"] = src.text(m.start() + 1, m.end() - 1), "colon"
        else:
            literal = token[0] == '"' and len(token) > 1 or re.fullmatch(r"-?\d.*|true|false|null", token, re.S)
            top["ok"] &= bool(literal) and top["want"] in ("value", "value or end")
            top["n"], top["want"] = top["n"] + 1, "comma"
    return sorted(out, key=lambda n: n["start_byte"])


def yaml(text: str) -> list[dict]:
    """Block mappings and sequences; each sequence level enters the path twice, for the item and for the sequence."""
    try:
        import yaml as library
    except ImportError:
        return []
    src, out, seen = Source(text), [], set()
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))

    def descend(node, path: list[str]) -> None:
        if id(node) in seen or not isinstance(node, library.CollectionNode) or node.flow_style:
            return
        seen.add(id(node))
        start = at[node.start_mark.index]
        end = src.trimmed(start, at[node.end_mark.index])
        name, scope = path[-1], path[-2] if len(path) > 1 else None
        if isinstance(node, library.MappingNode):
            out.append(src.node(start, end, "mapping", name, scope, path=".".join(path)))
            for key, value in node.value:
                descend(value, [*path, src.text(at[key.start_mark.index], at[key.end_mark.index])])
        else:
            out.append(src.node(start, end, "sequence", name, scope, path=".".join(path), length=str(len(node.value))))
            for i, value in enumerate(node.value):
                descend(value, [*path, f"[{i}]", f"[{i}]"])

    try:
        for document in library.compose_all(text, Loader=library.SafeLoader):
            descend(document, ["root"])
    except library.YAMLError:
        return [] if not out else out
    return out


_TOML_STRINGS = r'"""(?:[^\\]|\\.)*?"""|\'\'\'.*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\''
_TOML_MASK = re.compile(_TOML_STRINGS + r"|#[^\n]*", re.S)
_TOML_KEY = r"""(?:[\w\-\x80-\xff]+|"[^"\n]*"|'[^'\n]*')(?:\s*\.\s*(?:[\w\-\x80-\xff]+|"[^"\n]*"|'[^'\n]*'))*"""
_TOML_HEADER = re.compile(rf"[ \t]*(\[\[?)[ \t]*({_TOML_KEY})[ \t]*(\]\]?)[ \t]*(?:#[^\n]*)?$", re.M)
_TOML_PAIR = re.compile(rf"[ \t]*({_TOML_KEY})[ \t]*=[ \t]*(?=[^\s#])", re.M)


def _toml_value_end(masked: str, at: int) -> int:
    """End of a value: of its line, or of the line where its brackets are closed."""
    depth = 0
    while at < len(masked):
        c = masked[at]
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "\n" and depth <= 0:
            break
        at += 1
    return at


def toml(text: str) -> list[dict]:
    """Tables, elements of arrays of tables, and pairs before the first table."""
    src = Source(text)
    keep = re.compile(r"[^\n]")
    masked = _TOML_MASK.sub(lambda m: keep.sub(" " if m[0][0] == "#" else "x", m[0]).replace("\n", "x" if m[0][0] != "#" else "\n"), src.s)
    out, at, table = [], 0, None
    found: list[dict] = []

    def named(name: str) -> tuple[str, str | None]:
        parts = name.split(".")
        return parts[-1].strip().strip("\"'"), ".".join(parts[:-1]).strip() or None

    def close() -> None:
        if table:
            name, scope = named(table["name"])
            kind = "table_array" if table["array"] else "table"
            out.append(src.node(table["start"], src.trimmed(table["start"], table["end"]), kind, name or "unknown", scope, path=table["name"], pair_count=str(table["pairs"])))

    while at < len(src.s):
        end = masked.find("\n", at)
        end = len(masked) if end < 0 else end
        if (m := _TOML_HEADER.match(src.s, at)) and len(m[1]) == len(m[3]):
            close()
            table = {"start": m.start(1), "end": m.end(3), "name": src.text(m.start(2), m.end(2)), "array": m[1] == "[[", "pairs": 0}
        elif m := _TOML_PAIR.match(src.s, at):
            end = _toml_value_end(masked, m.end())
            value_end = src.trimmed(m.start(1), m.end() + len(masked[m.end() : end].rstrip()))
            if table:
                table["pairs"] += 1
                table["end"] = value_end
            else:
                path = src.text(m.start(1), m.end(1))
                name, scope = named(path)
                found.append(src.node(m.start(1), value_end, "pair", name or "unknown", scope, path=path))
        at = end + 1
    close()
    return sorted(found + out, key=lambda n: n["start_byte"])
