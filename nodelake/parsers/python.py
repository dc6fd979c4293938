"""Python: functions, methods, classes, constants, imports."""

from __future__ import annotations

import ast
import re

from .base import Source, is_constant

_QUOTES = ('"""', "'''", '"', "'")


def strip_docstring(raw: str) -> str:
    for q in _QUOTES:
        if raw.startswith(q) and raw.endswith(q) and len(raw) >= 2 * len(q):
            return raw[len(q) : -len(q)].strip()
    return raw.strip()


def python(text: str) -> list[dict]:
    """By the syntax tree; if the text has an error, by the longest part before it that has none, then by its lines."""
    lines = text.split("\n")
    upto = len(lines)
    while upto:
        try:
            tree = ast.parse("\n".join(lines[:upto]))
            break
        except (SyntaxError, ValueError, RecursionError) as e:
            upto = min(upto - 1, (getattr(e, "lineno", None) or upto) - 1)
    else:
        tree = ast.parse("")
    out = _nodes(Source(text), tree)
    return out if upto == len(lines) else out + _rest(Source(text), lines, upto)


def _nodes(src: Source, tree: ast.Module) -> list[dict]:
    begins = [0, *(i + 1 for i, b in enumerate(src.raw) if b == 10)]
    out: list[dict] = []

    def place(line: int, column: int) -> int:
        return begins[line - 1] + column

    def definition(node, scope: str | None) -> None:
        start, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
        first = node.body[0]
        is_doc = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        doc = strip_docstring(src.text(place(first.lineno, first.col_offset), place(first.end_lineno, first.end_col_offset))) if is_doc else None
        body = min([place(first.lineno, first.col_offset), *(place(d.lineno, d.col_offset) - 1 for d in getattr(first, "decorator_list", []))])
        head = re.sub(r"(?m)\s*#[^\n]*$", "", src.text(start, body)).strip()
        signature = None if isinstance(node, ast.ClassDef) else head.rstrip(":").rstrip()
        extra = {"decorators": ",".join("@" + src.text(place(d.lineno, d.col_offset), place(d.end_lineno, d.end_col_offset)) for d in node.decorator_list)}
        whole = min([start, *(src.s.rindex("@", 0, place(d.lineno, d.col_offset) + 1) for d in node.decorator_list)])
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope else "function"
        extra["is_async"] = str(isinstance(node, ast.AsyncFunctionDef)).lower()
        out.append(src.node(whole, end, kind, node.name, scope, doc, signature, **extra))

    def visit(node, scope: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                definition(child, scope)
                visit(child, child.name if isinstance(child, ast.ClassDef) else scope)
                continue
            if isinstance(child, ast.Import) and any(not a.asname for a in child.names):
                names = [a.name for a in child.names if not a.asname]
                for name in names:
                    out.append(src.node(place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), "import", name, scope, None, None))
            elif isinstance(child, ast.ImportFrom) and child.module and not child.level:
                out.append(src.node(place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), "import", child.module, scope, None, None))
            elif isinstance(node, ast.Module) and isinstance(child, (ast.Assign, ast.AnnAssign)) and child.value is not None:
                target = child.targets[0] if isinstance(child, ast.Assign) else child.target
                if isinstance(target, ast.Name) and is_constant(target.id):
                    out.append(src.node(place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), "constant", target.id))
            visit(child, scope)

    visit(tree, None)
    return sorted(out, key=lambda n: n["start_byte"])


_HEAD = re.compile(r"^([ \t]*)((?:async[ \t]+)?def|class)[ \t]+(\w+)(.*)$")


def _rest(src: Source, lines: list[str], first: int) -> list[dict]:
    """Definitions in lines that don't parse, by their indentation."""
    out, scopes, at = [], [], sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines[:first])
    for i in range(first, len(lines)):
        line = lines[i]
        if m := _HEAD.match(line):
            indent = len(m[1])
            while scopes and scopes[-1][0] >= indent:
                scopes.pop()
            last = i + 1
            while last < len(lines) and (not lines[last].strip() or len(lines[last]) - len(lines[last].lstrip()) > indent):
                last += 1
            size = sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines[i:last]) - 1
            start = at + indent
            scope = scopes[-1][1] if scopes else None
            kind = "class" if m[2] == "class" else "method" if scope else "function"
            out.append(src.node(start, src.trimmed(start, min(at + size, len(src.s))), kind, m[3], scope, None, None if kind == "class" else line.strip().rstrip(":"), decorators="", is_async=str(m[2].startswith("async")).lower()))
            if kind == "class":
                scopes.append((indent, m[3]))
        at += len(line.encode("utf-8", "surrogatepass")) + 1
    return out
