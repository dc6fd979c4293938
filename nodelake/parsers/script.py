"""JavaScript and TypeScript.

Comments, strings, templates and regular expressions are blanked first, keeping positions; declarations are then found in
what is left, with brackets matched once.
"""

from __future__ import annotations

import re

from .base import Source, blank, doc_block, is_constant, pairs

_MASK = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
    r"|(?:(?<=\breturn )|(?<=\btypeof )|(?<=\bcase )|(?<![\w)\]\x80-\xff.])(?<![\w)\]] ))/(?![*/\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[dgimsuvy]*",
    re.S,
)
_ID = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_FUNCTION = re.compile(rf"\b(async\s+)?function\s*(\*)?\s*({_ID})\s*(?:<[^(]*>)?\s*(?=\()")
_CLASS = re.compile(rf"\b(abstract\s+)?class\s+({_ID})[^{{;]*(?=\{{)")
_LEXICAL = re.compile(rf"\b(const|let)\s+({_ID})\s*(?::[^=;\n]+(?:=>[^=;\n]+)?)?=(?![=>])\s*")
_METHOD = re.compile(rf"(?P<mods>(?:\b(?:public|private|protected|static|async|abstract|readonly|override|get|set|declare)\s+)*)(?P<star>\*\s*)?(?P<name>#?{_ID})\??\s*(?:<[^(){{}}]*>)?\s*(?=\()")
_IMPORT = re.compile(r"\bimport\b(?!\s*[(.])")
_EXPORT = re.compile(r"\bexport\b")
_ARROW = re.compile(rf"(async\b\s*)?(?:<[^=]*>\s*)?(?:(\()|({_ID})\s*=>)")
_KEYWORDS = frozenset("if for while switch catch function return new typeof await super with do else".split())
_TYPED = (
    ("interface", re.compile(rf"\binterface\s+({_ID})[^{{;]*(?=\{{)")),
    ("enum", re.compile(rf"\b(?:const\s+)?enum\s+({_ID})\s*(?=\{{)")),
)
_ALIAS = re.compile(rf"\btype\s+({_ID})\s*(?:<[^=]*>)?\s*=\s*")


class _Script:
    def __init__(self, text: str, typed: bool):
        self.src, self.typed = Source(text), typed
        self.comments = [(m.start(), m.end()) for m in _MASK.finditer(self.src.s) if m[0].startswith(("/*", "//"))]
        self.m = blank(self.src.s, _MASK)
        self.close = pairs(self.m)
        self.scopes: list[tuple[int, int, str]] = []  # body start, body end, class name
        self.out: list[dict] = []

    def before(self, at: int) -> int:
        """Position of the last visible character before a place, or -1."""
        at -= 1
        while at >= 0 and self.m[at] in " \t\r\n":
            at -= 1
        return at

    def opens_statement(self, at: int) -> bool:
        p = self.before(at)
        if p < 0 or self.m[p] in ";{}":
            return True
        word = re.search(r"[\w$]+$", self.m[max(0, p - 20) : p + 1])
        if word and word[0] in ("export", "default", "declare"):
            return True
        return "\n" in self.m[p:at] and self.m[p] not in "=(,.?:+-*/%&|<>!["

    def statement_end(self, at: int) -> int:
        """End of a statement: past its semicolon, or the line's end where the next can't continue it."""
        while at < len(self.m):
            c = self.m[at]
            if c in "({[":
                at = self.close.get(at, len(self.m) - 1)
            elif c in ")}]":
                break
            elif c == ";":
                return at + 1
            elif c == "\n":
                p, after = self.before(at), self.m[at:].lstrip()
                if self.m[p] not in "=+-*/%&|<>?:,.(!" and not (after and after[0] in "=+*/%&|<>?:,.([)"):
                    break
            at += 1
        return self.src.trimmed(0, at)

    def scope(self, at: int) -> str | None:
        inner = [s for s in self.scopes if s[0] < at < s[1]]
        return max(inner)[2] if inner else None

    def start(self, at: int) -> int:
        """A declaration's start; for one that is exported, the export's (comments belong to that)."""
        p = self.before(at)
        while (word := re.search(r"[\w$]+$", self.m[max(0, p - 20) : p + 1])) and word[0] in ("export", "default", "declare"):
            at = p + 1 - len(word[0])
            p = self.before(at)
        return at

    def doc(self, at: int) -> str | None:
        for a, z in reversed(self.comments):
            if z <= at:
                if self.src.s[z:at].strip() or not self.src.s.startswith("/**", a):
                    return None
                return doc_block(self.src.text(a, z))
        return None

    def add(self, start: int, end: int, kind: str, name: str | None, signature: str | None = None, doc: bool = True, scope: str | None = None, **extra) -> None:
        flags = {"is_async": "false", "is_generator": "false", "is_arrow": "false"} | {k: str(v).lower() if isinstance(v, bool) else v for k, v in extra.items()}
        if self.typed:
            flags = {"decorators": "", "is_abstract": "false", "visibility": ""} | flags
        self.out.append(self.src.node(start, end, kind, name, scope, self.doc(start) if doc else None, signature, **flags))

    def head(self, start: int, body: int) -> str:
        return self.src.text(start, body).strip()

    def decorators(self, start: int, body_start: int) -> str:
        """All decorators before a member among its siblings."""
        found, at = [], body_start
        while at < start:
            if self.m[at] in "({[":
                at = self.close.get(at, at)
            elif self.m[at] == "@" and (m := re.compile(rf"@{_ID}(?:\.{_ID})*").match(self.m, at)):
                end = m.end()
                if self.m[end : end + 1] == "(":
                    end = self.close.get(end, end) + 1
                found.append(self.src.text(at, end))
                at = end - 1
            at += 1
        return ",".join(found)

    def run(self) -> list[dict]:
        m = self.m
        bodies = []
        for c in _CLASS.finditer(m):
            if c.end() in self.close and self.opens_statement(c.start()):
                bodies.append((c.end(), self.close[c.end()], c[2], c.start(), bool(c[1]), "class"))
        if self.typed:
            for kind, pattern in _TYPED:
                for c in pattern.finditer(m):
                    if c.end() in self.close and self.opens_statement(c.start()):
                        bodies.append((c.end(), self.close[c.end()], c[1], c.start(), False, kind))
        self.scopes = [b[:3] for b in bodies if b[5] != "enum"]
        for body, end, name, start, abstract, kind in bodies:
            extra = {"is_abstract": abstract, "decorators": self._before(start)} if self.typed else {}
            self.add(start, end + 1, kind, name, doc=not self._exported(start), scope=self.scope(start) if kind != "enum" else None, **extra)
            if kind != "enum":
                self.members(body, end, name, kind == "class")
        for f in _FUNCTION.finditer(m):
            after = self.close.get(f.end())
            body = m.find("{", after) if after else -1
            if after is None or not self.opens_statement(f.start()) or body not in self.close or ";" in m[after:body]:
                continue
            self.add(f.start(), self.close[body] + 1, "function", f[3], self.head(f.start(), body), doc=not self._exported(f.start()), scope=self.scope(f.start()), is_async=bool(f[1]), is_generator=bool(f[2]))
        self.lexical()
        if self.typed:
            for t in _ALIAS.finditer(m):
                if self.opens_statement(t.start()):
                    end = self.statement_end(t.end())
                    self.add(t.start(), end, "type_alias", t[1], doc=not self._exported(t.start()), scope=self.scope(t.start()))
        for i in _IMPORT.finditer(m):
            end = self.statement_end(i.end())
            if self.opens_statement(i.start()) and (s := re.findall(r"[\"']([^\"'\n]*)[\"']", self.src.text(i.start(), end))):
                self.add(i.start(), end, "import", s[-1], doc=False)
        self.exports()
        return sorted(self.out, key=lambda n: (n["start_byte"], -n["end_byte"]))

    def _exported(self, at: int) -> bool:
        return self.start(at) != at

    def _before(self, at: int) -> str:
        lead = re.search(rf"((?:@{_ID}(?:\([^()]*\))?\s*)+)$", self.m[: self.start(at)])
        return ",".join(x.strip() for x in re.findall(r"@[^@]+", self.src.text(lead.start(), lead.end()))) if lead else ""

    def members(self, body: int, end: int, name: str, is_class: bool) -> None:
        at = body + 1
        while at < end:
            c = self.m[at]
            if c in "({[":
                at = self.close.get(at, end)
            elif (f := _METHOD.match(self.m, at)) and f["name"] not in _KEYWORDS and (at == 0 or not re.match(r"[\w$.#@]", self.m[at - 1])) and self._member_start(f.start(), body):
                after = self.close.get(f.end())
                if after is None:
                    return
                rest = re.compile(r"\s*(?::\s*(?:\{[^{}]*\})?[^{};\n]*)?\s*").match(self.m, after + 1)
                stop = rest.end()
                has_body = self.m[stop : stop + 1] == "{" and stop in self.close
                if (has_body or self.typed) and not f["name"].startswith("#"):
                    last = self.close[stop] + 1 if has_body else self.src.trimmed(f.start(), stop)
                    mods = f["mods"].split()
                    extra = {"is_async": "async" in mods, "is_generator": bool(f["star"])}
                    if self.typed:
                        extra |= {"decorators": self.decorators(f.start(), body + 1), "visibility": next((x for x in mods if x in ("public", "private", "protected")), ""), "is_abstract": "abstract" in mods}
                    signature = self.head(f.start(), stop) if has_body else self.src.text(f.start(), last)
                    self.add(f.start(), last, "method", f["name"], signature, scope=name, **extra)
                at = self.close[stop] if has_body else stop
                continue
            at += 1

    def _member_start(self, at: int, body: int) -> bool:
        p = self.before(at)
        if re.search(rf"@{_ID}(?:\.{_ID})*\s*$", self.m[max(body, at - 256) : at]):
            return True  # after a decorator
        return p == body or self.m[p] in ";}," or "\n" in self.m[p:at] and self.m[p] not in "=(.?:+-*/%&|<>!" or self.m[p] == ")"

    def lexical(self) -> None:
        for d in _LEXICAL.finditer(self.m):
            if not self.opens_statement(d.start()) or self._exported(d.start()):
                continue
            end = self.statement_end(d.end())
            arrow, a = None, _ARROW.match(self.m, d.end())
            if a:
                close = self.close.get(a.start(2), -1) if a[2] else a.start(3)
                arrow = re.compile(r"\)\s*(?::[^=;{]+)?=>").match(self.m, close) if a[2] else a
            scope = self.scope(d.start())
            if arrow:
                params = a.start(2) if a[2] else a.start(3)
                self.add(d.start(), end, "function", d[2], self.src.text(params, arrow.end()), scope=scope, is_async=bool(a[1]), is_arrow=True)
            if d[1] == "const" and is_constant(d[2]):
                self.add(d.start(), end, "constant", d[2], scope=scope)

    def exports(self) -> None:
        for e in _EXPORT.finditer(self.m):
            if not self.opens_statement(e.start()):
                continue
            rest = self.m[e.end() :]
            declared = re.match(rf"\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\s*\*?|class|interface|type|enum|const\s+enum|namespace)\b\s*({_ID})?", rest)
            variable = re.match(rf"\s+(?:const|let|var)\s+(?!enum\b)({_ID})", rest)
            clause = re.match(r"\s*(?:type\s*)?\{([^}]*)\}", rest)
            value = re.match(rf"\s+default\s+({_ID})\s*(?:;|\n|$)", rest)
            if declared:
                body = self.m.find("{", e.end())
                kind = declared[1].split()[0].rstrip("*")
                end = self.statement_end(e.end()) if kind == "type" or body not in self.close else self.close[body] + 1
                if kind == "function" and (p := self.m.find("(", e.end())) in self.close:
                    body = self.m.find("{", self.close[p])
                    end = self.close.get(body, end - 1) + 1
                name = declared[2] if declared[2] and declared[2] not in ("extends", "implements") and not (kind == "enum" or declared[1].startswith("const")) else "default"
            elif variable:
                name, end = variable[1], self.statement_end(e.end())
            elif clause:
                names = [x.split()[0] if x.split()[0] != "type" else x.split()[1] for x in clause[1].split(",") if x.strip()]
                if not names:
                    raise ValueError("an export clause without names")
                name, end = ", ".join(names), self.statement_end(e.end())
            else:
                name, end = value[1] if value else "default", self.statement_end(e.end())
            self.add(e.start(), end, "export", name)


def javascript(text: str) -> list[dict]:
    return _Script(text, False).run()


def typescript(text: str) -> list[dict]:
    return _Script(text, True).run()
