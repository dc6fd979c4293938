"""Markdown, HTML and CSS."""

from __future__ import annotations

import re

from ..functions.scalars import STOPWORDS
from .base import Source, blank, pairs

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")


def markdown(text: str) -> list[dict]:
    """Sections by their ATX headings; a section ends before the next heading of its level or a higher one."""
    src = Source(text)
    found, fence, at = [], None, 0
    for line in src.s.split("\n"):
        f = _FENCE.match(line)
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line.strip(" `~"):
                fence = None
        elif f:
            fence = f[1]
        elif (m := _HEADING.match(line)) and m[2] and m[2].strip("# \t"):
            found.append((at + m.start(1), len(m[1]), src.text(at + m.start(2), at + m.end(2)).strip()))
        at += len(line) + 1
    ends, scopes, above = [len(src.s)] * len(found), [], []
    for i, (start, level, title) in enumerate(found):
        while above and found[above[-1]][1] >= level:
            ends[above.pop()] = start
        scopes.append(found[above[-1]][2] if above else None)
        above.append(i)
    return [src.node(start, end, f"Header {level}", title, scope) for (start, level, title), end, scope in zip(found, ends, scopes)]


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SCOPES = frozenset("article section div main aside nav header footer h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = {"script", "style"}
#: Elements that a new one of the same group closes, up to one of the containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "article", "section", "td", "body"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class _Element:
    """``tag`` is in lower case, for what closes what; ``name`` is as written, and what counts, since names are told by case."""

    def __init__(self, name: str, start: int, attributes: str, parent: _Element | None):
        self.name, self.tag, self.start, self.attributes, self.parent = name, name.lower(), start, attributes, parent
        self.children: list[_Element] = []
        self.texts: list[tuple[int, str]] = []
        self.end = start

    def below(self):
        """All elements inside, in document order."""
        stack = self.children[::-1]
        while stack:
            yield (e := stack.pop())
            stack += e.children[::-1]


def _tree(src: Source) -> _Element:
    root = top = _Element("", 0, "", None)
    at, raw = 0, None
    for m in _TAG.finditer(src.s):
        if raw:
            if not (m[1] and m[2].lower() == raw):
                continue
        elif m.start() > at:
            top.texts.append((at, src.text(at, m.start())))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            raw = None
            e = top
            while e.parent and e.tag != tag:
                e = e.parent
            if e.parent:
                while top is not e:
                    top.end, top = m.start(), top.parent
                e.end, top = m.end(), e.parent
            continue
        if tag in _CLOSES:
            group, walls = _CLOSES[tag]
            e = top
            while e.parent and e.tag not in group and e.tag not in walls:
                e = e.parent
            if e.tag in group:
                while top is not e.parent:
                    top.end, top = m.start(), top.parent
        e = _Element(m[2], m.start(), m[3] or "", top)
        e.end = m.end()
        top.children.append(e)
        if tag not in _VOID and not (m[3] or "").rstrip().endswith("/"):
            top = e
            raw = tag if tag in _RAW else None
    if not raw and at < len(src.s):
        top.texts.append((at, src.text(at, len(src.s))))
    while top.parent:
        top.end, top = len(src.s), top.parent
    return root


_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _text(e: _Element) -> str:
    found = list(e.texts)
    for c in e.below():
        if c.tag not in _RAW:
            found += c.texts
    parts = (p.strip() for _, t in sorted(found) for p in _ENTITY.split(t))
    return " ".join(p for p in parts if p)


def normalize(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower()).strip()


def html(text: str) -> list[dict]:
    """Headings, tables and lists."""
    src, out = Source(text), []
    for e in _tree(src).below():
        tag, extra = e.name, {}
        if not re.fullmatch(r"h[1-6]|table|ul|ol", tag):
            continue
        cleaned = " ".join(w for w in normalize(_text(e)).split(" ") if w and w not in STOPWORDS)
        extra["cleaned_text"] = cleaned[:100]
        name = " ".join(cleaned.split(" ")[:5]) or tag if tag[0] == "h" else "table" if tag == "table" else f"{tag}-list"
        if tag in ("ul", "ol"):
            extra["item_count"] = str(sum(c.name == "li" for c in e.below()))
        elif tag == "table":
            rows = [c for c in e.below() if c.name == "tr"]
            extra |= {"rows": str(len(rows)), "cols": str(max((sum(c.name in ("td", "th") for c in r.below()) for r in rows), default=0))}
        for key in ("id", "class"):
            if (m := re.search(rf"(?:^|\s){key}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", e.attributes)) and (value := m[1] or m[2]):
                extra[key] = value.encode("latin-1").decode("utf-8", "replace")
        above = e.parent
        while above and above.name not in _SCOPES:
            above = above.parent
        out.append(src.node(e.start, e.end, tag, name, above.name if above else None, **extra))
    return sorted(out, key=lambda n: n["start_byte"])


_CSS_MASK = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


def css(text: str) -> list[dict]:
    """Rule sets and at-rules, nested ones too."""
    src, out = Source(text), []
    masked = blank(src.s, _CSS_MASK)
    ends = pairs(masked, "{}")

    def name_of(head: str) -> str:
        keyword = re.match(r"@[\w-]+", head)[0]
        return " ".join(head.split()) if keyword == "@keyframes" else keyword

    def statements(at: int, end: int, scope: str | None, frames: bool) -> int:
        """Emit what is between two places; return the number of declarations directly there."""
        declared, start = 0, at
        while at < end:
            c = masked[at]
            if c == ";" or c == "}":
                piece = masked[start:at].strip()
                begin = start + len(masked[start:at]) - len(masked[start:at].lstrip())
                if piece.startswith("@"):
                    extra = {}
                    if value := re.match(r"@(?:import)\s+([^\s;]+(?:\s*\([^)]*\))?)", src.s[begin:at]):
                        extra["value"] = value[1].encode("latin-1").decode("utf-8", "replace")
                    out.append(src.node(begin, at + 1, "at-rule", name_of(piece), scope, **extra))
                elif ":" in piece:
                    declared += 1
                start = at + 1
            elif c == "{":
                close = ends.get(at)
                if close is None:
                    return declared
                begin = start + len(masked[start:at]) - len(masked[start:at].lstrip())
                head = src.text(begin, at).strip()
                if head.startswith("@"):
                    name, place, extra = name_of(head), len(out), {}
                    if name in ("@media", "@supports") and (v := re.match(r"@[\w-]+\s+(\([^)]*\)|[^\s,({]+)", head)):
                        extra["value"] = v[1]
                    statements(at + 1, close, name, name == "@keyframes" or head.startswith("@keyframes"))
                    out.insert(place, src.node(begin, close + 1, "at-rule", name, scope, **extra))
                elif frames or not head:
                    pass
                else:
                    place = len(out)
                    n = statements(at + 1, close, head, False)
                    out.insert(place, src.node(begin, close + 1, "rule", head, scope, declaration_count=str(n)))
                at, start = close, close + 1
            at += 1
        if ":" in masked[start:end].strip() and not masked[start:end].strip().startswith("@"):
            declared += 1
        return declared

    statements(0, len(masked), None, False)
    return out
