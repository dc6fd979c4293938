"""What all parsers share. A parser is a pure function from source text to nodes.

Sources are scanned as Latin-1 views of their UTF-8 bytes: one character for each byte, so that positions are byte offsets.
"""

from __future__ import annotations

import bisect
import re


class Source:
    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        self.s = self.raw.decode("latin-1")
        self._breaks = [i for i, b in enumerate(self.raw) if b == 10]

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].decode("utf-8", "replace")

    def line(self, at: int) -> int:
        return bisect.bisect_left(self._breaks, at) + 1

    def node(self, start: int, end: int, node_type: str, name: str, scope: str | None = None, doc: str | None = None, signature: str | None = None, **extra: str) -> dict:
        return {
            "content": self.text(start, end), "node_type": node_type, "node_name": name, "start_byte": start, "end_byte": end, "start_line": self.line(start),
            "end_line": self.line(end), "documentation": doc, "parent_scope": scope, "signature": signature, "extra": extra,
        }

    def trimmed(self, start: int, end: int) -> int:
        """The end without white space before it."""
        while end > start and self.s[end - 1] in " \t\r\n":
            end -= 1
        return end


def blank(s: str, pattern: re.Pattern) -> str:
    """``s`` with all matches (comments, strings) replaced by spaces, line breaks kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), s)


def pairs(masked: str, kinds: str = "(){}[]") -> dict[int, int]:
    """Positions of opening brackets and of those that close them."""
    close = dict(zip(kinds[1::2], kinds[::2]))
    stack: list[int] = []
    out: dict[int, int] = {}
    for i, c in enumerate(masked):
        if c in kinds[::2]:
            stack.append(i)
        elif c in close:
            while stack and masked[stack[-1]] != close[c]:
                stack.pop()
            if stack:
                out[stack.pop()] = i
    return out


def is_constant(name: str) -> bool:
    return name.isupper()


def doc_block(comment: str) -> str:
    """Text of a ``/** ... */`` block."""
    body = re.sub(r"^/\*+!?|\*+/$", "", comment.strip())
    lines = (re.sub(r"^\*", "", x.strip()).strip() for x in body.split("\n"))
    return "\n".join(x for x in lines if x)
