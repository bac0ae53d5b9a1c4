"""What the language parsers share: masked source, matched brackets, symbols.

There is no grammar engine.  Comments and strings are blanked out of the source
(offsets stay), brackets are matched once, and each parser looks for
declarations in the text of one block, in which nested blocks are blanked too.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

SNIPPET_BYTES = 500


@dataclass
class Symbol:
    name: str
    kind: str
    signature: str = ""
    doc_comment: str = ""
    start_line: int = 1
    end_line: int = 1
    receiver: str = ""
    package: str = ""
    snippet: str = ""

    def key(self, path: str) -> str:
        name = f"{self.receiver}.{self.name}" if self.receiver else self.name
        return f"{path}:{name}:{self.kind}"


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    #: (caller, callee, line)
    calls: list[tuple[str, str, int]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Style:
    """How a language writes comments and strings."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    raw: tuple[str, ...] = ()  # delimiters of strings without escapes, which may span lines
    lifetimes: bool = False  # a quote may begin a lifetime


C_STYLE = Style()


def truncated(text: str, size: int) -> str:
    """The longest start of a text that has at most ``size`` bytes in UTF-8."""
    data = text.encode()
    return text if len(data) <= size else data[:size].decode("utf-8", "ignore")


class Code:
    def __init__(self, source: str, style: Style = C_STYLE) -> None:
        self.source = source
        self.comments: list[tuple[int, int]] = []
        self.masked = self._mask(style)
        self._lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.mate = self._brackets()

    def _mask(self, style: Style) -> str:
        marks = [*style.line, *(a for a, _ in style.block), *style.raw, *style.quotes]
        token = re.compile("|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))
        out, at, src = [], 0, self.source
        ends = dict(style.block)

        def blank(a: int, b: int, keep: int = 0) -> str:
            inner = re.sub(r"[^\n]", " ", src[a + keep : b - keep]) if b - a > 2 * keep else ""
            return src[a : a + keep] + inner + src[max(b - keep, a + keep) : b]

        while m := token.search(src, at):
            out.append(src[at : m.start()])
            mark, start = m[0], m.start()
            if mark in style.line:
                stop = src.find("\n", start)
                stop = len(src) if stop < 0 else stop
                self.comments.append((start, stop))
                out.append(blank(start, stop))
            elif mark in ends:
                stop = src.find(ends[mark], start + len(mark))
                stop = len(src) if stop < 0 else stop + len(ends[mark])
                self.comments.append((start, stop))
                out.append(blank(start, stop))
            elif mark in style.raw:
                stop = src.find(mark, start + len(mark))
                stop = len(src) if stop < 0 else stop + len(mark)
                out.append(blank(start, stop, len(mark)))
            elif mark == "'" and style.lifetimes and not re.match(r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'", src[start : start + 12]):
                stop = start + 1
                out.append(mark)
            else:
                m2 = re.compile(rf"{mark}(?:[^{mark}\\\n]|\\.)*(?:{mark}|(?=\n)|\Z)", re.S).match(src, start)
                stop = m2.end() if m2 else start + 1
                out.append(blank(start, stop, 1))
            at = stop
        out.append(src[at:])
        return "".join(out)

    def _brackets(self) -> dict[int, int]:
        mate: dict[int, int] = {}
        stack: list[int] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[(){}\[\]]", self.masked):
            if m[0] in "([{":
                stack.append(m.start())
            else:
                while stack and self.masked[stack[-1]] != pairs[m[0]]:
                    if m[0] != "}":
                        break
                    stack.pop()
                if stack and self.masked[stack[-1]] == pairs[m[0]]:
                    mate[stack.pop()] = m.start()
        return mate

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._lines, at)

    def close(self, at: int) -> int:
        """Where the bracket at ``at`` closes; the end of the source if it does not."""
        return self.mate.get(at, len(self.source) - 1)

    def shallow(self, start: int, end: int) -> str:
        """``masked[start:end]`` with what stands inside braces blanked."""
        out, at = [], start
        for m in re.finditer(r"\{", self.masked[start:end]):
            here = start + m.start()
            if here < at:
                continue
            stop = min(self.close(here), end)
            out += [self.masked[at : here + 1], re.sub(r"[^\n]", " ", self.masked[here + 1 : stop])]
            at = stop
        out.append(self.masked[at:end])
        return "".join(out)

    def doc(self, at: int) -> str:
        """The comments that stand right before a declaration, without their marks."""
        found: list[str] = []
        begin = at
        for a, b in reversed([c for c in self.comments if c[1] <= at]):
            if self.source[b:begin].strip():
                break
            found.insert(0, _plain(self.source[a:b]))
            begin = a
            first = self._lines[self.line(a) - 1]
            if self.source[first:a].strip():  # a comment at the end of a line belongs to that line
                found.pop(0)
                break
        return "\n".join(f for f in found if f)

    def symbol(self, name: str, kind: str, start: int, end: int, **more: str) -> Symbol:
        text = self.source[start:end]
        return Symbol(
            name, kind, first_line(text), self.doc(start), self.line(start), self.line(max(start, end - 1)), snippet=truncated(text, SNIPPET_BYTES), **more
        )

    def calls(self, start: int, end: int, *, keywords: frozenset[str], pattern: re.Pattern | None = None) -> Iterator[tuple[str, int]]:
        """(callee, line) of calls in a range, in order."""
        for m in (pattern or CALL).finditer(self.masked, start, end):
            if m[1] not in keywords:
                yield m[1], self.line(m.start(1))


CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")


def _plain(comment: str) -> str:
    if comment.startswith("/*"):
        body = comment[2:].removesuffix("*/")
        return "\n".join(re.sub(r"^\s*\*? ?", "", x).rstrip() for x in body.strip("*! \n").split("\n")).strip()
    return re.sub(r"^(?://[/!]?|#+|--) ?", "", comment).rstrip()


def first_line(text: str) -> str:
    """The first line, cut before an opening brace, trimmed."""
    return text.split("\n", 1)[0].split("{", 1)[0].strip()


def names(found: str) -> list[str]:
    return [n for n in re.findall(r"[A-Za-z_]\w*", found) if n != "_"]
