"""Go: functions, methods, types, constants, variables, calls and imports."""

from __future__ import annotations

import re

from fathomer.sources.languages.code import Code, Parsed, Style

_STYLE = Style(raw=("`",))
# Words before a parenthesis that call nothing.
_KEYWORDS = frozenset("func if for switch select return go defer case range var const type import package else map chan struct interface".split())
_FUNC = re.compile(r"(?m)^func\s+(?:\(([^)]*)\)\s*)?([A-Za-z_]\w*)")
_DECL = re.compile(r"(?m)^(type|const|var|import)\b[ \t]*(\()?")
_TYPE = re.compile(r"[ \t]*([A-Za-z_]\w*)(?:\[[^\]\n]+\])?\s*=?\s*(struct\b|interface\b)?")


def parse(source: str) -> Parsed:
    code, out = Code(source, _STYLE), Parsed()
    package = m[1] if (m := re.search(r"(?m)^package\s+(\w+)", code.masked)) else ""
    top = code.shallow(0, len(source))
    for m in _FUNC.finditer(top):
        receiver = re.sub(r"\[.*", "", m[1].split()[-1].lstrip("*")) if m[1] and m[1].split() else ""
        params = top.find("(", m.end())
        params = code.close(params) if params >= 0 else m.end()
        brace = re.compile(r"[^\n{]*(?:interface\s*\{\s*\}|struct\s*\{\s*\})?[^\n{]*\{").match(top, params + 1)
        end = code.close(brace.end() - 1) + 1 if brace else _line_end(source, params)
        out.symbols.append(code.symbol(m[2], "method" if receiver else "function", m.start(), end, receiver=receiver, package=package))
        if brace:
            out.calls += [(m[2], name, line) for name, line in code.calls(brace.end(), end, keywords=_KEYWORDS)]
    for m in _DECL.finditer(top):
        specs = _grouped(code, m) if m[2] else [(m.start(), m.end())]
        for start, at in specs:
            _spec(code, m[1], start, at, package, out)
    out.symbols.sort(key=lambda s: s.start_line)
    return out


def _line_end(source: str, at: int) -> int:
    stop = source.find("\n", at)
    return len(source) if stop < 0 else stop


def _grouped(code: Code, m: re.Match) -> list[tuple[int, int]]:
    """The specs of a group in parentheses: lines that begin at its own depth."""
    open_ = m.end() - 1
    close, at, found = code.close(open_), open_ + 1, []
    while at < close:
        stop = at
        while stop < close and code.masked[stop] != "\n":
            stop = min(code.close(stop), close) if code.masked[stop] in "([{" else stop + 1
        text = code.masked[at:stop]
        if text.strip():
            begin = at + len(text) - len(text.lstrip())
            found.append((begin, begin))
        at = stop + 1
    return found


def _spec(code: Code, word: str, start: int, at: int, package: str, out: Parsed) -> None:
    end = _line_end(code.source, at)
    brace = code.masked.find("{", at, end)
    if brace >= 0:
        end = code.close(brace) + 1
    if word == "import":
        if m := re.search(r"[\"`]([^\"`]+)[\"`]", code.source[at:end]):
            out.imports.append(m[1])
    elif word == "type":
        if m := _TYPE.match(code.masked, at):
            out.symbols.append(code.symbol(m[1], m[2] or "type", start, end, package=package))
    elif m := re.match(r"[ \t]*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)", code.masked[at:end]):
        for name in re.split(r"\s*,\s*", m[1]):
            if name != "_":
                out.symbols.append(code.symbol(name, word, start, end, package=package))
