"""C and C++: functions, types, macros, members, calls and includes.

Preprocessor conditions are walked into in both languages.
"""

from __future__ import annotations

import re

from fathomer.sources.languages.code import Code, Parsed

# Words before a parenthesis that declare or call nothing.
_KEYWORDS = frozenset(
    "if for while switch return sizeof alignof catch throw new delete do else case defined static_assert decltype typeof alignas noexcept operator using namespace template __attribute__ typename".split()
)
_INCLUDE = re.compile(r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]")
_MACRO = re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)\(((?:[^\n\\]|\\\n|\\.)*)")
_FUNCTION = re.compile(r"(?P<name>(?:[A-Za-z_]\w*(?:<[^<>;{}()]*>)?::)*~?[A-Za-z_]\w*|(?:[A-Za-z_]\w*::)*operator\s*[^\s\w(]{1,3}|operator\s*\(\))\s*\(")
_TYPE = re.compile(r"\b(?P<word>struct|union|class|enum(?:\s+(?:class|struct))?)\s+(?:\[\[[^\]]*\]\]\s*)?(?P<name>[A-Za-z_]\w*)?\s*(?:final\s*)?(?::[^;{]*)?\{")
_TYPEDEF = re.compile(r"\btypedef\b")


def parse_c(source: str) -> Parsed:
    return _parse(source, plus=False)


def parse_cpp(source: str) -> Parsed:
    return _parse(source, plus=True)


def _parse(source: str, *, plus: bool) -> Parsed:
    code, out = Code(source), Parsed()
    out.imports = [m[1] for m in _INCLUDE.finditer(source) if code.masked[m.start() : m.start() + 1].strip(" \t") == source[m.start() : m.start() + 1].strip(" \t")]
    for m in _MACRO.finditer(source):
        out.symbols.append(code.symbol(m[1], "function", m.start(), m.end()))
    # Directives are blanked, with the lines that they go on in.
    code.masked = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code.masked)
    code.mate = code._brackets()
    _block(code, 0, len(source), "", plus, out)
    out.symbols.sort(key=lambda s: s.start_line)
    return out


def _begin(text: str, at: int) -> int:
    cut = max(text.rfind(c, 0, at) for c in ";{}")
    piece = text[cut + 1 : at]
    if m := re.search(r"\b(?:public|private|protected)\s*:(?!:)", piece):
        cut, piece = cut + m.end(), piece[m.end() :]
    return cut + 1 + len(piece) - len(piece.lstrip())


def _block(code: Code, start: int, end: int, owner: str, plus: bool, out: Parsed) -> None:
    text = code.shallow(start, end)
    taken: list[tuple[int, int]] = []
    for m in _TYPEDEF.finditer(text):
        stop = text.find(";", m.end())
        brace = text.find("{", m.end())
        if 0 <= brace < stop or (brace >= 0 > stop):
            stop = text.find(";", code.close(start + brace) - start)
        stop = len(text) if stop < 0 else stop + 1
        piece = text[m.end() : stop - 1]
        name = re.search(r"\(\s*\*\s*(\w+)\s*\)", piece) or re.search(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*$", piece)
        if name:
            kind = "struct" if re.match(r"\s*(?:struct|union)\b", piece) and "{" in piece else "type"
            out.symbols.append(code.symbol(name[1], kind, start + m.start(), start + stop))
        taken.append((m.start(), stop))
    inside = lambda at: any(a <= at < b for a, b in taken)
    for m in _TYPE.finditer(text):
        brace = start + m.end() - 1
        stop = code.close(brace) + 1
        kind = "type" if m["word"].startswith("enum") else "struct"
        if m["name"] and not (inside(m.start()) and kind == "type"):
            begin = start + _begin(text, m.start())
            out.symbols.append(code.symbol(m["name"], kind, begin, stop))
            if plus and kind == "struct":
                _block(code, brace + 1, stop - 1, m["name"], plus, out)
    if plus:
        for m in re.finditer(r"\bnamespace\s*((?:[A-Za-z_]\w*(?:::)?)*)\s*\{", text):
            brace = start + m.end() - 1
            if m[1]:
                out.symbols.append(code.symbol(m[1].split("::")[-1], "type", start + m.start(), code.close(brace) + 1))
            _block(code, brace + 1, code.close(brace), owner, plus, out)
        for m in re.finditer(r'\bextern\s*"[^"]*"\s*\{', text):
            _block(code, start + m.end(), code.close(start + m.end() - 1), owner, plus, out)
        for m in re.finditer(r"\busing\s+(?:namespace\s+)?([\w:]+)\s*(=\s*[^;]+)?;", text):
            if m[2]:
                out.symbols.append(code.symbol(m[1], "type", start + m.start(), start + m.end()))
            else:
                out.imports.append(m[1])
    at = 0
    while m := _FUNCTION.search(text, at):
        open_ = start + m.end() - 1
        after = code.close(open_) - start + 1
        at = m.end()
        begin = _begin(text, m.start())
        head = text[begin : m.start()]
        name = m["name"].replace(" ", "")
        plain = name.split("::")[-1]
        if inside(m.start()) or plain in _KEYWORDS or plain.lstrip("~") in _KEYWORDS or "=" in head or re.search(r"\b(?:return|typedef|using|goto)\b", head):
            at = max(at, after)
            continue
        scope = name.rsplit("::", 1)[0] if "::" in name else owner
        scope = re.sub(r"<.*", "", scope)
        if not head.strip() and not (plus and (scope and plain.lstrip("~") == scope.split("::")[-1])):
            at = max(at, after)
            continue
        mark = re.compile(r"[{;=]|,").search(text, after)
        if not mark or (mark[0] == ";" and re.search(r"\)\s*$", text[begin : m.start()])):
            continue
        if mark[0] in "=,":
            mark = re.compile(r"[{;]").search(text, mark.end())
            if not mark:
                continue
        between = text[after : mark.start()]
        if mark[0] == "{" and re.match(r"\s*:(?!:)", between):  # initialisers may have braces of their own
            while re.compile(r"\{\s*\}\s*[,{]|\{[^{}]*\}\s*,").match(text, mark.start()):
                mark = re.compile(r"[{;]").search(text, code.close(start + mark.start()) - start + 1)
                if not mark:
                    break
            if not mark:
                continue
        stop = code.close(start + mark.start()) + 1 if mark[0] == "{" else start + mark.end()
        kind = "method" if plus and scope else "function"
        out.symbols.append(code.symbol(plain, kind, start + begin, stop, receiver=scope if kind == "method" else ""))
        if mark[0] == "{":
            # Qualified calls are not calls of the last name alone.
            found = code.calls(start + mark.start(), stop, keywords=_KEYWORDS, pattern=_CALL)
            out.calls += [(plain, callee, line) for callee, line in found]
        at = max(at, mark.end())


_CALL = re.compile(r"(?<![\w:])([A-Za-z_]\w*)\s*\(")
