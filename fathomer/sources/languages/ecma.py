"""JavaScript and TypeScript: functions, classes, methods, types, calls and imports."""

from __future__ import annotations

import re

from fathomer.sources.languages.code import Code, Parsed, Style

_STYLE = Style(raw=("`",))
# Words before a parenthesis that call nothing.
_KEYWORDS = frozenset("if for while switch catch return function typeof void delete await yield new in of do else try case super with import".split())
_EXPORT = r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
_FUNCTION = re.compile(rf"(?m)(?P<lead>(?:^|(?<=[;}}])))[ \t]*(?P<at>{_EXPORT}(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*))")
_CLASS = re.compile(rf"(?m)(?:^|(?<=[;}}]))[ \t]*(?P<at>{_EXPORT}(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*))")
_VALUE = re.compile(
    rf"(?m)(?:^|(?<=[;}}]))[ \t]*(?P<at>{_EXPORT}(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?"
    r"(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n{]+)?=>|[A-Za-z_$][\w$]*\s*=>))"
)
_METHOD = re.compile(
    r"(?m)(?:^|(?<=[;}]))[ \t]*(?P<at>(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*"
    r"(?P<name>[#A-Za-z_$][\w$]*)\s*(?:<[^>{}]*>)?\s*)\("
)
_TYPES = (
    (re.compile(rf"(?m)(?:^|(?<=[;}}]))[ \t]*(?P<at>{_EXPORT}interface\s+(?P<name>[A-Za-z_$][\w$]*))"), "interface"),
    (re.compile(rf"(?m)(?:^|(?<=[;}}]))[ \t]*(?P<at>{_EXPORT}type\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=)"), "type"),
    (re.compile(rf"(?m)(?:^|(?<=[;}}]))[ \t]*(?P<at>{_EXPORT}(?:const\s+)?enum\s+(?P<name>[A-Za-z_$][\w$]*))"), "type"),
)
_IMPORT = re.compile(r"(?m)^[ \t]*(?:import|export)\b[^;\n]*?\bfrom\s*(['\"])")
_BARE_IMPORT = re.compile(r"(?m)^[ \t]*import\s*(['\"])")


def parse_javascript(source: str) -> Parsed:
    return _parse(source, typed=False)


def parse_typescript(source: str) -> Parsed:
    return _parse(source, typed=True)


def _body(code: Code, at: int) -> tuple[int, int]:
    """(where the body begins, where the statement ends) of a declaration at ``at``."""
    m = re.compile(r"[({;\n]").search(code.masked, at)
    while m and m[0] == "(":
        m = re.compile(r"[({;\n]").search(code.masked, code.close(m.start()) + 1)
    if m and m[0] == "{":
        return m.start(), code.close(m.start()) + 1
    m = re.compile(r"\{|;").search(code.masked, at)
    if m and m[0] == "{" and "\n\n" not in code.masked[at : m.start()]:
        return m.start(), code.close(m.start()) + 1
    stop = code.masked.find("\n", at)
    stop = len(code.source) if stop < 0 else stop
    return at, stop


def _parse(source: str, *, typed: bool) -> Parsed:
    code, out = Code(source, _STYLE), Parsed()
    top = code.shallow(0, len(source))
    for pattern in (_IMPORT, _BARE_IMPORT):
        for m in pattern.finditer(code.masked):
            quote = m.start(1)
            stop = source.find(m[1], quote + 1)
            if stop > 0:
                out.imports.append(source[quote + 1 : stop])
    for pattern in (_FUNCTION, _VALUE):
        for m in pattern.finditer(top):
            body, stop = _body(code, m.end("name") if pattern is _FUNCTION else m.end("at"))
            out.symbols.append(code.symbol(m["name"], "function", m.start("at"), stop))
            out.calls += [(m["name"], name, line) for name, line in code.calls(body, stop, keywords=_KEYWORDS)]
    for m in _CLASS.finditer(top):
        brace = top.find("{", m.end("at"))
        if brace < 0:
            continue
        stop = code.close(brace) + 1
        out.symbols.append(code.symbol(m["name"], "struct", m.start("at"), stop))
        inner = code.shallow(brace + 1, stop - 1)
        for k in _METHOD.finditer(inner):
            if k["name"] in _KEYWORDS:
                continue
            begin, end = brace + 1 + k.start("at"), _body(code, brace + 1 + k.end("name"))[1]
            begin += len(k["at"]) - len(k["at"].lstrip())
            out.symbols.append(code.symbol(k["name"], "method", begin, end, receiver=m["name"]))
    if typed:
        for pattern, kind in _TYPES:
            for m in pattern.finditer(top):
                brace = re.compile(r"[^\n;{]*\{").match(top, m.end("at"))
                end = code.close(brace.end() - 1) + 1 if brace else _line_end(top, m.end("at"))
                out.symbols.append(code.symbol(m["name"], kind, m.start("at"), end))
    out.symbols.sort(key=lambda s: s.start_line)
    return out


def _line_end(text: str, at: int) -> int:
    m = re.compile(r"[;\n]").search(text, at)
    return m.start() if m else len(text)
