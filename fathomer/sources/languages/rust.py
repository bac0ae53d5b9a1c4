"""Rust: functions, types, traits, implementations, calls and uses."""

from __future__ import annotations

import re

from fathomer.sources.languages.code import Code, Parsed, Style

_STYLE = Style(quotes="\"'", lifetimes=True)
# Words before a parenthesis that call nothing.
_KEYWORDS = frozenset("if for while loop match return fn let in as move where pub crate super unsafe else impl dyn ref mut".split())
_LEAD = r"(?m)(?:^|(?<=[;}]))[ \t]*(?P<at>(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?"
_ITEM = re.compile(
    _LEAD + r"(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?P<word>fn|struct|enum|trait|type|mod|union)\s+(?P<name>[A-Za-z_]\w*))"
)
_IMPL = re.compile(r"(?m)(?:^|(?<=[;}]))[ \t]*(?:unsafe\s+)?impl\b")
_USE = re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);")
_KINDS = {"struct": "struct", "union": "struct", "enum": "type", "trait": "interface", "type": "type"}
#: ``name(``, also behind a path or a dot, but no macro.
_CALL = re.compile(r"(?<![\w!])([A-Za-z_]\w*)\s*(?:::<[^;{}()]*>)?\s*\(")


def parse(source: str) -> Parsed:
    code, out = Code(source, _STYLE), Parsed()
    for m in _USE.finditer(code.masked):
        path = re.sub(r"\s+", " ", m[1]).strip()
        out.imports.append(re.sub(r"\s+as\s+\w+$", "", path).removesuffix("::*"))
    _block(code, 0, len(source), "", out)
    out.symbols.sort(key=lambda s: s.start_line)
    return out


def _block(code: Code, start: int, end: int, owner: str, out: Parsed) -> None:
    text = code.shallow(start, end)
    for m in _ITEM.finditer(text):
        begin, at = start + m.start("at"), m.end("name")
        mark = re.compile(r"[{;]").search(text, at)
        while mark and mark[0] == ";" and "[" in text[at : mark.start()] and "]" not in text[at : mark.start()]:
            mark = re.compile(r"[{;]").search(text, mark.end())
        if not mark:
            continue
        open_ = start + mark.start()
        stop = code.close(open_) + 1 if mark[0] == "{" else open_ + 1
        if m["word"] == "mod":
            if mark[0] == "{":
                _block(code, open_ + 1, stop - 1, "", out)
            continue
        kind = _KINDS.get(m["word"]) or ("method" if owner else "function")
        out.symbols.append(code.symbol(m["name"], kind, begin, stop, receiver=owner if kind == "method" else ""))
        if m["word"] == "fn" and mark[0] == "{":
            out.calls += [(m["name"], name, line) for name, line in code.calls(open_, stop, keywords=_KEYWORDS, pattern=_CALL)]
        elif m["word"] == "trait" and mark[0] == "{":
            _block(code, open_ + 1, stop - 1, m["name"], out)
    for m in _IMPL.finditer(text):
        brace = text.find("{", m.end())
        if brace < 0:
            continue
        head = re.sub(r"\bwhere\b.*", "", text[m.end() : brace], flags=re.S)
        while (shorter := re.sub(r"<[^<>]*>", "", head)) != head:
            head = shorter
        target = re.split(r"\bfor\b", head)[-1].strip()
        name = re.findall(r"[A-Za-z_]\w*", target)
        _block(code, start + brace + 1, code.close(start + brace), name[-1] if name else "", out)
