"""Java, Kotlin and C#: types, members, calls and imports."""

from __future__ import annotations

import re

from fathomer.sources.languages.code import Code, Parsed, Style

# Words before a parenthesis that call nothing.
_JAVA_WORDS = frozenset("if for while switch catch return synchronized try new super this throw assert do else case instanceof".split())
_KOTLIN_WORDS = frozenset("if for while when catch return fun constructor init throw class else in is by get set super this object".split())
_CSHARP_WORDS = frozenset("if for foreach while switch catch return using lock fixed nameof typeof sizeof default checked unchecked new base this when throw await else in is".split())

_JAVA_TYPE = re.compile(r"\b(class|record|interface|enum|@interface)\s+([A-Za-z_]\w*)")
_JAVA_METHOD = re.compile(r"(?P<head>(?:[\w.@$]+(?:<[^;{}()]*>)?(?:\[\])*\s+|<[^;{}()]*>\s*)*)(?P<name>[A-Za-z_$]\w*)\s*\(")
_JAVA_FIELD = re.compile(
    r"(?:^|(?<=[;{}]))(?P<lead>\s*)(?P<head>(?:@\w+(?:\([^)]*\))?\s+|(?:public|private|protected|static|final|volatile|transient)\s+)*[\w.$]+(?:<[^;{}()=]*>)?(?:\[\])*)\s+"
    r"(?P<names>[A-Za-z_$]\w*(?:\s*=[^;{}]*?(?:\{[^;]*\})?)?(?:\s*,\s*[A-Za-z_$]\w*(?:\s*=[^;,{}]*)?)*)\s*;"
)


def _begin(text: str, at: int) -> int:
    """Where the statement that holds ``at`` begins."""
    cut = max(text.rfind(c, 0, at) for c in ";{}")
    return cut + 1 + len(text[cut + 1 : at]) - len(text[cut + 1 : at].lstrip())


def _after(text: str, at: int) -> int:
    """Where the first ``{`` or ``;`` after ``at`` stands, or -1."""
    m = re.compile(r"[{;]").search(text, at)
    return m.start() if m else -1


def parse_java(source: str) -> Parsed:
    code, out = Code(source, Style(raw=('"""',))), Parsed()
    out.imports = re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code.masked)
    out.imports = [x.removesuffix(".*") for x in out.imports]
    _java_types(code, 0, len(source), "", out)
    return out


def _java_types(code: Code, start: int, end: int, outer: str, out: Parsed) -> None:
    text = code.shallow(start, end)
    for m in _JAVA_TYPE.finditer(text):
        brace = text.find("{", m.end())
        if brace < 0:
            continue
        begin, stop = start + _begin(text, m.start()), code.close(start + brace) + 1
        kind = {"class": "struct", "record": "struct", "enum": "type"}.get(m[1], "interface")
        out.symbols.append(code.symbol(m[2], kind, begin, stop, package=outer))
        if m[1] != "enum":
            _java_members(code, start + brace + 1, stop - 1, m[2], out)
            _java_types(code, start + brace + 1, stop - 1, m[2], out)


def _java_members(code: Code, start: int, end: int, owner: str, out: Parsed) -> None:
    text = code.shallow(start, end)
    at = 0
    while m := re.compile(r"([A-Za-z_$]\w*)\s*\(").search(text, at):
        open_ = start + m.end() - 1
        at = m.end()
        begin = _begin(text, m.start())
        head = text[begin : m.start()]
        if m[1] in _JAVA_WORDS or head.rstrip().endswith(("@", ".")) or "=" in head or re.search(r"\bnew\s*$", head):
            at = max(at, code.close(open_) - start + 1)
            continue
        mark = _after(text, code.close(open_) - start + 1)
        if mark < 0 or (text[mark] == ";" and not head.strip()):
            continue
        stop = code.close(start + mark) + 1 if text[mark] == "{" else start + mark + 1
        at = mark + 1
        built = m[1] == owner
        out.symbols.append(code.symbol(m[1], "function" if built else "method", start + begin, stop, receiver=owner, package=owner))
        if text[mark] == "{":
            out.calls += [(m[1], name, line) for name, line in code.calls(start + mark, stop, keywords=_JAVA_WORDS)]
    for m in _JAVA_FIELD.finditer(text):
        if re.match(r"\s*(?:return|package|import|throw|class|interface|enum|record|abstract)\b", m["head"]) or "(" in m["head"]:
            continue
        begin = start + m.start("head")
        for name in re.findall(r"(?:^|,)\s*([A-Za-z_$]\w*)", re.sub(r"=[^,;]*", "", m["names"])):
            out.symbols.append(code.symbol(name, "field", begin, start + m.end(), receiver=owner, package=owner))


_KOTLIN_DECL = re.compile(
    r"(?m)(?P<mods>(?:^|(?<=[;{}\n]))[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s+|(?:public|private|protected|internal|open|abstract|final|sealed|data|enum|annotation|inner|"
    r"override|suspend|inline|operator|infix|tailrec|external|const|lateinit|expect|actual|value|fun(?=\s+interface))\s+)*)"
    r"(?P<word>class|interface|object|fun|val|var)\b\s*(?:<[^>]*>\s*)?(?:(?:[\w.<>?]+\.)?(?P<name>[A-Za-z_]\w*|`[^`]+`))"
)


def parse_kotlin(source: str) -> Parsed:
    code, out = Code(source, Style(raw=('"""',))), Parsed()
    package = m[1] if (m := re.search(r"(?m)^\s*package\s+([\w.]+)", code.masked)) else ""
    out.imports = re.findall(r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)", code.masked)
    _kotlin(code, 0, len(source), "", package, out)
    return out


#: ``a.b()`` is a call of a member, which the name alone does not stand for.
_BARE = re.compile(r"(?<![\w$.])([A-Za-z_]\w*)\s*\(")


def _kotlin(code: Code, start: int, end: int, owner: str, package: str, out: Parsed) -> None:
    text = code.shallow(start, end)
    for m in _KOTLIN_DECL.finditer(text):
        begin = start + m.start() + len(m["mods"]) - len(m["mods"].lstrip())
        word, name = m["word"], m["name"].strip("`")
        rest = m.end()
        while rest < len(text) and text[rest] in " \t<":
            rest = rest + 1 if text[rest] != "<" else text.find(">", rest) + 1 or len(text)
        if rest < len(text) and text[rest] == "(":
            rest = code.close(start + rest) - start + 1
        line_end = text.find("\n", rest)
        line_end = len(text) if line_end < 0 else line_end
        brace = text.find("{", rest, line_end + 1)
        equals = text.find("=", rest, line_end)
        stop = start + line_end if brace < 0 else code.close(start + brace) + 1
        if word in ("class", "interface", "object"):
            if word != "object":
                out.symbols.append(code.symbol(name, "struct" if word == "class" else "interface", begin, stop, package=package))
            if brace >= 0:
                _kotlin(code, start + brace + 1, stop - 1, name, package, out)
        elif word == "fun":
            out.symbols.append(code.symbol(name, "method" if owner else "function", begin, stop, receiver=owner, package=package))
            body = start + (brace if brace >= 0 and not 0 <= equals < brace else max(equals, rest))
            out.calls += [(name, callee, line) for callee, line in code.calls(body, stop, keywords=_KOTLIN_WORDS, pattern=_BARE)]
        else:
            out.symbols.append(code.symbol(name, "field" if owner else "var", begin, start + line_end, receiver=owner, package=package))


_CS_TYPE = re.compile(r"\b(class|struct|record(?:\s+struct|\s+class)?|interface)\s+([A-Za-z_]\w*)")
_CS_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*([;{])")


def parse_csharp(source: str) -> Parsed:
    code, out = Code(source, Style(raw=('"""',))), Parsed()
    for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", code.masked):
        out.imports.append(m[1])
    _csharp(code, 0, len(source), "", out)
    return out


def _csharp(code: Code, start: int, end: int, package: str, out: Parsed) -> None:
    text = code.shallow(start, end)
    for m in _CS_NAMESPACE.finditer(text):
        if m[2] == ";":
            package = m[1]
        else:
            _csharp(code, start + m.end(), code.close(start + m.end() - 1), m[1], out)
    for m in _CS_TYPE.finditer(text):
        mark = _after(text, m.end())
        if mark < 0:
            continue
        begin = start + _begin(text, m.start())
        stop = code.close(start + mark) + 1 if text[mark] == "{" else start + mark + 1
        out.symbols.append(code.symbol(m[2], "interface" if m[1] == "interface" else "struct", begin, stop, package=package))
        if text[mark] == "{":
            _csharp_members(code, start + mark + 1, stop - 1, m[2], package, out)
            _csharp(code, start + mark + 1, stop - 1, package, out)


def _csharp_members(code: Code, start: int, end: int, owner: str, package: str, out: Parsed) -> None:
    text = code.shallow(start, end)
    at = 0
    while m := re.compile(r"([A-Za-z_]\w*)\s*(?:<[\w\s,]*>)?\s*\(").search(text, at):
        open_, at = start + m.end() - 1, m.end()
        begin = _begin(text, m.start())
        head = re.sub(r"^(?:\[[^\]]*\]\s*)+", "", text[begin : m.start()])
        after = code.close(open_) - start + 1
        if m[1] in _CSHARP_WORDS or "=" in head or head.rstrip().endswith((".", "[")) or not head.strip():
            at = max(at, after)
            continue
        arrow = re.compile(r"[^{;=]*=>").match(text, after)
        mark = _after(text, after)
        if mark < 0:
            continue
        stop = start + text.find(";", after) + 1 if arrow else code.close(start + mark) + 1 if text[mark] == "{" else start + mark + 1
        at = max(at, stop - start if text[mark] != "{" else mark + 1)
        out.symbols.append(code.symbol(m[1], "method", start + begin, stop, receiver=owner, package=package))
        out.calls += [(m[1], name, line) for name, line in code.calls(start + after, stop, keywords=_CSHARP_WORDS, pattern=_GENERIC_CALL)]
    field = re.compile(
        r"(?:^|(?<=[;{}]))\s*(?P<head>(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|readonly|const|volatile|new|unsafe)\s+)*[\w.]+(?:<[^;{}()=]*>)?\??(?:\[,*\])*)\s+"
        r"(?P<name>[A-Za-z_]\w*)\s*(?:=[^;>][^;]*)?;"
    )
    for m in field.finditer(text):
        if not re.match(r"(?:using|return|namespace|event|delegate|class|struct|interface|record|throw)\b", m["head"]):
            out.symbols.append(code.symbol(m["name"], "field", start + m.start("head"), start + m.end(), receiver=owner, package=package))


_GENERIC_CALL = re.compile(r"(?<![\w$])([A-Za-z_]\w*)\s*(?:<[\w\s,.<>\[\]]*>)?\s*\(")
