"""Parsers by file extension and by file name."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from fathomer.sources.languages import c, ecma, go, jvm, plain, rust
from fathomer.sources.languages.code import Parsed


@dataclass(frozen=True)
class Language:
    name: str
    parse: Callable[[str, str], Parsed]  # of a source and its path
    extensions: tuple[str, ...]
    files: tuple[str, ...] = ()


def _of(parse: Callable[[str], Parsed]) -> Callable[[str, str], Parsed]:
    return lambda source, path: parse(source)


# Which files a language has.
LANGUAGES: list[Language] = [
    Language("go", _of(go.parse), (".go",)),
    Language("java", _of(jvm.parse_java), (".java",)),
    Language("kotlin", _of(jvm.parse_kotlin), (".kt", ".kts")),
    Language("javascript", _of(ecma.parse_javascript), (".js", ".mjs", ".cjs", ".jsx")),
    Language("typescript", _of(ecma.parse_typescript), (".ts", ".tsx", ".mts", ".cts")),
    Language("rust", _of(rust.parse), (".rs",)),
    Language("csharp", _of(jvm.parse_csharp), (".cs",)),
    Language("c", _of(c.parse_c), (".c", ".h")),
    Language("cpp", _of(c.parse_cpp), (".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++")),
    Language("sql", _of(plain.parse_sql), (".sql",)),
    Language("markdown", _of(plain.parse_markdown), (".md", ".mdx")),
    Language("html", _of(plain.parse_html), (".html", ".htm")),
    Language("shell", _of(plain.parse_shell), (".sh", ".bash", ".dash", ".zsh")),
    Language("http", _of(plain.parse_http), (".http", ".rest")),
    Language("protobuf", _of(plain.parse_proto), (".proto",)),
    Language(
        "text",
        lambda source, path: plain.parse_text(source, posixpath.basename(path)),
        (".txt", ".env", ".cfg", ".conf", ".ini", ".properties"),
        ("Makefile", "Dockerfile", "LICENSE", "Rakefile", "Vagrantfile", "Procfile"),
    ),
]


_BUILT_IN = len(LANGUAGES)


def register(language: Language) -> None:
    """Add a language; it takes over extensions and names that others have.

    Jobs that parse carry the added languages to the workers.
    """
    LANGUAGES.append(language)


def registered() -> list[Language]:
    """The languages that were added."""
    return LANGUAGES[_BUILT_IN:]


def by_extension(added: Sequence[Language] = ()) -> dict[str, Language]:
    return {e: language for language in [*LANGUAGES, *added] for e in language.extensions}


def by_file(added: Sequence[Language] = ()) -> dict[str, Language]:
    return {f: language for language in [*LANGUAGES, *added] for f in language.files}


def language_of(path: str, added: Sequence[Language] = ()) -> Language | None:
    """The language of a path: by extension in lower case, then by exact name."""
    base = posixpath.basename(path)
    dot = base.rfind(".")
    return by_extension(added).get(base[dot:].lower() if dot >= 0 else "") or by_file(added).get(base)
