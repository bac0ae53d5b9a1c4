"""Text functions: tokens, keywords, identifiers, lines, paths and addresses.

All are Catalyst expressions, so they run inside generated code and can be
pushed around by the optimizer.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
_KEYWORD = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"
MIN_TERM, MAX_TERM, MAX_TERMS = 3, 30, 12
#: Callees and imports that a symbol's text shows.
MAX_CALLS, MAX_IMPORTS = 10, 6

# Words that a query drops.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below between both but
    by can cannot could did do does doing don't down during each few for from further get got had has have having he
    her here hers herself him himself his how i if in into is it its itself just let like me might more most my myself
    need no nor not now of off on once only or other ought our ours ourselves out over own please same she should so
    some such than that the their theirs them themselves then there these they this those through to too under until
    up us very want was we were what when where which while who whom why will with won't would you your yours yourself
    yourselves
    help file files code use using make way thing something
    """.split()
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _folding() -> tuple[str, str]:
    """Lower-case letters with a mark, and the letters without it."""
    marked = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and chr(c).islower()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


_MARKED, _PLAIN = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics (Latin letters)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, _MARKED, _PLAIN))


def tokens(text: Column, *, folded: bool = True) -> Column:
    """The tokens of a text in order: runs of letters and digits, folded."""
    low = fold(text) if folded else F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def extract_keywords(query: Column) -> Column:
    """The terms of a natural-language query, joined by spaces.

    Lower-cased compounds of letters and digits joined by ``-``, ``_`` or
    ``.``, of 3 to 30 bytes, without stop words, each once, at most twelve.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(_KEYWORD), F.lit(0))
    sized = F.filter(found, lambda t: (F.length(t) >= MIN_TERM) & (F.length(t) <= MAX_TERM))
    kept = F.array_except(sized, F.array(*map(F.lit, STOPWORDS)))
    return F.array_join(F.slice(kept, 1, MAX_TERMS), " ")


def member_name(receiver: Column, name: Column) -> Column:
    return F.when(F.coalesce(receiver, F.lit("")) != "", F.concat_ws(".", receiver, name)).otherwise(name)


def symbol_id(file: Column, name: Column, kind: Column, receiver: Column | None = None) -> Column:
    """``file:name:kind``; the name of a member is ``receiver.name``."""
    return F.concat_ws(":", file, name if receiver is None else member_name(receiver, name), kind)


def first_line(text: Column) -> Column:
    """The first line, cut before an opening brace, trimmed."""
    return F.trim(F.substring_index(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1), "{", 1))


def line_range(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The extension of a path in lower case, with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def url_path(url: Column) -> Column:
    """The path of an address, ``/`` if it has none."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_extract(bare, r"^([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def qualified_name(name: Column) -> Column:
    """What follows the last ``::``."""
    return F.substring_index(name, "::", -1)


def qualified_receiver(name: Column) -> Column:
    """What stands before the last ``::``; empty if there is none."""
    return F.regexp_extract(name, r"^(.*)::[^:]*$", 1)


def embed_text(
    file: Column,
    kind: Column,
    name: Column,
    *,
    receiver: Column | None = None,
    signature: Column | None = None,
    doc: Column | None = None,
    snippet: Column | None = None,
    calls: Column | None = None,
    imports: Column | None = None,
) -> Column:
    """The text that a symbol is embedded by; parts that are empty are left out.

    ``file kind [Receiver.]Name[: signature]``, then on lines of their own the
    comment, the snippet, the first ten different callees and the first six
    different imports.
    """
    full = name if receiver is None else member_name(receiver, name)
    parts = [F.concat_ws(" ", file, kind, full)]
    if signature is not None:
        parts.append(F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(": "), signature)).otherwise(""))
    for extra in (doc, snippet):
        if extra is not None:
            parts.append(F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n"), extra)).otherwise(""))
    for title, names, most in (("calls", calls, MAX_CALLS), ("imports", imports, MAX_IMPORTS)):
        if names is not None:
            some = F.slice(F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != "")), 1, most)
            parts.append(F.when(F.size(some) > 0, F.concat(F.lit(f"\n{title}: "), F.array_join(some, ", "))).otherwise(""))
    return F.concat(*parts)
