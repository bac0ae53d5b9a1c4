"""License scans: canonical digests of whole texts, looked up among known ones.

Native: DataFrame functions only.  A text is put in a canonical form (case,
punctuation, copyright lines and equivalent spellings no longer differ), and
its digest is joined with the digests of known licences.  So are the digests of
its lines and paragraphs, since most texts carry a notice rather than a licence.

Known are the texts in ``licence_texts``, with and without what follows their
terms (how to apply them), short texts that are put together here, and notices.

Only pieces that hold one of ``HINTS`` are put in canonical form.  Every text of
this module holds one, so nothing is missed; with a caller's table, whose texts
are not known, all pieces are.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each known text contains one of these, and canonical forms keep them; "released" and "distributed" are of notices.
HINTS = ("licen", "permission", "redistribution", "warranty", "released", "distributed")

# Spellings that count as one, as (written, canonical), in canonical characters.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("per cent", "percent"),
    ("org", "organization"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("https", "http"),
)

# The texts of licences as their authors publish them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC + _AS_IS),
    ("ISC", "ISC License\n" + _ISC + _AS_IS),
    ("0BSD", _ZERO + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_THIRD + _BSD_END),
)
# The names by which notices call licences, by identifier.
NAMES = (
    ("Apache-2.0", ("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    ("MIT", ("the MIT License", "MIT License", "MIT")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "BSD-3-Clause")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "LGPL-3.0")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "AGPL-3.0")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "MPL-2.0")),
    ("ISC", ("the ISC License", "ISC")),
    ("CC0-1.0", ("CC0 1.0", "CC0-1.0")),
    *((f"CC-{kind}-4.0", (f"CC {kind} 4.0", f"CC-{kind}-4.0")) for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
)
# How a notice begins.
OPENINGS = (
    "Licensed under",
    "Released under",
    "Distributed under",
    "This work is licensed under",
    "This software is licensed under",
    "This software is released under",
    "This project is licensed under",
    "SPDX-License-Identifier:",
)

#: Lines that name whose the copyright is; a line that merely begins with the word, as of a text wrapped anew, is none.
_COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[<\[{]?[ \t]*(?:[0-9]{4}|year|yyyy)|(?:by )?the [^\n]*authors)"
    r"|(?:\(c\)|©)[ \t]*(?:copyright)?[ \t]*[<\[{]?[ \t]*(?:[0-9]{4}|year|yyyy))[^\n]*$"
)
_LAST_LINE = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of every licence and notice that is looked up."""
    files = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    cut = [(key, text[: text.index(_LAST_LINE) + len(_LAST_LINE)]) for key, text in files if _LAST_LINE in text]
    cut += [(key, text.removesuffix(_LAST_LINE)) for key, text in cut]
    notices = [(key, f"{opening} {name}.") for key, names in NAMES for name in names for opening in OPENINGS]
    return [*TEXTS, *files, *cut, *notices]


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, in one spelling, one space between words."""
    plain = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for written, one in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {written} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(plain, " +", " "))


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest, license``: a table of fixed size, from the texts of this module."""
    rows = [(key, text) for key, text in known_texts()]
    return spark.createDataFrame(rows, "license string, text string").select(digest(F.col("text")).alias("digest"), "license").distinct()


def _hinted(piece: Column) -> Column:
    low = F.lower(piece)
    found = F.lit(False)
    for hint in HINTS:
        found = found | F.contains(low, F.lit(hint))
    return found


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """The licences of every document.

    Returns, for each document id, ``doc_id``, ``license`` (the identifier of
    the licence that the whole text is, or null), ``notices`` (the identifiers
    whose text is one of its lines or paragraphs, sorted, joined by commas; the
    empty string if none) and ``n_notices`` (how many different ones).

    ``known`` (``digest, license``) replaces the built-in table and is joined
    by hash; it may be of any size.  Rows that repeat a document id are taken
    together, those without one as one document; a null or empty text has no
    licence, and an empty table gives an empty one.
    """
    hinted = _hinted if known is None else lambda piece: piece.isNotNull()
    known = known_digests(docs.sparkSession) if known is None else known.select("digest", "license")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = F.filter(F.array(F.struct(F.lit(True).alias("whole"), text.alias("piece"))), lambda x: hinted(x["piece"]))
    part = lambda x: F.struct(F.lit(False).alias("whole"), x.alias("piece"))
    parts = F.filter(F.concat(F.split(text, "\n", -1), F.split(text, r"\n\s*\n", -1)), hinted)
    pieces = F.concat(whole, F.transform(parts, part))
    # Only a text with a hint is split at all.
    found = F.when(hinted(text), F.transform(pieces, lambda x: F.struct(x["whole"].alias("whole"), digest(x["piece"]).alias("digest"))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode_outer(found).alias("p")).select("doc_id", "p.whole", "p.digest")
    matched = rows.join(known, "digest", "left")
    out = matched.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("found"),
    )
    return out.select("doc_id", "license", F.array_join("found", ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, over ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical_sql(text: str) -> str:
        plain = f"regexp_replace(lower({text}), {quoted(_COPYRIGHT)}, '', 'g')"
        plain = rf"(' ' || regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ')"
        for written, one in SPELLINGS:
            plain = f"replace({plain}, ' {written} ', ' {one} ')"
        return f"trim(regexp_replace({plain}, ' +', ' ', 'g'))"

    values = ", ".join(f"({quoted(key)}, {quoted(text)})" for key, text in known_texts())
    return rf"""
        WITH known AS (
            SELECT DISTINCT md5({canonical_sql("body")}) AS digest, license FROM (VALUES {values}) v(license, body)),
        pieces AS (
            SELECT doc_id, TRUE AS whole, coalesce(text, '') AS piece FROM documents
            UNION ALL SELECT doc_id, FALSE, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
            UNION ALL SELECT doc_id, FALSE, unnest(regexp_split_to_array(coalesce(text, ''), '\n\s*\n')) FROM documents),
        matched AS (
            SELECT doc_id, whole, license FROM pieces JOIN known ON md5({canonical_sql("piece")}) = digest),
        by_doc AS (
            SELECT doc_id, min(license) FILTER (whole) AS license,
                   coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole), '') AS notices,
                   count(DISTINCT license) FILTER (NOT whole) AS n_notices
            FROM matched GROUP BY doc_id)
        SELECT d.doc_id, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
        FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN by_doc USING (doc_id)
    """
