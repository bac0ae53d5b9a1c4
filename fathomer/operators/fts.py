"""Keyword search: a full-text query language, ranked by BM25.

A query is parsed into a tree of phrases and turned into expressions over the
places at which each row has the phrases' terms.  ``Index`` stores postings
once, in runs sorted by term, with each row's length, and answers from the
postings of the query's terms alone, whose filter reaches the Parquet scan.  ``search``
answers from token arrays without an index, in one pass over all rows.

The language: barewords, ``"phrases"``, ``prefix*``, ``^first``, ``a + b``,
``column : term``, ``{a b} : term``, ``NEAR(a b, n)``, ``AND``, ``OR``, ``NOT``
and parentheses.  Terms side by side must all match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomer.functions.text import let, tokens
from fathomer.workspace import bounded_batches, written

COLUMNS = ("name", "signature", "doc_comment")
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


class QueryError(ValueError):
    """A query that the language does not allow."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not, near, phrase
    parts: tuple["Node", ...] = ()
    phrase: Phrase | None = None
    gap: int = 10


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:*^+,-]))')


def _lexed(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"syntax error near {query[at:].strip()[:10]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("string", m[1][1:-1].replace('""', '"')))
        elif m[2] is not None:
            out.append(("word", m[2]))
        else:
            out.append(("mark", m[3]))
    return out


def split_terms(text: str, *, folded: bool = True) -> tuple[str, ...]:
    """The tokens of a text, as ``functions.text.tokens`` cuts them."""
    import unicodedata

    plain = text.lower()
    if folded:
        plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))
    return tuple(t for t in re.split(r"[\W_]+", plain) if t)


class _Parser:
    def __init__(self, query: str, columns: tuple[str, ...], folded: bool) -> None:
        self.items, self.at, self.columns, self.folded = _lexed(query), 0, columns, folded

    def peek(self, kind: str, value: str | None = None, ahead: int = 0) -> bool:
        at = self.at + ahead
        return at < len(self.items) and self.items[at][0] == kind and value in (None, self.items[at][1])

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.peek(kind, value):
            found = self.items[self.at][1] if self.at < len(self.items) else "the end"
            raise QueryError(f"syntax error near {found!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> Node | None:
        if not self.items:
            return None
        node = self.any_of()
        if self.at < len(self.items):
            raise QueryError(f"syntax error near {self.items[self.at][1]!r}")
        return node

    def any_of(self) -> Node:
        parts = [self.all_of()]
        while self.peek("word", "OR"):
            self.at += 1
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def all_of(self) -> Node:
        parts = [self.without()]
        while self.peek("word", "AND"):
            self.at += 1
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def without(self) -> Node:
        node = self.side_by_side()
        while self.peek("word", "NOT"):
            self.at += 1
            node = Node("not", (node, self.side_by_side()))
        return node

    def _begins(self) -> bool:
        if self.at >= len(self.items):
            return False
        kind, value = self.items[self.at]
        return kind == "string" or (kind == "word" and value not in ("AND", "OR", "NOT")) or (kind == "mark" and value in "({^-")

    def side_by_side(self) -> Node:
        parts = [self.single()]
        while self._begins():
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def single(self) -> Node:
        allowed = self.column_filter()
        if self.peek("mark", "("):
            self.at += 1
            node = self.any_of()
            self.take("mark", ")")
        elif self.peek("word", "NEAR") and self.peek("mark", "(", 1):
            self.at += 2
            parts = [self.phrase()]
            while not self.peek("mark", ",") and not self.peek("mark", ")"):
                parts.append(self.phrase())
            gap = 10
            if self.peek("mark", ","):
                self.at += 1
                gap = self.take("word")
                if not gap.isdigit():
                    raise QueryError(f"expected integer, got {gap!r}")
            self.take("mark", ")")
            node = Node("near", tuple(parts), gap=int(gap)) if len(parts) > 1 else parts[0]
        else:
            node = self.phrase()
        return _limited(node, allowed) if allowed is not None else node

    def column_filter(self) -> tuple[str, ...] | None:
        at, dropped = self.at, False
        if self.peek("mark", "-"):
            dropped = True
            self.at += 1
        names: list[str] = []
        if self.peek("mark", "{"):
            self.at += 1
            while not self.peek("mark", "}"):
                names.append(self.take(self.items[self.at][0]) if self.at < len(self.items) else self.take("word"))
            self.at += 1
        elif (self.peek("word") or self.peek("string")) and self.peek("mark", ":", 1):
            names.append(self.items[self.at][1])
            self.at += 1
        if not names or not self.peek("mark", ":"):
            if dropped:
                if self.peek("word"):
                    raise QueryError(f"no such column: {self.items[self.at][1]}")
                raise QueryError("syntax error near '-'")
            self.at = at
            return None
        self.at += 1
        for name in names:
            if name.lower() not in self.columns:
                raise QueryError(f"no such column: {name}")
        chosen = {n.lower() for n in names}
        return tuple(c for c in self.columns if (c in chosen) != dropped)

    def phrase(self) -> Node:
        initial = False
        if self.peek("mark", "^"):
            initial = True
            self.at += 1
        terms: list[str] = []
        prefix = False
        while True:
            if self.peek("string"):
                terms += split_terms(self.take("string"), folded=self.folded)
            elif self.peek("word") and self.items[self.at][1] not in ("AND", "OR", "NOT"):
                terms += split_terms(self.take("word"), folded=self.folded)
            else:
                self.take("word", "a term")
            if self.peek("mark", "*"):
                prefix = True
                self.at += 1
            if not self.peek("mark", "+"):
                break
            if prefix:
                raise QueryError("syntax error near '+'")
            self.at += 1
        return Node("phrase", phrase=Phrase(tuple(terms), prefix, initial))


def _limited(node: Node, allowed: tuple[str, ...]) -> Node:
    if node.phrase:
        own = node.phrase.columns
        return replace(node, phrase=replace(node.phrase, columns=allowed if own is None else tuple(c for c in own if c in allowed)))
    return replace(node, parts=tuple(_limited(p, allowed) for p in node.parts))


def parse(query: str, columns: tuple[str, ...] = COLUMNS, *, folded: bool = True) -> Node | None:
    """The tree of a query; None if it has no terms.  Terms are folded as the tokens are that they are looked for in."""
    return _Parser(query, columns, folded).whole()


def phrases(node: Node) -> list[Phrase]:
    """Every phrase of a tree, in order."""
    return [node.phrase] if node.phrase else [p for part in node.parts for p in phrases(part)]


class _Tokens:
    """Where phrases begin in a row that has token arrays."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns = columns

    def starts(self, phrase: Phrase, column: str) -> Column:
        last = len(phrase.terms) - 1

        def here(a: Column, first: Column, i: Column) -> Column:
            fits = F.lit(True)
            for k, term in enumerate(phrase.terms):
                token = first if k == 0 else F.get(a, i + k)
                same = F.coalesce(token.startswith(term) if phrase.prefix and k == last else token == term, F.lit(False))
                fits = fits & same
            return fits & (i == 0) if phrase.initial else fits

        return let(F.col(f"tok_{column}"), lambda a: F.filter(F.transform(a, lambda t, i: F.when(here(a, t, i), i)), lambda p: p.isNotNull()))

    def count(self, phrase: Phrase, column: str) -> Column:
        if len(phrase.terms) == 1 and not phrase.initial:
            term = phrase.terms[0]
            return F.size(F.filter(f"tok_{column}", lambda t: t.startswith(term) if phrase.prefix else t == term))
        return F.size(self.starts(phrase, column))


class _Places:
    """Where phrases begin in a row that has the places of each of the query's terms."""

    def __init__(self, columns: tuple[str, ...], known: list[Phrase]) -> None:
        self.columns = columns
        self.slots: dict[tuple[str, bool], int] = {}
        for phrase in known:
            for k, term in enumerate(phrase.terms):
                self.slots.setdefault((term, phrase.prefix and k == len(phrase.terms) - 1), len(self.slots))

    def wanted(self) -> Column:
        """The postings that are needed."""
        return _any([F.col("term").startswith(t) if prefix else F.col("term") == t for t, prefix in self.slots])

    def gathered(self) -> list[Column]:
        """Aggregates of a row's postings: the places of each term in each column."""
        out = []
        for (term, prefix), slot in self.slots.items():
            same = F.col("term").startswith(term) if prefix else F.col("term") == term
            out += [F.flatten(F.collect_list(F.when(same & (F.col("col") == c), F.col("positions")))).alias(f"p{slot}_{c}") for c in self.columns]
        return out

    def _places(self, phrase: Phrase, k: int, column: str) -> Column:
        return F.col(f"p{self.slots[phrase.terms[k], phrase.prefix and k == len(phrase.terms) - 1]}_{column}")

    def starts(self, phrase: Phrase, column: str) -> Column:
        more = range(1, len(phrase.terms))

        def here(p: Column) -> Column:
            fits = p == 0 if phrase.initial else F.lit(True)
            for k in more:
                fits = fits & F.array_contains(self._places(phrase, k, column), p + k)
            return fits

        first = self._places(phrase, 0, column)
        return F.filter(first, here) if phrase.initial or len(phrase.terms) > 1 else first

    def count(self, phrase: Phrase, column: str) -> Column:
        return F.size(self.starts(phrase, column))


def _count(rows: _Tokens | _Places, phrase: Phrase) -> Column:
    total = F.lit(0)
    if phrase.terms:
        for name in phrase.columns if phrase.columns is not None else rows.columns:
            total = total + rows.count(phrase, name)
    return total


def _near(rows: _Tokens | _Places, node: Node) -> Column:
    """Whether one column holds all phrases with at most ``gap`` tokens between them."""
    found = F.lit(False)
    parts = [p.phrase for p in node.parts]
    if not all(p.terms for p in parts):
        return found
    for name in parts[0].columns if parts[0].columns is not None else rows.columns:
        size = len(parts[0].terms)
        spots = [rows.starts(p, name) for p in parts[1:]]

        def close(i: Column, j: Column, other: Phrase) -> Column:
            between = F.when(j >= i, j - i - size).otherwise(i - j - len(other.terms))
            return between <= node.gap

        def all_close(i: Column) -> Column:
            ok = F.lit(True)
            for spot, other in zip(spots, parts[1:], strict=True):
                ok = ok & F.exists(spot, lambda j: close(i, j, other))
            return ok

        found = found | F.exists(rows.starts(parts[0], name), all_close)
    return found


def _matches(node: Node, counts: dict[Phrase, Column], rows: _Tokens | _Places) -> Column:
    if node.phrase:
        return counts[node.phrase] > 0 if node.phrase.terms else F.lit(True)
    sides = [_matches(p, counts, rows) for p in node.parts]
    if node.kind == "or":
        return _any(sides)
    if node.kind == "not":
        return sides[0] & ~sides[1]
    both = F.lit(True)
    for side in sides:
        both = both & side
    return both & _near(rows, node) if node.kind == "near" else both


def _any(sides: list[Column]) -> Column:
    found = sides[0]
    for side in sides[1:]:
        found = found | side
    return found


def tokenized(rows: DataFrame, *, id_col: str = "id", columns: tuple[str, ...] = COLUMNS, folded: bool = True) -> DataFrame:
    """``id``, a token array ``tok_<column>`` for each column, and the row's length ``dl``."""
    arrays = rows.select(F.col(id_col).alias("id"), *[tokens(F.col(c), folded=folded).alias(f"tok_{c}") for c in columns])
    length = F.lit(0)
    for c in columns:
        length = length + F.size(f"tok_{c}")
    return arrays.withColumn("dl", length)


def bm25(tf: Column, df: Column, n: Column, dl: Column, average: Column) -> Column:
    """The part of one phrase in a row's score; larger is better."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * dl / average))


def search(tokens_of: DataFrame, query: str, *, limit: int | None = 10, columns: tuple[str, ...] = COLUMNS, folded: bool = True) -> DataFrame:
    """``id, score, rank`` of the best rows of a query, by score, then id.

    ``tokens_of`` comes from ``tokenized`` with the same ``folded``.  The score is BM25 over all
    phrases, larger is better.  A query without terms finds nothing; a
    malformed one raises ``QueryError``.  A limit of 0 or less is 10; None
    returns all matches, without order and rank.
    """
    limit = 10 if limit is not None and limit <= 0 else limit
    node = parse(query, columns, folded=folded)
    known = list(dict.fromkeys(phrases(node))) if node else []
    if not any(p.terms for p in known):
        return tokens_of.sparkSession.createDataFrame([], _result_schema(tokens_of))
    rows = _Tokens(columns)
    counted = tokens_of.withColumns({f"tf{i}": _count(rows, p) for i, p in enumerate(known)})
    counts = {p: F.col(f"tf{i}") for i, p in enumerate(known)}
    tfs = [f"tf{i}" for i in range(len(known))]
    # The tokens are passed over once; what is written has a few numbers a row.
    narrow = written(counted.select("id", "dl", *tfs, _matches(node, counts, rows).alias("hit")), "term-counts")
    figures = narrow.agg(F.count("*").alias("n"), F.avg("dl").alias("average"), *[F.count_if(F.col(tf) > 0).alias(tf) for tf in tfs]).first()
    score = _score({tf: F.lit(figures[tf]) for tf in tfs}, figures["n"], figures["average"])
    return ranked(narrow.where("hit").select("id", score.alias("score")), limit)


def _score(frequencies: dict[str, Column], n: int, average: float | None) -> Column:
    """BM25 over the phrases, in order; ``frequencies`` has how many rows each count (``tf0`` ...) is not zero in."""
    score = F.lit(0.0)
    for tf, df in frequencies.items():
        score = score + bm25(F.col(tf), df, F.lit(n), F.col("dl"), F.lit(average))
    return score


def _result_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])


def ranked(hits: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by score, then id, with their 1-based rank; all rows as they are for None."""
    if limit is None:
        return hits
    best = hits.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def _grouped(name: str) -> Column:
    """A row's postings in one column: ``term, positions, col`` for each of its terms, by term.

    Tokens are sorted and cut where the term changes, so a row's work grows as
    its sorted tokens do.
    """

    def cut(found: Column) -> Column:
        size = F.size(found)
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.filter(places, lambda i: (i == 0) | (F.get(found, i - 1)["term"] != F.get(found, i)["term"]))

        def one(head: Column, i: Column, k: Column) -> Column:
            own = F.slice(found, i + 1, F.coalesce(F.get(head, k + 1), size) - i)
            return F.struct(F.get(found, i)["term"].alias("term"), F.transform(own, lambda x: x["pos"]).alias("positions"), F.lit(name).alias("col"))

        return let(heads, lambda head: F.transform(head, lambda i, k: one(head, i, k)))

    return let(F.array_sort(F.transform(f"tok_{name}", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))), cut)


def postings(tokens_of: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The inverted index: ``term, id, col, tf, positions, dl``.

    A row has an id of its own, so its tokens are counted where they are and
    nothing is shuffled.
    """
    rows = tokens_of.select("id", "dl", F.inline(F.flatten(F.array(*map(_grouped, columns)))))
    return rows.select("term", "id", "col", F.size("positions").cast("long").alias("tf"), "positions", "dl")


#: Postings that are sorted together, and a row group of the stored index.
RUN = 1 << 19
#: The term of the posting that every row has, for its length: no token is empty.
_ROW = ""


def _runs(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Postings in runs of ``size``, each sorted by term and id."""
    held: list[pa.RecordBatch] = []
    count = 0

    def ordered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        return iter(table.combine_chunks().sort_by([("term", "ascending"), ("id", "ascending")]).to_batches(1 << 16))

    for part in parts:
        held.append(part)
        count += part.num_rows
        if count >= size:
            table = pa.Table.from_batches(held)
            while count >= size:
                yield from ordered(table.slice(0, size))
                table, count = table.slice(size), count - size
            held = table.combine_chunks().to_batches()
    if count:
        yield from ordered(pa.Table.from_batches(held))


@dataclass
class Index:
    """Postings, written once and read by every query.

    Each task writes its postings in sorted runs of bounded size, a row group
    each, so they are neither shuffled nor spilled, and a filter on terms skips
    all but a few pages of a row group.
    """

    #: Also a posting of the empty term for each row.
    stored: DataFrame
    #: How many rows there are, and their mean length.
    n: int
    average: float
    columns: tuple[str, ...] = field(default=COLUMNS)
    folded: bool = True

    @property
    def postings(self) -> DataFrame:
        return self.stored.where(F.col("term") != _ROW)

    @classmethod
    def build(cls, rows: DataFrame, *, id_col: str = "id", columns: tuple[str, ...] = COLUMNS, folded: bool = True, run: int = RUN) -> Index:
        bounded_batches(rows.sparkSession)
        arrays = tokenized(rows, id_col=id_col, columns=columns, folded=folded)
        none = F.array(F.struct(F.lit(_ROW).alias("term"), F.array().cast("array<int>").alias("positions"), F.lit("").alias("col")))
        found = arrays.select("id", "dl", F.inline(F.flatten(F.array(none, *map(_grouped, columns))))).select("term", "id", "col", "positions", "dl")
        sorted_runs = found.mapInArrow(lambda parts: _runs(parts, run), found.schema)
        stored = written(sorted_runs, "postings", compression="zstd", **{"parquet.block.row.count.limit": run})
        figures = stored.where(F.col("term") == _ROW).agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
        return cls(stored, figures["n"], figures["average"] or 0.0, columns, folded)

    def search(self, query: str, limit: int | None = 10) -> DataFrame:
        """As ``fts.search``, from the postings of the query's terms.

        Only rows that hold one of the terms are shuffled, with the places of
        these terms; all rows where a phrase without terms may match them.
        """
        limit = 10 if limit is not None and limit <= 0 else limit
        node = parse(query, self.columns, folded=self.folded)
        known = list(dict.fromkeys(phrases(node))) if node else []
        if not any(p.terms for p in known):
            return self.stored.sparkSession.createDataFrame([], _result_schema(self.stored))
        rows = _Places(self.columns, known)
        wanted = rows.wanted() if all(p.terms for p in known) else rows.wanted() | (F.col("term") == _ROW)
        placed = self.stored.where(wanted).groupBy("id", "dl").agg(*rows.gathered())
        counts = {p: F.col(f"tf{i}") for i, p in enumerate(known)}
        tfs = [f"tf{i}" for i in range(len(known))]
        counted = placed.withColumns({f"tf{i}": _count(rows, p) for i, p in enumerate(known)})
        narrow = counted.select("id", "dl", *tfs, _matches(node, counts, rows).alias("hit"))
        # One row, from the same postings.
        figures = narrow.agg(F.struct(*[F.count_if(F.col(tf) > 0).alias(tf) for tf in tfs]).alias("df")).scalar()
        score = _score({tf: figures[tf] for tf in tfs}, self.n, self.average)
        return ranked(narrow.where("hit").select("id", score.alias("score")), limit)

    def document_frequency(self, terms: list[str]) -> DataFrame:
        """``term, df``, read from the postings of the terms alone."""
        return self.postings.where(F.col("term").isin(*terms)).groupBy("term").agg(F.countDistinct("id").alias("df"))


def find(source: Index | DataFrame, query: str, *, limit: int | None = 10, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``search`` over an index or, without one, over token arrays."""
    return source.search(query, limit) if isinstance(source, Index) else search(source, query, limit=limit, columns=columns)
