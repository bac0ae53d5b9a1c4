"""Benchmark decontamination: item-sized windows, SimHash, exact similarity.

A document is contaminated if one of its windows, as many words long as a
benchmark item, has a shingle similarity of 0.8 or more with the item, weighted
(what many items share counts less) or plain.
Of a document that has fewer words than the item, the whole is the one window.

*   Windows are fingerprinted by SimHash over their word shingles, plain and,
    where items of their length share shingles with others, weighted too.  Those that hold too few benchmark shingles to reach the similarity with any
    item of their length (an exact bound) are passed over.
*   A multi-index over the items' fingerprints finds the candidates: cut into
    ``RADIUS + 1`` blocks, two fingerprints within ``RADIUS`` bits agree in one
    block at least, so looking up every block misses none within the radius.
*   The exact Jaccard similarity of the shingle multisets decides.

The benchmark goes to the workers in blocks of ``BLOCK`` items or ``BLOCK_BYTES``
of text, one pass over the documents for each block, so what is broadcast is
bounded at any benchmark size.  Documents are taken whole, one by one; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomer.llm.arrow import tidy
from fathomer.llm.hashing import mixed, shingles, word_hashes
from fathomer.workspace import bounded_batches, written

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
#: Shingles enter fingerprints by the roots of their weights.  So the cosine of a window and an item is ``S / sqrt(A * B)``,
#: of the shared weight and both totals, and where ``S / (A + B - S)`` is 0.8 it is 8 / 9 or more, whatever the weights are:
#: fingerprints then differ in at most 19.4 bits on average, with a deviation of 4.1.
RADIUS = 36
#: Items broadcast at a time, and bytes of their texts, on average.
BLOCK, BLOCK_BYTES = 20_000, 64 << 20


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the BITS bits of each shingle."""
    halves = np.stack([hashes, mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def block_edges() -> list[tuple[int, int]]:
    """The RADIUS + 1 blocks of a fingerprint, as ranges of bits."""
    edges = np.linspace(0, BITS, RADIUS + 2).astype(int)
    return list(zip(edges[:-1], edges[1:], strict=True))


def _places() -> np.ndarray:
    """What each bit adds to the value of its block."""
    out = np.zeros((BITS, RADIUS + 1), np.float32)
    for k, (a, b) in enumerate(block_edges()):
        out[a:b, k] = 1 << np.arange(b - a)
    return out


_PLACES = _places()
_VALUES = 1 << max(b - a for a, b in block_edges())


def _block_values(bits: np.ndarray) -> np.ndarray:
    """The value of each block, for each fingerprint of a 0/1 matrix."""
    return (bits.astype(np.float32) @ _PLACES).astype(np.intp)


@dataclass
class _Class:
    """Items of one length."""

    words: int
    size: int
    items: list[int] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    #: Whether all shingles weigh 1, so that weighted and plain similarities are the same.
    even: bool = True
    #: Fingerprints and multi-index (for each block and value, which items have it), plain and, if not even, weighted.
    prints: list[np.ndarray] = field(default_factory=list)
    index: list[np.ndarray] = field(default_factory=list)


class Index:
    """The fingerprints and shingles of a block of items.

    ``spread`` tells how many different texts of the whole benchmark hold a shingle;
    without it the block is the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], spread: dict[int, int] | None = None) -> None:
        split = [(k, h) for k, text in items if len(h := word_hashes(text))]
        found = [(k, len(h), shingles(h, min(SHINGLE, len(h)))) for k, h in split]
        if spread is None:
            texts = {h.tobytes(): s for (_, h), (_, _, s) in zip(split, found, strict=True)}
            spread = Counter(x for s in texts.values() for x in set(s.tolist()))
        #: A shingle that many texts share says less about each.
        self.weights = {x: 1.0 / n for x, n in spread.items()}
        self.classes: dict[int, _Class] = {}
        for key, n, s in found:
            c = self.classes.setdefault(n, _Class(n, min(SHINGLE, n)))
            counts = Counter(s.tolist())
            c.items.append(key)
            c.counts.append(counts)
            c.totals.append(sum(self.weights[x] * m for x, m in counts.items()))
        for c in self.classes.values():
            c.even = all(self.weights[x] == 1.0 for m in c.counts for x in m)
            for weighted in (False,) if c.even else (False, True):
                sums = np.stack([(_signs(np.fromiter(m, np.uint64, len(m))) * np.array([self.weights[x] ** 0.5 * v if weighted else v for x, v in m.items()])[:, None]).sum(axis=0) for m in c.counts])
                c.prints.append(_packed(sums))
                index = np.zeros((RADIUS + 1, _VALUES, len(c.items)), bool)
                for i, row in enumerate(_block_values((sums > 0).astype(int))):
                    index[np.arange(RADIUS + 1), row, i] = True
                c.index.append(index)
        self.sizes = sorted({c.size for c in self.classes.values()})
        self.known = {k: np.array(sorted({x for c in self.classes.values() if c.size == k for m in c.counts for x in m}), np.uint64) for k in self.sizes}
        self.known_weights = {k: np.array([self.weights[x] for x in v.tolist()]) for k, v in self.known.items()}
        self.sieve = {}
        for k, v in self.known.items():
            self.sieve[k] = np.zeros(1 << 20, bool)
            self.sieve[k][v >> np.uint64(44)] = True

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item found."""
        hashes = word_hashes(text)
        out: dict[tuple[int, int], tuple[float, int]] = {}
        for size in self.sizes:
            s = shingles(hashes, size)
            maybe = np.flatnonzero(self.sieve[size][s >> np.uint64(44)])
            if not len(maybe):
                continue
            place = np.minimum(np.searchsorted(self.known[size], s[maybe]), len(self.known[size]) - 1)
            hit = self.known[size][place] == s[maybe]
            if not hit.any():
                continue
            found, weight = np.zeros(len(s)), np.ones(len(s))
            weight[maybe[hit]] = found[maybe[hit]] = self.known_weights[size][place[hit]]
            before = np.concatenate([[0.0], np.cumsum(found)])
            number = np.zeros(len(s) + 1)
            number[maybe[hit] + 1] = 1
            number = np.cumsum(number)
            for c in self.classes.values():
                if c.size == size:
                    self._in_class(c, s, weight, before, number, out)
        return [(c.items[i], sim, at, min(c.words, len(hashes))) for (n, i), (sim, at) in sorted(out.items()) for c in (self.classes[n],)]

    def _in_class(self, c: _Class, s: np.ndarray, weight: np.ndarray, before: np.ndarray, number: np.ndarray, out: dict) -> None:
        whole = c.words - c.size + 1
        span = min(whole, len(s))
        # S / (A + B - S) of 0.8 or more asks for S of 0.8 / 1.8 * (A + B), and so for 0.8 * A.
        enough = number[span:] - number[:-span] >= SIMILARITY / (1 + SIMILARITY) * (whole + span) - 1e-9
        if not c.even:
            enough |= before[span:] - before[:-span] >= SIMILARITY * min(c.totals) - 1e-9
        starts = np.flatnonzero(enough)
        if not len(starts):
            return
        # The signs are summed along each stretch of neighbouring windows.
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            step = max(1, (1 << 21) // len(c.items))
            for at in range(0, len(part), step):
                self._in_run(c, s, weight, part[at : at + step], out)

    def _in_run(self, c: _Class, s: np.ndarray, weight: np.ndarray, run: np.ndarray, out: dict) -> None:
        """Windows that begin at ``run``: fingerprints, candidates, similarities."""
        span = min(c.words - c.size + 1, len(s))
        lo, hi = run[0], run[-1] + span
        signs = _signs(s[lo:hi])
        near = np.zeros((len(run), len(c.items)), bool)
        for weighted, (prints, index) in enumerate(zip(c.prints, c.index, strict=True)):
            sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(signs * np.sqrt(weight[lo:hi, None]) if weighted else signs, axis=0)])
            bits = sums[run - lo + span] > sums[run - lo]
            values = _block_values(bits)
            agree = np.zeros((len(run), len(c.items)), bool)
            for block in range(RADIUS + 1):
                agree |= index[block, values[:, block]]
            window, item = np.nonzero(agree)
            apart = np.unpackbits(np.packbits(bits, axis=1)[window] ^ prints[item], axis=1).sum(axis=1)
            near[window, item] |= apart <= RADIUS
        counts, last = Counter(), -1
        for w, i in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            start = int(run[w])
            if w != last:
                counts, last = Counter(s[start : start + span].tolist()), w
            sim = self._similarity(counts, c.counts[i])
            if sim >= SIMILARITY - 1e-12 and sim > out.get((c.words, i), (0.0, 0))[0]:
                out[c.words, i] = (sim, start)

    def _similarity(self, a: Counter, b: Counter) -> float:
        """Jaccard of a window and an item, weighted (shingles that the item lacks weigh 1) or plain, whichever is more."""
        shared = total = 0.0
        same = both = 0
        for x in a.keys() | b.keys():
            m, n = a.get(x, 0), b.get(x, 0)
            w = self.weights[x] if n else 1.0
            shared += w * min(m, n)
            total += w * max(m, n)
            same += min(m, n)
            both += max(m, n)
        return max(shared / total, same / both)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """The benchmark items that documents hold.

    Returns ``doc_id, item_id, similarity`` (of the best window, rounded to six
    digits), ``first_word`` (0-based) and ``n_words``.  Words are runs of
    characters other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; shingles
    have five words, and an item of fewer words is one shingle.  Items and
    documents without words match nothing.  Each row of ``docs`` is a document
    of its own; repeated items are found each.  Empty tables give no rows.
    """
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    figures = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-figures["n"] // block), -(-figures["size"] // BLOCK_BYTES))
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = written(_shingles_of(items).distinct().groupBy("shingle").agg(F.count("*").alias("n")), "benchmark-shingles") if blocks > 1 else None
    found = None
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number)
        # One block's items and shingles reach the driver, and from there the workers.
        counts = None if held is None else {r["shingle"] & _ALL: r["n"] for r in held.join(_shingles_of(part).select("shingle").distinct(), "shingle").collect()}
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["id"], r["text"]) for r in part.collect()], counts))
        here = texts.mapInArrow(tidy(_matcher(shared)), schema)
        found = here if found is None else found.union(here)
    return found


_ALL = (1 << 64) - 1


def _shingles_of(items: DataFrame) -> DataFrame:
    """``shingle, words``: each item's different shingles, a row each, and a hash of all its words."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in part.column(0):
                h = word_hashes(text.as_py())
                found = np.unique(shingles(h, min(SHINGLE, max(1, len(h))))).view(np.int64)
                words = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([words] * len(found), pa.binary())], names=["shingle", "words"])

    return items.select("text").mapInArrow(batches, "shingle long, words binary")


#: The index of the block that this worker had last, by the name that the block carries.
_last: dict[str, Index] = {}


def _index_of(name: str, items: list[tuple[int, str]], spread: dict[int, int] | None) -> Index:
    if name not in _last:
        _last.clear()
        _last[name] = Index(items, spread)
    return _last[name]


def _matcher(shared):  # noqa: ANN001, ANN202
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(*shared.value)
        for part in parts:
            rows = [(doc.as_py(), item, round(sim, 6), at, n) for doc, text in zip(part.column(0), part.column(1), strict=True) for item, sim, at, n in index.matches(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"]
            )

    return batches


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns of ``docs``.

    Rows that share an id with a contaminated row go too; rows without an id stay.
    """
    hits = written(find_matches(docs, benchmark, id_col=id_col).select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    return docs.join(hits, docs[id_col].cast("long") == hits["__hit"], "left_anti")
