"""Packing: documents into training sequences of a fixed number of tokens.

Harmonic packing.  A document is cut into whole sequences and a rest, and the
rest greedily into pieces of exactly ``capacity // k`` tokens for the smallest
``k`` that fits, so that pieces fall into reciprocal-capacity classes.  A bin of
class ``k`` takes exactly ``k`` pieces, so a bin is full by count alone and no
search is needed; tails below ``capacity // CLASSES`` form a last class that is
filled next-fit, cutting at the edge.  Every worker fills its own bins, and no
row is shuffled: sequence ids carry the worker's number.

At its end a worker takes the pieces of its open bins (at most one bin a class)
and runs them together into whole sequences; what is left over is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fathomer.llm.arrow import tidy
from fathomer.workspace import bounded_batches

CAPACITY = 1024
#: The classes 1..CLASSES-1 have bins of a fixed count; shorter tails are filled next-fit.
CLASSES = 16
#: Runs without a break that are longer go to the library that is linear in them.
_LONG_RUN = re.compile(r"\S{2048}|\s{2048}")
_SPECIAL = "<|endoftext|>"
#: The split pattern of byte-level BPE with this vocabulary (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from U+0100 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as ``tokenizers`` gives them for a byte-level BPE file.

    The same vocabulary is also loaded into ``tiktoken``, which gives the same
    ids several times faster but takes quadratic time on long unbroken runs;
    texts with such runs go to ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, added = _byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
        self._path, self._library = path, None
        self._fast = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added) if set(added) == {_SPECIAL} else None

    def _slow(self, text: str) -> list[int]:
        if self._library is None:  # few workers meet such a text, and the library takes much memory
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if self._fast is None or _LONG_RUN.search(text):
            return np.array(self._slow(text), np.uint32)
        if _SPECIAL in text:
            return np.array(self._fast.encode(text, allowed_special="all"), np.uint32)
        return self._fast.encode_to_numpy(text, disallowed_special=()) if hasattr(self._fast, "encode_to_numpy") else np.array(self._fast.encode_ordinary(text), np.uint32)


def cuts(length: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document; class ``classes`` is the tail's."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = -(-capacity // rest)
        k -= k > 1 and capacity // (k - 1) <= rest  # the smallest k with capacity // k <= rest
        if k >= classes:
            out.append((classes, rest))
            break
        size = capacity // k
        out.append((k, size))
        rest -= size
    return out


class Packer:
    """The bins of one worker.  ``add`` and ``close`` return pieces as tuples

    (document, start, length, tokens, sequence, offset).
    """

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, classes: int = CLASSES) -> None:
        self.capacity, self.classes, self.next = capacity, classes, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.used: dict[int, int] = {}

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self._sequence(), 0
        for doc, start, tokens in pieces:
            yield doc, start, len(tokens), tokens, sequence, offset
            offset += len(tokens)

    def _put(self, k: int, piece: tuple) -> Iterator[tuple]:
        held = self.open.setdefault(k, [])
        held.append(piece)
        if k < self.classes:
            if len(held) == k:
                yield from self._emit(self.open.pop(k))
            return
        used = self.used.get(k, 0) + len(piece[2])
        if used >= self.capacity:
            doc, start, tokens = held.pop()
            fits = len(tokens) - (used - self.capacity)
            yield from self._emit([*held, (doc, start, tokens[:fits])])
            self.open[k] = [(doc, start + fits, tokens[fits:])] if used > self.capacity else []
            used -= self.capacity
        self.used[k] = used

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        for k, size in cuts(len(ids), self.capacity, self.classes):
            piece = ids[at : at + size]
            yield from self._put(k, (doc, at, piece if k == 1 else piece.copy()))  # an open bin must not hold a whole document
            at += size

    def close(self) -> Iterator[tuple]:
        """The pieces of open bins run together; the last ones fill powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open, self.used = {}, {}
        left = sum(len(p[2]) for p in rest)
        while left:
            size = room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            filled = []
            while room:
                doc, start, tokens = rest.pop(0)
                if len(tokens) > room:
                    rest.insert(0, (doc, start + room, tokens[room:]))
                    tokens = tokens[:room]
                filled.append((doc, start, tokens))
                room -= len(tokens)
            yield from self._emit(filled)
            left -= size


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every token of every document, in exactly one piece.

    A document's tokens are the ids of its whole text (null: empty) and one 0
    after them.  Returns a row a piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.  ``vocabulary`` is the path of the
    tokenizer's file, the same on all workers.  Each row is a document of its
    own, so repeated and null ids are packed as they come; other columns are
    not read, and an empty table gives no pieces.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)  # a third of a second a task; kept, it would take 20 MB of every idle worker
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)
        end = np.zeros(1, np.uint32)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        def take(pieces: Iterator[tuple]) -> None:
            for (doc, total), start, length, ids, sequence, offset in pieces:
                rows.append((doc, start, length, zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

        for part in parts:
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                ids = np.concatenate([encode.ids(text.as_py() or ""), end])
                take(packer.add((doc.as_py(), len(ids)), ids))
                if len(rows) >= 50_000:
                    yield batch()
        take(packer.close())
        yield batch()

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(batches), schema)
