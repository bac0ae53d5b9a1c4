"""WARC archives: written by Spark's text writer, read by boundary-chain verification.

Writing.  A record is one string, so the text writer, with the record's closing
line breaks as line separator, writes archives that other tools can read, and
the commit protocol drops what lost tasks wrote.  Digests are counted first: a
page whose payload another page holds becomes a revisit record, which names that
page, the digest and the length, and holds no payload.  Pages are joined with
the digests that repeat and are shuffled only where those are many.

Reading.  The text reader splits files at the magic ``WARC/1.`` wherever it
begins a line, also inside payloads, so every piece between two magics is only a
candidate.  No line of a header begins so, and so no header is cut, whatever
its values hold.  Tasks emit, for each candidate, the offset of the record that must
follow it by its Content-Length.  The chain of offsets that begins at a file's
start is followed by pointer jumping, and only candidates on it are records:

*   within a block of a file, the task that reads it links the candidates and
    numbers the links' forest in depth-first order, so that "lies on the chain
    that enters here" is a comparison of numbers;
*   between blocks only the offsets where chains leave blocks remain (a few for
    each block), and jumping doubles the links over them until no offset is new.

A task hashes each byte twice at most: as part of its own piece, and of one
payload that goes on over several pieces.  What more candidates claim is hashed
only if they turn out to be records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomer.llm.arrow import tidy
from fathomer.workspace import bounded_batches, written

_MAGIC = b"WARC/1."
#: Where files are split.
_CUT = b"\n" + _MAGIC
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: So many digests that repeat are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Files of these names have other sizes than what is read from them.
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string or binary in upper-case base32, as archives write it."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_bytes: int = 0,
) -> None:
    """Write a record for each row; files lie in the folder ``path``.

    The payload is the column's bytes (null: empty).  Of rows with equal payloads
    of ``min_bytes`` or more, that of the largest id is a response and the others
    revisit it; smaller ones, rows without an id and rows that repeat the largest
    id are responses.  White space in an address is percent-encoded; without an
    address the record names its id as target.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    keyed = pages.select(own.alias("id"), F.octet_length(payload).alias("bytes"), base32_sha1(payload).alias("digest"))
    shared = keyed.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("id").alias("best"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1").select("digest", "best"), "warc-digests")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared

    rows = pages.select(own.alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("best").isNotNull() & (F.octet_length("payload") >= min_bytes) & F.col("id").isNotNull() & (F.col("id") != F.col("best"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    target = F.coalesce("url", F.concat(F.lit("urn:page:"), name))
    for code in (9, 10, 13, 32):
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(_END))
    rows = rows.select("digest", "best", revisit.alias("revisit"), name.alias("name"), target.alias("target"), http.alias("http"), "payload")
    held = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    said = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    header = F.concat_ws(
        "\r\n",  # which passes over nulls
        F.lit("WARC/1.1"),
        said("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        said("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("name"), F.lit(">"))),
        said("WARC-Target-URI", F.col("target")),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("revisit"), said("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("best").cast("string"), F.lit(">")))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {_PROFILE}")),
        said("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        said("Content-Length", (F.octet_length(held) + F.octet_length("http")).cast("string")),
    )
    rows.select(F.concat(header, F.lit(_END), F.col("http"), held).alias("value")).write.option("lineSep", _END).text(path)


_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
_LENGTH = re.compile(r"[0-9]{1,18}\Z")
_CANDIDATES = (
    "file string, block long, rel long, next_rel long, leaves boolean, pre long, post long, block_bytes long, limit long, after_rel long, "
    "record_id string, target string, type string, declared string, refers_to string, payload_bytes long, payload_digest string, body_rel long"
)


def _gap(chunk: bytes, start: int, stop: int) -> int:
    """Where an empty line ends a header; its last byte may be the first of the cut behind the chunk."""
    end = chunk.find(b"\r\n\r\n", start, stop)
    if end < 0 and chunk.endswith(b"\r\n\r") and start <= len(chunk) - 3 and len(chunk) < stop:
        end = len(chunk) - 3
    return end


def _fields(data: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data)}


def _header(chunk: bytes, limit: int) -> tuple[dict[str, str], int, int] | None:
    """The named fields of a chunk (what follows the magic), where its block begins and how long that is.

    None if this is no header, or its block is longer than the file.
    """
    end = _gap(chunk, 0, len(chunk) + 1)
    if end < 0 or chunk[1:3] != b"\r\n":
        return None
    fields = _fields(chunk[3:end])
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not _LENGTH.match(length) or int(length) > limit:
        return None
    return fields, end + 4, int(length)


def _base32(digest) -> str:  # noqa: ANN001
    return base64.b32encode(digest.digest()).decode()


class _Block:
    """The candidates of one block of a file, in the order of their offsets.

    Offsets are relative to where the block's first piece begins.
    """

    def __init__(self, file: str, start: int, size: int) -> None:
        self.file, self.start, self.at = file, start, 0
        self.limit = 1 << 60 if file.endswith(_PACKED) else size
        self.rows: list[dict] = []
        #: One candidate whose payload goes on: its row, the hash so far, the bytes that are left.
        self.open: tuple[dict, object, int] | None = None
        self.skip = 0  # bytes of the next cut that are none of that payload

    def _go_on(self, data: bytes) -> None:
        row, digest, left = self.open
        digest.update(memoryview(data)[:left])
        self.open = (row, digest, left - len(data))
        if left <= len(data):
            row["digest"], self.open = _base32(digest), None

    def add(self, chunk: bytes) -> None:
        """A piece between two cuts; the magic stands before it, but in a file's first piece."""
        magic = self.at - len(_MAGIC)
        first_of_file = self.start == 0 and self.at == 0
        if self.open and self.at:
            self._go_on(_CUT[self.skip :] + chunk)
        self.skip = 0
        self.at += len(chunk) + len(_CUT)
        if first_of_file:
            if not chunk.startswith(_MAGIC):
                return
            magic, chunk = 0, chunk[len(_MAGIC) :]
        parsed = _header(chunk, self.limit)
        if parsed is None:
            return
        fields, body, length = parsed
        row = {"magic": magic, "next": magic + len(_MAGIC) + body + length + len(_END), "type": fields["warc-type"], "digest": None}
        row |= {"id": fields.get("warc-record-id"), "target": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to")}
        row["declared"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        head, skip = body, 0
        if fields.get("content-type", "").lower().startswith("application/http"):
            head = _gap(chunk, body, body + length)
            skip = head + 4 - body if head >= 0 else length
        first, size = body + skip, length - skip
        row |= {"size": size, "body": magic + len(_MAGIC) + first}
        self.rows.append(row)
        if row["type"] == "revisit":  # the payload is the other record's
            told = _fields(chunk[body : max(head, body)]).get("content-length", "")
            row |= {"size": int(told) if _LENGTH.match(told) else None, "digest": row["declared"] or ""}
            return
        here = chunk[first : first + size]
        if len(here) == size:
            row["digest"] = _base32(hashlib.sha1(here))
        elif not self.open:
            self.open, self.skip = (row, hashlib.sha1(here), size - len(here)), max(0, first - len(chunk))

    def close(self) -> list[tuple]:
        """Link the candidates: where each one's chain leaves the block, and the forest's numbers."""
        index = {row["magic"]: i for i, row in enumerate(self.rows)}
        end = self.at - len(_MAGIC)
        parent = [index.get(row["next"]) for row in self.rows]
        size = [1] * len(self.rows)
        for i, p in enumerate(parent):
            if p is not None:
                size[p] += size[i]
        pre, free, out, leaves, exits = [0] * len(parent), [0] * len(parent), 0, [False] * len(parent), [0] * len(parent)
        for i in range(len(parent) - 1, -1, -1):
            p = parent[i]
            if p is None:
                pre[i], out = out, out + size[i]
                leaves[i], exits[i] = self.rows[i]["next"] >= end, self.rows[i]["next"]
            else:
                pre[i], free[p] = free[p], free[p] + size[i]
                leaves[i], exits[i] = leaves[p], exits[p]
            free[i] = pre[i] + 1
        told = ("next", "id", "target", "type", "declared", "refers", "size", "digest", "body")
        found = [(self.file, self.start, row["magic"], exits[i], leaves[i], pre[i], pre[i] + size[i] - 1, self.at, self.limit, *(row[k] for k in told)) for i, row in enumerate(self.rows)]
        return found or [(self.file, self.start, None, None, False, None, None, self.at, self.limit, *[None] * len(told))]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between cuts, as (file, block, size of the file, bytes), in the order of the file."""
    bounded_batches(spark)
    text = spark.read.option("lineSep", _CUT.decode()).option("recursiveFileLookup", "true").text(path)
    about = lambda name: F.col(f"_metadata.{name}")
    return text.select(about("file_path").alias("file"), about("file_block_start").alias("block"), about("file_size").alias("file_bytes"), F.col("value").cast("binary").alias("chunk"))


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CANDIDATES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in _CANDIDATES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    block = None
    for part in parts:
        for file, start, size, chunk in zip(*(part.column(i).to_pylist() for i in range(3)), part.column(3), strict=True):
            if block is None or (block.file, block.start) != (file, start):
                if block:
                    yield batch(block.close())
                block = _Block(file, start, size)
            block.add(chunk.as_py())
    if block:
        yield batch(block.close())


def _reached(candidates: DataFrame) -> DataFrame:
    """(file, offset) where the chain of each file enters blocks: pointer jumping."""
    leaving = candidates.where("leaves").select("file", F.col("exit").alias("node"))
    starts = candidates.select("file", F.lit(0).cast("long").alias("node"))
    nodes = leaving.union(starts).distinct()
    links = nodes.join(candidates.where("leaves").select("file", F.col("offset").alias("node"), F.col("exit").alias("next")), ["file", "node"])
    links, reached = written(links, "warc-links"), starts.distinct()
    known = 0
    while True:
        reached = written(reached.union(reached.join(links, ["file", "node"]).select("file", F.col("next").alias("node"))).distinct(), "warc-reached")
        now = reached.count()
        if now == known:
            return reached
        known = now
        far = links.select("file", F.col("node").alias("next"), F.col("next").alias("after"))
        links = written(links.join(far, ["file", "next"]).select("file", "node", F.col("after").alias("next")), "warc-links")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``.

    Returns ``file, offset, record_id, target, type, declared`` (the digest
    that the record names), ``refers_to`` (the id of the record that a revisit
    names), ``payload_bytes`` and ``payload_digest`` (of the payload as read; of a
    revisit, as its record says).  Bytes that are on no chain from their file's
    start, such as records inside payloads, are no records; a chain ends at the
    first offset where no record stands, and a record that the file's end cuts
    short is none.  Lengths that are no numbers or longer than the file make no
    record.
    """
    found = written(_pieces(spark, path).mapInArrow(tidy(_blocks), _CANDIDATES), "warc-candidates")
    sizes = found.groupBy("file", "block").agg(F.first("block_bytes").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "block", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    bases = written(bases, "warc-blocks")
    placed = {"offset": "rel", "exit": "next_rel", "after": "after_rel", "body": "body_rel"}
    found = written(
        found.where(F.col("rel").isNotNull()).join(bases.drop("bytes"), ["file", "block"]).withColumns({name: F.col("base") + F.col(rel) for name, rel in placed.items()}),
        "warc-chains",
    )
    reached = _reached(found)
    enters = found.join(reached.withColumnRenamed("node", "offset"), ["file", "offset"]).select("file", "block", F.col("pre").alias("at"))
    records = found.join(enters, ["file", "block"]).where((F.col("pre") <= F.col("at")) & (F.col("at") <= F.col("post")))
    records = records.where(F.col("after") <= F.col("limit") + len(_END))
    records = records.select("file", "offset", "record_id", "target", "type", "declared", "refers_to", "payload_bytes", "payload_digest", "body")
    return _completed(spark, path, bases, records).drop("body")


def _completed(spark: SparkSession, path: str, bases: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` with the digests of payloads that no task has read in one go.

    They go on in another block, or stand where a false candidate claims more;
    the pieces they consist of are read again and put together, one record a
    group.  Records do not overlap, so a piece is part of one.
    """
    records = written(records, "warc-records")
    open_ = records.where(F.col("payload_digest").isNull())
    if open_.isEmpty():
        return records
    spans = open_.select("file", "offset", "body", (F.col("body") + F.col("payload_bytes")).alias("stop")).join(bases, "file")
    spans = spans.where((F.col("base") < F.col("stop")) & (F.col("base") + F.col("bytes") > F.col("body"))).drop("bytes")
    spans = written(spans, "warc-open")
    cut = len(_CUT)

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for part in parts:
            rels = []
            for file, start, chunk in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if key != (file, start):
                    key, at = (file, start), 0
                rels.append(at)
                at += len(chunk.as_buffer()) + cut
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rels, pa.int64())], names=["file", "block", "chunk", "rel"])

    pieces = _pieces(spark, path).drop("file_bytes").mapInArrow(tidy(placed), "file string, block long, chunk binary, rel long").join(spans, ["file", "block"])
    at = F.col("base") + F.col("rel")
    bytes_ = F.concat(F.col("chunk"), F.lit(_CUT))
    inside = pieces.where((at < F.col("stop")) & (at + F.octet_length(bytes_) > F.col("body"))).select("file", "offset", "body", "stop", at.alias("at"), bytes_.alias("bytes"))

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        body, stop, at = (group[name][0].as_py() for name in ("body", "stop", "at"))
        digest, left = hashlib.sha1(), stop - body
        for i, part in enumerate(group["bytes"]):
            data = part.as_buffer()
            data = data[body - at :] if i == 0 else data
            digest.update(data[:left])
            left -= min(left, len(data))
        return pa.table({"file": [key[0].as_py()], "offset": [key[1].as_py()], "whole": [_base32(digest)]})

    whole = inside.groupBy("file", "offset").applyInArrow(joined, "file string, offset long, whole string")
    return records.join(whole, ["file", "offset"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "whole")).drop("whole")


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` for every record.

    A response is intact if its payload has the digest that it declares, if any;
    a revisit, if the response that it names was read and has the digest.
    """
    number = lambda name: F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
    rows = records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "declared")
    rows = written(rows, "warc-pages")
    said = rows.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    there = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    lost = said.join(there, ["refers_to", "payload_digest"], "left_anti").select(F.col("refers_to").alias("of"), F.col("payload_digest").alias("lost"))
    lost = written(lost, "warc-lost")
    same = F.coalesce(F.col("declared") == F.col("payload_digest"), F.lit(True))
    found = rows.join(lost, F.col("refers_to").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("lost")) & (F.col("record_type") == "revisit"), "left")
    intact = F.when(F.col("record_type") == "revisit", F.col("lost").isNull()).otherwise(same)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", intact.alias("intact"))
