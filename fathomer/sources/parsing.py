"""Files to symbols: one parse of each file, three tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomer.functions.tiers import source_tier
from fathomer.sources.languages import Language, by_extension, by_file, language_of, registered
from fathomer.workspace import bounded_batches, written

_SYMBOL = (
    "struct<id string, name string, kind string, signature string, doc_comment string, start_line int, end_line int, "
    "receiver string, package string, snippet string, seq int>"
)
_CALL = "struct<caller_symbol string, callee_symbol string, line int, seq int>"
_PARSED = f"path string, lang string, symbols array<{_SYMBOL}>, calls array<{_CALL}>, imports array<struct<imported_path string, seq int>>, error string"


def routed(files: DataFrame) -> DataFrame:
    """The files that a language takes: by extension in lower case, then by exact name."""
    base = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    return files.where(ext.isin(*by_extension()) | base.isin(*by_file()))


def _parser(added: list[Language]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A parser of batches that also knows the languages that the driver has added."""
    return lambda parts: _parse(parts, added)


def _parse(parts: Iterator[pa.RecordBatch], added: list[Language]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for path, content in zip(part.column(0), part.column(1), strict=True):
            path, data = path.as_py(), content.as_py()
            language = language_of(path, added)
            if language is None:
                continue
            error, symbols, calls, imports = None, [], [], []
            try:
                found = language.parse((data or b"").decode("utf-8", "replace"), path)
            except Exception as problem:  # one file that no parser understands must not fail the job
                error = f"{type(problem).__name__}: {problem}"
            else:
                for seq, s in enumerate(found.symbols):
                    symbols.append(
                        {
                            "id": s.key(path), "name": s.name, "kind": s.kind, "signature": s.signature, "doc_comment": s.doc_comment,
                            "start_line": s.start_line, "end_line": s.end_line, "receiver": s.receiver, "package": s.package, "snippet": s.snippet, "seq": seq,
                        }
                    )
                calls = [{"caller_symbol": a, "callee_symbol": b, "line": n, "seq": i} for i, (a, b, n) in enumerate(found.calls)]
                imports = [{"imported_path": x, "seq": i} for i, x in enumerate(found.imports)]
            rows.append({"path": path, "lang": language.name, "symbols": symbols, "calls": calls, "imports": imports, "error": error})
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())


def _arrow_schema() -> pa.Schema:
    text, number = pa.string(), pa.int32()
    symbol = pa.struct(
        [("id", text), ("name", text), ("kind", text), ("signature", text), ("doc_comment", text), ("start_line", number), ("end_line", number),
         ("receiver", text), ("package", text), ("snippet", text), ("seq", number)]
    )
    call = pa.struct([("caller_symbol", text), ("callee_symbol", text), ("line", number), ("seq", number)])
    imported = pa.struct([("imported_path", text), ("seq", number)])
    return pa.schema([("path", text), ("lang", text), ("symbols", pa.list_(symbol)), ("calls", pa.list_(call)), ("imports", pa.list_(imported)), ("error", text)])


def parse_files(files: DataFrame, *, materialize: bool = True) -> dict[str, DataFrame]:
    """``symbols``, ``call_edges``, ``import_edges`` and ``parsed`` of ``files`` (``path, content``).

    Symbols carry their ``source_tier`` and a ``snippet`` that is not stored.
    Of symbols of equal id the last in the file stays; of equal edges, the first.
    ``parsed`` has a row a file, with the language and the error, if any.
    """
    bounded_batches(files.sparkSession)
    parsed = routed(files).select("path", "content").mapInArrow(_parser(registered()), _PARSED)
    parsed = written(parsed, "parsed") if materialize else parsed
    rows = parsed.select("path", F.explode("symbols").alias("s")).select(F.col("path").alias("file"), "s.*")
    keyed = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
    symbols = keyed.withColumn("source_tier", source_tier(F.col("file"))).select(
        "id", "file", "name", "kind", "signature", "doc_comment", "start_line", "end_line", "receiver", "package", "source_tier", "snippet", "seq"
    )
    calls = parsed.select("path", F.explode("calls").alias("c")).select(F.col("path").alias("caller_file"), "c.*")
    calls = calls.groupBy("caller_file", "caller_symbol", "callee_symbol", "line").agg(F.min("seq").alias("seq"))
    calls = calls.select("caller_file", "caller_symbol", F.lit("").alias("callee_file"), "callee_symbol", "line", "seq")
    imports = parsed.select("path", F.explode("imports").alias("i")).select(F.col("path").alias("importer_file"), "i.*")
    imports = imports.groupBy("importer_file", "imported_path").agg(F.min("seq").alias("seq"))
    return {"symbols": symbols, "call_edges": calls, "import_edges": imports, "parsed": parsed.select("path", "lang", "error")}
