"""The five tables, as explicit schemas.

A missing string is the empty string, not null.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FILES = _struct(("path", _S), ("content_hash", _S), ("mod_time", _L), ("lang", _S))
SYMBOLS = _struct(
    ("id", _S), ("file", _S), ("name", _S), ("kind", _S), ("signature", _S), ("doc_comment", _S),
    ("start_line", _I), ("end_line", _I), ("receiver", _S), ("package", _S), ("source_tier", _I),
)
EMBEDDINGS = _struct(("symbol_id", _S), ("model", _S), ("dims", _I), ("vector", T.ArrayType(T.FloatType())))
CALL_EDGES = _struct(("caller_file", _S), ("caller_symbol", _S), ("callee_file", _S), ("callee_symbol", _S), ("line", _I))
IMPORT_EDGES = _struct(("importer_file", _S), ("imported_path", _S))
TABLES = {"files": FILES, "symbols": SYMBOLS, "embeddings": EMBEDDINGS, "call_edges": CALL_EDGES, "import_edges": IMPORT_EDGES}
#: The key of each table, by which rows are merged.
KEYS = {
    "files": ("path",),
    "symbols": ("id",),
    "embeddings": ("symbol_id",),
    "call_edges": ("caller_file", "caller_symbol", "callee_symbol", "line"),
    "import_edges": ("importer_file", "imported_path"),
}
#: The column that holds the file of a row.
FILE_COLUMN = {"files": "path", "symbols": "file", "call_edges": "caller_file", "import_edges": "importer_file"}

# The kinds of symbols.
KINDS = (
    "function", "method", "struct", "interface", "type", "const", "var", "field", "table", "view", "index", "trigger",
    "procedure", "section", "document", "element",
)
