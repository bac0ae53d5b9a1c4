"""Synthetic source trees, the same for the same seed: test and benchmark input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("go", "java")


def _pick(seed: int, salt: str, low: int, high: int) -> Column:
    """A number from ``low`` to ``high``, by file and salt."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
    return (drawn % (high - low + 1) + low).cast("int")


# Expressions over the number of a file (id), of a type (i) or a member (j), and how many there are.
_GO_METHODS = "concat_ws('\\n', transform(sequence(1, m), j -> concat('// Do', j, ' works.\\nfunc (t *Type', id, '_', i, ') Do', j, '() int { return Helper', id, '_', j, '() }\\n')))"
_GO_TYPE = "concat('// Type', id, '_', i, ' holds state.\\ntype Type', id, '_', i, ' struct { n int }\\n\\n')"
_GO_FUNCTIONS = (
    "concat_ws('\\n', transform(sequence(1, f), j -> concat('// Helper', id, '_', j, ' helps.\\nfunc Helper', id, '_', j, '() int { return ', "
    "if(j < f, concat('Helper', id, '_', j + 1, '()'), '0'), ' }\\n')))"
)
_JAVA_METHODS = "concat_ws('\\n', transform(sequence(1, m), j -> concat('    int do', j, '() { return helper', id, '_', j, '(); }')))"
_JAVA_TYPE = "concat('/** Type', id, '_', i, ' holds state. */\\nclass Type', id, '_', i, ' {\\n')"
_JAVA_FUNCTIONS = (
    "concat('final class Helpers', id, ' {\\n', concat_ws('\\n', transform(sequence(1, f), j -> concat('    static int helper', id, '_', j, '() { return ', "
    "if(j < f, concat('helper', id, '_', j + 1, '()'), '0'), '; }'))), '\\n}\\n')"
)
# language: (what a file begins with, a type's beginning, its methods, its end, the functions)
_PARTS = {
    "go": ("concat('package pkg', id % 10, '\\n\\n')", _GO_TYPE, _GO_METHODS, "''", _GO_FUNCTIONS),
    "java": ("concat('package pkg', id % 10, ';\\n\\n')", _JAVA_TYPE, _JAVA_METHODS, "'\\n}\\n'", _JAVA_FUNCTIONS),
}


def source_files(ids: DataFrame, language: str, *, seed: int = 42) -> DataFrame:
    """A file for each ``id``: ``path, mod_time, content``, with 2-4 types of 2-4 methods, and 3-7 functions that call each other."""
    begin, opening, methods, closing, functions = _PARTS[language]
    rows = ids.select("id").withColumns({"t": _pick(seed, "types", 2, 4), "m": _pick(seed, "methods", 2, 4), "f": _pick(seed, "functions", 3, 7)})
    one_type = f"concat({opening}, {methods}, {closing})".replace("'_', i,", "'_', x,").replace(", i,", ", x,")
    types = F.expr(f"concat_ws('\\n', transform(sequence(1, t), x -> {one_type}))")
    content = F.concat(F.expr(begin), types, F.lit("\n"), F.expr(functions))
    path = F.expr(f"concat('pkg', id % 10, '/file', id, '.{language}')")
    return rows.select(path.alias("path"), F.lit(0).cast("long").alias("mod_time"), content.cast("binary").alias("content"))


def go_files(spark: SparkSession, count: int, *, seed: int = 42) -> DataFrame:
    """``count`` Go files."""
    return source_files(spark.range(count), "go", seed=seed)
