"""Relational operators over the five tables: look-ups, merges and deletions.

All are pure: they take tables and return new ones.  ``plans.store`` keeps
versions of them on disk.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomer.schema import FILE_COLUMN, KEYS


def _listed(table: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose column is one of the values; none for an empty list."""
    values = list(dict.fromkeys(values))
    return table.where(F.col(column).isin(*values)) if values else table.limit(0)


def by_id(symbols: DataFrame, key: object) -> DataFrame:
    return symbols.where(F.col("id") == key)


def by_file(symbols: DataFrame, path: str) -> DataFrame:
    """The outline of a file, by line, then id."""
    return symbols.where(F.col("file") == path).orderBy("start_line", "id")


def by_ids(symbols: DataFrame, ids: Iterable) -> DataFrame:
    return _listed(symbols, "id", ids)


def by_names(symbols: DataFrame, names: Iterable[str]) -> DataFrame:
    return _listed(symbols, "name", names)


def file_hash(files: DataFrame, path: str) -> str:
    """The stored content hash of a file; empty if it is not indexed."""
    row = files.where(F.col("path") == path).select("content_hash").first()
    return row[0] if row else ""


def last_by_key(rows: DataFrame, keys: Iterable[str], order: Column | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, or, without one, the greatest by all columns, so that a rerun keeps the same."""
    keys = list(keys)
    order = F.struct(*rows.columns) if order is None else order
    window = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Iterable[str], order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    keys = list(keys)
    fresh = last_by_key(new, keys, order)
    if order is not None:
        fresh = fresh.select(*old.columns)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def replace_files(tables: dict[str, DataFrame], parsed: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """``tables`` with everything that the files ``paths`` (``path``) held replaced.

    ``parsed`` has the new ``files``, ``symbols``, ``call_edges`` and
    ``import_edges``.  Embeddings of symbols that are gone go too.
    """
    out = dict(tables)
    for name, column in FILE_COLUMN.items():
        kept = tables[name].join(paths.select(F.col("path").alias(column)), column, "left_anti").select(*tables[name].columns)
        out[name] = kept.unionByName(last_by_key(parsed[name], KEYS[name]).select(*kept.columns))
    out["embeddings"] = tables["embeddings"].join(out["symbols"].select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select(*tables["embeddings"].columns)
    return out


def delete_files(tables: dict[str, DataFrame], paths: DataFrame, *, keep_orphan_edges: bool = False) -> dict[str, DataFrame]:
    """``tables`` without the files ``paths``, their symbols and those symbols' embeddings.

    Edges go too, unless ``keep_orphan_edges``.
    """
    out = dict(tables)
    names = ("files", "symbols") if keep_orphan_edges else tuple(FILE_COLUMN)
    for name in names:
        column = FILE_COLUMN[name]
        out[name] = tables[name].join(paths.select(F.col("path").alias(column)), column, "left_anti").select(*tables[name].columns)
    gone = tables["symbols"].join(paths.select(F.col("path").alias("file")), "file", "left_semi").select(F.col("id").alias("symbol_id"))
    out["embeddings"] = tables["embeddings"].join(gone, "symbol_id", "left_anti").select(*tables["embeddings"].columns)
    return out


def missing_embeddings(symbols: DataFrame, embeddings: DataFrame, *, model: str | None = None) -> DataFrame:
    """Symbols without a vector (of the model, if one is named)."""
    done = embeddings if model is None else embeddings.where(F.col("model") == model)
    return symbols.join(done.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def changed_files(seen: DataFrame, files: DataFrame, *, force: bool = False) -> DataFrame:
    """Files of ``seen`` (``path, content_hash``) that are new or have other contents."""
    return seen if force else seen.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def stale_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Indexed paths that are no longer there."""
    return files.select("path").join(seen.select("path"), "path", "left_anti")


def first_by_key(rows: DataFrame, keys: Iterable[str], order: Column) -> DataFrame:
    """One row for each key, the first by ``order``: inserting and ignoring what is there."""
    window = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def percentiles(rows: DataFrame, value: str, ps: Iterable[float]) -> DataFrame:
    """``p, value`` by nearest rank: the element number ``ceil(n * p / 100)`` in order.

    Ranks come from counts of different values, summed range by range, so no
    task holds all values.
    """
    ps = [float(p) for p in ps]
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    totals = ranged.groupBy("part").agg(F.sum("n").alias("in_part"))
    before = totals.withColumn("before", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    upto = ranged.join(before.select("part", "before"), "part").withColumn("upto", F.col("before") + running)
    whole = counted.agg(F.sum("n").alias("total"))
    wanted = rows.sparkSession.createDataFrame([(p,) for p in ps], "p double").crossJoin(F.broadcast(whole))
    wanted = wanted.select("p", F.greatest(F.ceil(F.col("total") * F.col("p") / 100), F.lit(1)).alias("k"))
    hit = upto.join(F.broadcast(wanted), (F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
    return hit.select("p", "value")
