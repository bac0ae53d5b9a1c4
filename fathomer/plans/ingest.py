"""Ingestion: files to tables, incrementally by content hash."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomer.functions.text import MAX_CALLS, MAX_IMPORTS, embed_text
from fathomer.operators import tables as ops
from fathomer.plans.store import Store
from fathomer.sources.embedders import Embedder, HashingEmbedder, ZeroEmbedder, embed_rows
from fathomer.sources.files import list_tree, read_tree, with_hash
from fathomer.sources.parsing import parse_files, routed
from fathomer.workspace import written


@dataclass
class IndexStats:
    files_indexed: int
    files_skipped: int
    symbols: int
    duration: float


def in_order(rows: DataFrame, keys: list, value: str) -> DataFrame:
    """``keys`` and the list ``<value>s``: the values of each key, in the order of ``seq``."""
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", value))), lambda x: x[value]).alias(value + "s"))


def first_different(rows: DataFrame, keys: dict[str, str], value: str, most: int) -> DataFrame:
    """The keys by their new names, and in the order of ``seq`` the first ``most`` different values of each that are not empty, for ``in_order``.

    A key may have very many values, so they are cut before they are listed.
    """
    named = [F.col(old).alias(new) for new, old in keys.items()]
    firsts = rows.where(F.col(value) != "").groupBy(*named, value).agg(F.min("seq").alias("first"))
    nth = Window.partitionBy(*keys).orderBy("first", value)
    return firsts.withColumn("seq", F.row_number().over(nth)).where(F.col("seq") <= most)


def enriched(symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``symbol_id, text``: symbols with snippet, callees and imports, in source order."""
    called = in_order(first_different(calls, {"file": "caller_file", "name": "caller_symbol"}, "callee_symbol", MAX_CALLS), ["file", "name"], "callee_symbol")
    imported = in_order(first_different(imports, {"file": "importer_file"}, "imported_path", MAX_IMPORTS), ["file"], "imported_path")
    joined = symbols.join(called, ["file", "name"], "left").join(imported, "file", "left")
    c = F.col
    text = embed_text(
        c("file"), c("kind"), c("name"), receiver=c("receiver"), signature=c("signature"), doc=c("doc_comment"), snippet=c("snippet"), calls=c("callee_symbols"), imports=c("imported_paths")
    )
    return joined.select(c("id").alias("symbol_id"), text.alias("text"))


def index_files(store: Store, seen: DataFrame, *, embedder: Embedder | None = None, force: bool = False) -> IndexStats:
    """Index the files of ``seen`` (``path, mod_time, content, content_hash``) that have changed."""
    began = time.monotonic()
    embedder = embedder or HashingEmbedder()
    seen = routed(seen)
    known = store.table("files")
    seen = written(seen, "seen")  # the files are read once
    changed = ops.changed_files(seen, known, force=force)
    touched = seen.join(known, ["path", "content_hash"]).where(seen["mod_time"] != known["mod_time"]).select("path", "content_hash", seen["mod_time"], known["lang"])
    total, indexed = seen.count(), changed.count()
    if not force and not touched.isEmpty():  # the same contents, written anew
        store.upsert("files", touched)
    count = 0
    if indexed:
        parsed = parse_files(changed)
        parsed["symbols"] = written(parsed["symbols"], "symbols")
        languages = parsed["parsed"].select("path", "lang")
        files = changed.join(languages, "path").select("path", "content_hash", "mod_time", "lang")
        store.replace_files({"files": files, **parsed}, changed.select("path"))
        count = parsed["symbols"].count()
        if not isinstance(embedder, ZeroEmbedder):
            texts = enriched(parsed["symbols"], parsed["call_edges"], parsed["import_edges"])
            store.upsert("embeddings", embed_rows(texts, embedder))
    return IndexStats(indexed, total - indexed, count, time.monotonic() - began)


def index_tree(spark: SparkSession, root: str, store: Store, *, embedder: Embedder | None = None, force: bool = False, hidden: bool = True) -> IndexStats:
    """Index what has changed below a root.  Files that are gone stay until ``reconcile``."""
    return index_files(store, with_hash(read_tree(spark, root, hidden=hidden)), embedder=embedder, force=force)


def reconcile(spark: SparkSession, root: str, store: Store, *, hidden: bool = True) -> int:
    """Delete the files that are no longer below a root; how many there were."""
    gone = written(ops.stale_files(store.table("files"), list_tree(spark, root, hidden=hidden)), "gone")
    count = gone.count()
    if count:
        store.delete_files(gone)
    return count


def backfill(store: Store, embedder: Embedder) -> int:
    """Embed the symbols that have no vector of this model, without snippet and calls; how many."""
    missing = written(ops.missing_embeddings(store.table("symbols"), store.table("embeddings"), model=embedder.model), "missing")
    c = F.col
    texts = missing.select(
        c("id").alias("symbol_id"),
        embed_text(c("file"), c("kind"), c("name"), receiver=c("receiver"), signature=c("signature"), doc=c("doc_comment")).alias("text"),
    )
    count = missing.count()
    if count:
        store.upsert("embeddings", embed_rows(texts, embedder))
    return count
