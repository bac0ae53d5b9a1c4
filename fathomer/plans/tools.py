"""The five tools over one store: index, search, outline, traverse, blast radius."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomer.functions.text import line_range
from fathomer.operators import fts, graph, search, tables
from fathomer.plans.ingest import IndexStats, backfill, index_tree, reconcile
from fathomer.plans.store import Store
from fathomer.sources.embedders import Caching, Embedder, HashingEmbedder


def symbol_json(prefix: str = "") -> Column:
    """One symbol as results show it; doc, receiver and package only if there are any."""
    c = lambda name: F.col(prefix + name)
    some = lambda name: F.when(c(name) != "", c(name))
    return F.struct(
        c("file").alias("file"), c("name").alias("name"), c("kind").alias("kind"), c("signature").alias("signature"),
        line_range(c("start_line"), c("end_line")).alias("lines"), some("doc_comment").alias("doc"), some("receiver").alias("receiver"), some("package").alias("package"),
    )


def as_json(rows: DataFrame, *order: Column | str) -> str:
    """A bounded result as a JSON array, indented by two."""
    listed = [json.loads(r["j"]) for r in rows.orderBy(*order).select(F.to_json(symbol_json()).alias("j")).collect()]
    return json.dumps(listed, indent=2, ensure_ascii=False)


class Tools:
    def __init__(self, spark: SparkSession, store: Store, embedder: Embedder | None = None) -> None:
        self.spark, self.store = spark, store
        self.embedder = embedder or HashingEmbedder()
        self.embed = Caching(self.embedder)
        self._index: tuple[str, fts.Index] | None = None

    def index(self, root: str, *, force: bool = False, remove_gone: bool = False, hidden: bool = True) -> IndexStats:
        stats = index_tree(self.spark, root, self.store, embedder=self.embedder, force=force, hidden=hidden)
        if remove_gone:
            reconcile(self.spark, root, self.store, hidden=hidden)
        return stats

    def backfill(self) -> int:
        return backfill(self.store, self.embedder)

    def keywords(self) -> fts.Index:
        """The full-text index of the current symbols, rebuilt when they change."""
        version = self.store.version("symbols")
        if self._index is None or self._index[0] != version:
            self._index = (version, fts.Index.build(self.store.table("symbols")))
        return self._index[1]

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, *, strict: bool = True) -> DataFrame:
        t = self.store.tables()
        vectors = t["embeddings"].where(F.col("model") == self.embedder.model)
        return search.search(
            query, mode, symbols=t["symbols"], embeddings=vectors, tokens_of=self.keywords(), edges=t["call_edges"], embed=self.embed, limit=limit, strict=strict
        )

    def file_skeleton(self, path: str) -> DataFrame:
        if not path:
            raise ValueError("a path is needed")
        return tables.by_file(self.store.table("symbols"), path)

    def feature_traverse(self, query: str, depth: int = 3, *, seed: str = "exact") -> DataFrame:
        """What a symbol reaches.  Seeds are all symbols of the name, or, with ``fts10``, those among the ten best keyword hits."""
        if not query:
            raise ValueError("a query is needed")
        symbols = self.store.table("symbols")
        seeds = symbols.where(F.col("name") == query)
        if seed == "fts10":
            seeds = search.keyword_search(symbols, self.keywords(), query, 10).where(F.col("name") == query)
        return graph.traverse(symbols, self.store.table("call_edges"), seeds, depth)

    def blast_radius(self, symbol: str) -> DataFrame:
        if not symbol:
            raise ValueError("a symbol is needed")
        return graph.blast_radius(self.store.table("symbols"), self.store.table("call_edges"), symbol)

    def blast_radius_json(self, symbol: str) -> str:
        callers = json.loads(as_json(self.blast_radius(symbol), "file", "start_line", "id"))
        return json.dumps({"symbol": symbol, "callers": callers or None}, indent=2, ensure_ascii=False)
