"""Ranked retrieval: semantic, hybrid and keyword search, dedup and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomer.functions.text import extract_keywords
from fathomer.functions.tiers import tier_weight
from fathomer.functions.vector import cosine
from fathomer.operators import fts

RRF_K = 60
SEMANTIC_SHARE, KEYWORD_SHARE = 0.6, 0.4
OVERSELECT = 3


def at_least_one(limit: int) -> int:
    """A limit of 0 or less means 10."""
    return limit if limit > 0 else 10


def with_rank(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rank``, 1-based.  Only for rows that a limit has already bounded."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def dedup_by_name_kind(ranked: DataFrame) -> DataFrame:
    """The first row, by ``rank``, of each name and kind; ranks close up."""
    first = Window.partitionBy("name", "kind").orderBy("rank")
    kept = ranked.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    return with_rank(kept.withColumnRenamed("rank", "_old"), "_old").drop("_old")


def similarities(embeddings: DataFrame, query: Sequence[float], *, model: str | None = None) -> DataFrame:
    """``id, cosine`` of every vector."""
    rows = embeddings if model is None else embeddings.where(F.col("model") == model)
    return rows.select(F.col("symbol_id").alias("id"), cosine("vector", query).alias("cosine"))


def nearest(embeddings: DataFrame, query: Sequence[float], limit: int = 10, *, model: str | None = None, digits: int | None = None) -> DataFrame:
    """``id, cosine`` of the ``limit`` most similar vectors, ties by id; ``digits`` rounds first."""
    found = similarities(embeddings, query, model=model)
    if digits is not None:
        found = found.withColumn("cosine", F.round("cosine", digits))
    return found.orderBy(F.desc("cosine"), "id").limit(limit)


def semantic_search(
    symbols: DataFrame, embeddings: DataFrame, query: Sequence[float], limit: int = 10, *, model: str | None = None, digits: int | None = None, dedup: bool = True
) -> DataFrame:
    """Symbols by cosine similarity times tier weight: symbol columns, ``score``, ``rank``.

    Only the ``3 * limit`` rows of best raw similarity are weighted; a row
    below them never returns.  The list is cut to ``limit`` before duplicates
    go, so it may be shorter.  Ties go by id; ``digits`` rounds scores first.
    """
    limit = at_least_one(limit)
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    best = nearest(embeddings, query, OVERSELECT * limit, model=model, digits=digits)
    scored = symbols.join(F.broadcast(best), "id").withColumn("score", rounded(F.col("cosine") * tier_weight(F.col("source_tier"))))
    top = with_rank(scored.drop("cosine").orderBy(F.desc("score"), "id").limit(limit), F.desc("score"), "id")
    return dedup_by_name_kind(top) if dedup else top


def keyword_search(symbols: DataFrame, tokens_of: fts.Index | DataFrame, query: str, limit: int = 10, *, columns: tuple[str, ...] = fts.COLUMNS) -> DataFrame:
    """Symbols by BM25: symbol columns, ``score``, ``rank``."""
    hits = fts.find(tokens_of, query, limit=at_least_one(limit), columns=columns)
    return symbols.join(F.broadcast(hits), "id")  # ``limit`` rows


def with_symbols(symbols: DataFrame, hits: DataFrame) -> DataFrame:
    """All hits of a keyword search with their symbols' columns; hits may be many."""
    return symbols.join(hits, "id")


def cleaned(symbols: DataFrame, query: str) -> str:
    """The keywords of a query, as ``extract_keywords`` gives them."""
    return symbols.sparkSession.range(1).select(extract_keywords(F.lit(query)).alias("q")).first()["q"]


def fuse(semantic: DataFrame, keyword: DataFrame, *, absent: int) -> DataFrame:
    """``id, score``: reciprocal rank fusion; a list without the row ranks it ``absent``."""
    left = semantic.select("id", F.col("rank").alias("rs"))
    right = keyword.select("id", F.col("rank").alias("rf"))
    both = left.join(right, "id", "full_outer")
    part = lambda share, rank: share / (RRF_K + F.coalesce(rank, F.lit(absent)))
    return both.select("id", (part(F.lit(SEMANTIC_SHARE), F.col("rs")) + part(F.lit(KEYWORD_SHARE), F.col("rf"))).alias("score"))


def hybrid_search(
    symbols: DataFrame,
    embeddings: DataFrame,
    tokens_of: fts.Index | DataFrame,
    vector: Sequence[float],
    query: str,
    limit: int = 10,
    *,
    strict: bool = True,
    columns: tuple[str, ...] = fts.COLUMNS,
    digits: int | None = None,
    model: str | None = None,
) -> DataFrame:
    """Fusion of the semantic and the keyword list of ``3 * limit`` rows each.

    The keyword side takes the query's keywords.  Keywords that the query
    language does not allow (``a-b``) leave that side empty if ``strict``;
    otherwise they are searched as phrases.
    """
    limit = at_least_one(limit)
    wide = OVERSELECT * limit
    terms = cleaned(symbols, query)
    if not strict:
        terms = " ".join('"' + t + '"' for t in terms.split())
    try:
        found = fts.find(tokens_of, terms, limit=wide, columns=columns)
    except fts.QueryError:
        found = fts.find(tokens_of, "", limit=wide, columns=columns)
    semantic = semantic_search(symbols, embeddings, vector, wide, digits=digits, model=model)
    fused = fuse(semantic, found, absent=wide + 100)
    if digits is not None:
        fused = fused.withColumn("score", F.round("score", digits))
    best = fused.orderBy(F.desc("score"), "id").limit(limit)
    top = with_rank(symbols.join(F.broadcast(best), "id"), F.desc("score"), "id")
    return dedup_by_name_kind(top)


def connections(names: DataFrame, edges: DataFrame) -> DataFrame:
    """``name, connections``: ends of different calls among the names; a call to itself counts twice."""
    some = names.select("name").distinct()
    inside = (
        edges.select(F.col("caller_symbol").alias("caller"), F.col("callee_symbol").alias("callee"))
        .join(some.withColumnRenamed("name", "caller"), "caller", "left_semi")
        .join(some.withColumnRenamed("name", "callee"), "callee", "left_semi")
        .distinct()
    )
    ends = inside.select(F.explode(F.array("caller", "callee")).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("connections"))


def rerank_by_call_graph(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """A result list with well-connected rows moved up.

    The row at 0-based position ``i`` goes to priority ``i - 2 *
    connections``; equal priorities keep their order.
    """
    counts = connections(ranked, edges)
    joined = ranked.join(counts, "name", "left").withColumn("_i", F.col("rank") - 1)
    joined = joined.withColumn("_p", F.col("_i") - 2 * F.coalesce("connections", F.lit(0)))
    return with_rank(joined.drop("rank"), "_p", "_i").drop("_p", "_i", "connections")


def search(
    query: str,
    mode: str,
    *,
    symbols: DataFrame,
    embeddings: DataFrame,
    tokens_of: fts.Index | DataFrame,
    edges: DataFrame,
    embed: Callable[[str], Sequence[float]],
    limit: int = 10,
    strict: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """Search in one of three modes, re-ranked by the call graph.

    ``hybrid`` (the default for an empty mode) falls back to keyword search
    with the raw query where embedding fails; ``semantic`` passes the error on.
    """
    mode = mode or "hybrid"
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    if not query:
        raise ValueError("a query is needed")
    if mode == "semantic":
        out = semantic_search(symbols, embeddings, embed(query), limit, digits=digits)
    elif mode == "hybrid":
        try:
            vector = embed(query)
        except Exception:  # any failure of a remote model leaves keyword search
            out = keyword_search(symbols, tokens_of, query, limit)
        else:
            out = hybrid_search(symbols, embeddings, tokens_of, vector, query, limit, strict=strict, digits=digits)
    else:
        out = keyword_search(symbols, tokens_of, query, limit)
    return rerank_by_call_graph(out, edges)
