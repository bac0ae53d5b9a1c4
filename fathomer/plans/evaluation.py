"""Evaluation of search: fixed queries, their first results, and latencies."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomer.operators.tables import percentiles
from fathomer.plans.tools import Tools


def evaluate(tools: Tools, queries: Sequence[str], *, mode: str = "hybrid", top: int = 5) -> DataFrame:
    """``query, rank, name, kind, file, seconds`` for the first results of each query."""
    rows = []
    for query in queries:
        began = time.perf_counter()
        found = tools.search(query, mode, top).orderBy("rank").select("rank", "name", "kind", "file").collect()
        seconds = time.perf_counter() - began
        rows += [(query, r["rank"], r["name"], r["kind"], r["file"], seconds) for r in found] or [(query, None, None, None, None, seconds)]
    return tools.spark.createDataFrame(rows, "query string, rank long, name string, kind string, file string, seconds double")


def latencies(results: DataFrame) -> DataFrame:
    """``p, value``: the 50th, 95th and 99th percentile of the queries' seconds."""
    return percentiles(results.select("query", "seconds").distinct(), "seconds", [50, 95, 99])


def judged(ranked: DataFrame, judgements: DataFrame, *, top: int = 5) -> DataFrame:
    """How good each query's result list is.

    ``ranked`` has ``query, rank, item``, ``judgements`` has ``query, item,
    grade`` (0 for what is of no use; items without a grade count as 0).
    Returns, for each query that has judgements, ``precision`` (of the first
    ``top``, those of some use), ``recall`` (of what is of use, how much is among
    them), ``reciprocal`` (of the rank of the first of use; 0 if there is none)
    and ``ndcg`` (gain discounted by the logarithm of the rank, over the best there
    can be).  A query without results has zeros.
    """
    useful = judgements.where("grade > 0")
    best = useful.groupBy("query").agg(F.sort_array(F.collect_list(F.col("grade").cast("double")), asc=False).alias("g"))
    discount = lambda i: F.log2(i + 2)
    ideal = F.aggregate(F.transform(F.slice("g", 1, top), lambda g, i: g / discount(i)), F.lit(0.0), lambda s, x: s + x)
    best = best.select("query", F.size("g").alias("useful"), ideal.alias("ideal"))
    hits = ranked.where(F.col("rank") <= top).join(useful.select("query", "item", F.col("grade").cast("double").alias("grade")), ["query", "item"])
    got = hits.groupBy("query").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(F.col("grade") / discount(F.col("rank") - 1)).alias("gain"))
    asked = judgements.select("query").distinct().join(best, "query", "left").join(got, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return asked.select(
        "query",
        zero(F.col("n") / top).alias("precision"),
        zero(F.col("n") / F.col("useful")).alias("recall"),
        zero(1.0 / F.col("first")).alias("reciprocal"),
        zero(F.col("gain") / F.col("ideal")).alias("ndcg"),
    )
