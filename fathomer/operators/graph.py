"""The call graph: neighbours, reverse references and bounded traversal.

Calls join on short names, so symbols of one name stand for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomer.workspace import written

#: Hops that are planned as one job; deeper walks are written between hops.
LAZY_HOPS = 4


def callees(edges: DataFrame, caller: str) -> DataFrame:
    """``name``: what a symbol calls, each once."""
    return edges.where(F.col("caller_symbol") == caller).select(F.col("callee_symbol").alias("name")).distinct()


def callers(edges: DataFrame, callee: str) -> DataFrame:
    """``name``: what calls a symbol, each once."""
    return edges.where(F.col("callee_symbol") == callee).select(F.col("caller_symbol").alias("name")).distinct()


def blast_radius(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The symbols whose name is that of a direct caller."""
    return symbols.join(callers(edges, name), "name", "left_semi")


def traverse(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Symbols reached from ``seeds`` (``id, name``) along calls, with the ``hop`` that first reached them.

    A depth of 0 or less is 3.  Cycles end, since a symbol is visited once.
    """
    depth = depth if depth > 0 else 3
    nodes = symbols.select("id", "name")
    calls = edges.select(F.col("caller_symbol").alias("name"), F.col("callee_symbol").alias("callee"))
    frontier = seeds.select("id", "name").distinct()
    visited = frontier.select("id", F.lit(0).alias("hop"))
    for hop in range(1, depth + 1):
        # Only the calls of the frontier are made distinct; a small frontier is broadcast to the edges.
        names = calls.join(frontier.select("name"), "name", "left_semi").select(F.col("callee").alias("name")).distinct()
        frontier = nodes.join(names, "name", "left_semi").join(visited, "id", "left_anti")
        if hop > LAZY_HOPS or depth > LAZY_HOPS:
            frontier = written(frontier, "frontier")
            if frontier.isEmpty():
                break
        visited = visited.union(frontier.select("id", F.lit(hop).alias("hop")))
        if depth > LAZY_HOPS:
            visited = written(visited, "visited")
    return symbols.join(visited, "id")
