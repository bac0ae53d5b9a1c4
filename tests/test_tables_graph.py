"""Merges, deletions, look-ups, percentiles and the call graph on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomer.operators import graph, tables
from fathomer.plans.store import Store
from fathomer.schema import TABLES

EDGES = [("main", "Foo"), ("main", "Bar"), ("Foo", "Bar")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "caller_symbol string, callee_symbol string")


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_neighbours(edges):
    assert names(graph.callees(edges, "main")) == ["Bar", "Foo"]
    assert names(graph.callers(edges, "Bar")) == ["Foo", "main"]
    assert names(graph.callers(edges, "main")) == []


def nodes(spark, some):
    return spark.createDataFrame([(f"f:{n}", n) for n in some], "id string, name string")


def test_traverse_depths_and_blast_radius(spark):
    s = nodes(spark, ["Orchestrate", "DoStep", "Finalize", "Other"])
    e = spark.createDataFrame([("Orchestrate", "DoStep"), ("DoStep", "Finalize"), ("Finalize", "Orchestrate")], "caller_symbol string, callee_symbol string")
    seed = s.where("name = 'Orchestrate'")
    assert names(graph.traverse(s, e, seed, 1)) == ["DoStep", "Orchestrate"]
    hops = {r["name"]: r["hop"] for r in graph.traverse(s, e, seed, 2).collect()}
    assert hops == {"Orchestrate": 0, "DoStep": 1, "Finalize": 2}
    assert {r["name"]: r["hop"] for r in graph.traverse(s, e, seed, 9).collect()} == hops
    assert names(graph.blast_radius(s, e, "DoStep")) == ["Orchestrate"]
    assert names(graph.traverse(s, e, s.where("name = 'Other'"))) == ["Other"]


def test_traverse_equals_naive_search(spark):
    rng = random.Random(1)
    some = [f"n{i}" for i in range(30)]
    pairs = [(rng.choice(some), rng.choice(some)) for _ in range(60)]
    s, e = nodes(spark, some), spark.createDataFrame(pairs, "caller_symbol string, callee_symbol string")
    seen, frontier = {"n0": 0}, {"n0"}
    for hop in range(1, 7):
        frontier = {b for a, b in pairs if a in frontier} - seen.keys()
        seen |= dict.fromkeys(frontier, hop)
    assert {r["name"]: r["hop"] for r in graph.traverse(s, e, s.where("name = 'n0'"), 6).collect()} == seen


def tiny(spark):
    rows = {
        "files": [("a.go", "1", 1, "go"), ("b.go", "2", 1, "go")],
        "symbols": [("a.go:A:function", "a.go", "A", "function", "", "", 1, 2, "", "", 1), ("b.go:B:function", "b.go", "B", "function", "", "", 1, 2, "", "", 1)],
        "embeddings": [("a.go:A:function", "m", 1, [1.0]), ("b.go:B:function", "m", 1, [2.0])],
        "call_edges": [("a.go", "A", "", "Old", 1), ("b.go", "B", "", "A", 1)],
        "import_edges": [("a.go", "fmt"), ("b.go", "os")],
    }
    return {k: spark.createDataFrame(v, TABLES[k]) for k, v in rows.items()}


def test_replace_files(spark):
    old = tiny(spark)
    parsed = {
        "files": spark.createDataFrame([("a.go", "9", 2, "go")], TABLES["files"]),
        "symbols": spark.createDataFrame([("a.go:N:function", "a.go", "N", "function", "", "", 1, 2, "", "", 1)], TABLES["symbols"]),
        "call_edges": spark.createDataFrame([("a.go", "N", "", "New", 1)], TABLES["call_edges"]),
        "import_edges": spark.createDataFrame([], TABLES["import_edges"]),
    }
    new = tables.replace_files(old, parsed, spark.createDataFrame([("a.go",)], "path string"))
    assert names(new["symbols"]) == ["B", "N"]
    assert sorted(r["callee_symbol"] for r in new["call_edges"].collect()) == ["A", "New"]
    assert [r["symbol_id"] for r in new["embeddings"].collect()] == ["b.go:B:function"]
    assert [r["imported_path"] for r in new["import_edges"].collect()] == ["os"]
    assert tables.file_hash(new["files"], "a.go") == "9" and tables.file_hash(new["files"], "zz") == ""


@pytest.mark.parametrize(("keep", "edges_left"), [(False, 1), (True, 2)])
def test_delete_cascade(spark, keep, edges_left):
    left = tables.delete_files(tiny(spark), spark.createDataFrame([("b.go",)], "path string"), keep_orphan_edges=keep)
    assert names(left["symbols"]) == ["A"] and left["embeddings"].count() == 1
    assert left["call_edges"].count() == edges_left == left["import_edges"].count()


def test_upsert_takes_the_last_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, t int")
    got = {r["k"]: r["v"] for r in tables.upsert(old, new, ["k"], F.col("t")).collect()}
    assert got == {1: "a", 2: "y", 3: "z"}
    assert tables.upsert(old, new.limit(0), ["k"]).count() == 2


def test_lookups(spark):
    s = tiny(spark)["symbols"]
    assert names(tables.by_ids(s, ["a.go:A:function", "zz"])) == ["A"]
    assert tables.by_names(s, []).count() == 0
    assert tables.missing_embeddings(s, tiny(spark)["embeddings"], model="other").count() == 2


def test_percentiles_are_nearest_rank(spark):
    rng = random.Random(2)
    values = [float(rng.randint(0, 20)) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["p"]: r["value"] for r in tables.percentiles(df, "v", [1, 50, 95, 99, 100]).collect()}
    ordered = sorted(values)
    assert got == {p: ordered[-(-len(ordered) * p // 100) - 1] for p in (1, 50, 95, 99, 100)}


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    assert store.table("symbols").count() == 0
    store.replace(tiny(spark))
    before = store.table("symbols")
    store.delete_files(spark.createDataFrame([("a.go",)], "path string"))
    assert names(Store(spark, str(tmp_path / "index")).table("symbols")) == ["B"]
    assert names(before) == ["A", "B"]  # a reader keeps its version
    store.upsert("files", spark.createDataFrame([("b.go", "7", 3, "go")], TABLES["files"]))
    assert tables.file_hash(store.table("files"), "b.go") == "7"
    store.vacuum()
    assert names(store.table("symbols")) == ["B"]


def test_store_replaces_whole_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.replace(tiny(spark))
    before = store.version("files")
    store.replace({"symbols": spark.createDataFrame([("c.go:C:function", "c.go", "C", "function", "", "", 1, 2, "", "", 1)], TABLES["symbols"])})
    assert names(store.table("symbols")) == ["C"]  # no bucket of the old table is left
    assert store.version("files") == before and store.table("files").count() == 2
    store.replace({"symbols": store.table("symbols").limit(0)})
    store.vacuum()
    assert store.table("symbols").count() == 0


def test_connections_of_all_parts(spark, sf):
    from collections import Counter

    from fathomer.plans import catalogue

    parts = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    lines: dict = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        lines.setdefault((r.l_orderkey, r.l_linenumber), []).append(r.l_partkey)
    calls = {(one, two) for (order, n), found in lines.items() for one in found for two in lines.get((order, n + 1), [])}
    want = Counter(name for call in calls if set(call) <= parts for name in call)
    assert {r.name: r.connections for r in catalogue.QUERIES["connection_counts"](spark, sf).collect()} == want


def test_repeated_keys_keep_the_greatest_row(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "c"), (1, "a"), (2, None)], "k long, v string").repartition(4)
    assert sorted((r.k, r.v) for r in tables.last_by_key(rows, ["k"]).collect()) == [(1, "c"), (2, None)]


def test_judged_results_of_small_lists(spark):
    import math

    from fathomer.plans.evaluation import judged

    ranked = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "q")], "query string, rank long, item string")
    judgements = spark.createDataFrame([("a", "y", 2), ("a", "z", 0), ("a", "w", 1), ("b", "r", 1), ("c", "x", 1), ("d", "x", 0)], "query string, item string, grade int")
    out = {r["query"]: (r.precision, r.recall, r.reciprocal, r.ndcg) for r in judged(ranked, judgements, top=3).collect()}
    gain = 2 / math.log2(3)
    assert out["a"] == pytest.approx((1 / 3, 1 / 2, 1 / 2, gain / (2 + 1 / math.log2(3))))
    assert out["b"] == out["c"] == out["d"] == (0, 0, 0, 0)
