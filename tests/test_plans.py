"""What the optimizer makes of the operators: pushed filters, pruned columns, bounded sorts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomer.operators import graph, search, tables
from fathomer.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def written_symbols(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("symbols") / "t")
    catalogue.symbols(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_file_filter_reaches_the_scan_and_columns_are_pruned(written_symbols):
    text = plan(tables.by_file(written_symbols, "src3").select("id", "name", "start_line"))
    assert "EqualTo(file,src3)" in text and "doc_comment" not in text


def test_name_lists_reach_the_scan(written_symbols):
    assert "In(name, [la,the])" in plan(tables.by_names(written_symbols, ["the", "la"]))


def test_semantic_search_sorts_only_what_it_keeps(spark, sf):
    text = plan(search.similarities(catalogue.vectors(spark, sf), [1.0] * 64).orderBy(F.desc("cosine"), "id").limit(30))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text and "Python" not in text


def test_missing_embeddings_is_a_plain_anti_join(spark, sf):
    text = plan(tables.missing_embeddings(catalogue.symbols(spark, sf), catalogue.vectors(spark, sf)).select("id"))
    assert "LeftAnti" in text and "BroadcastNestedLoopJoin" not in text and "doc_comment" not in text


def test_traversal_has_no_nested_loops(spark, sf):
    nodes = catalogue.parts(spark, sf)
    text = plan(graph.traverse(nodes, catalogue.calls(spark, sf), nodes.where("id = 1"), 3))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["keyword_search", "semantic_topk", "source_tier", "extract_keywords", "debounce_sessions", "replace_by_file"])
def test_hot_paths_stay_in_the_jvm(spark, sf, name):
    assert "Python" not in plan(catalogue.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["documents", "pages", "customer", "supplier"])
def test_tables_that_python_works_on_are_dealt_over_all_cores(name, spark, sf):
    assert catalogue._t(spark, sf, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
