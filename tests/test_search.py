"""Full-text queries, BM25, fusion, dedup and re-ranking against small known answers."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomer.operators import fts, search

TEXTS = {
    "a": ("ParseConfig", "func ParseConfig(path string)", "Reads the pod affinity file of the net"),
    "b": ("WriteOutput", "func WriteOutput()", "Writes pod output for affinity to the net http server"),
    "c": ("HandleLogin", "func HandleLogin()", "Handles a login of the café"),
    "d": ("Handle", "", ""),
}


@pytest.fixture(scope="module")
def rows(spark):
    return fts.tokenized(spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id string, name string, signature string, doc_comment string")).cache()


@pytest.fixture(scope="module")
def index(spark):
    return fts.Index.build(spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id string, name string, signature string, doc_comment string"))


def found(rows, query, limit=10):
    return [r["id"] for r in fts.search(rows, query, limit=limit).orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("ParseConfig", {"a"}),
        ("DefinitelyAbsent9999", set()),
        ("pod absent", set()),
        ("pod affinity", {"a", "b"}),
        ('"pod affinity"', {"a"}),
        ("pod_affinity", {"a"}),
        ("pod + affinity", {"a"}),
        ("pod NOT login", {"a", "b"}),
        ("pod NOT output", {"a"}),
        ("login OR output", {"b", "c"}),
        ("Handle", {"d"}),
        ("Handle*", {"c", "d"}),
        ("name : handle*", {"c", "d"}),
        ("doc_comment : handle*", {"c"}),
        ("{name signature} : writeoutput", {"b"}),
        ("- doc_comment : login", set()),
        ("^reads", {"a"}),
        ("^pod", set()),
        ("CAFE", {"c"}),
        ("NEAR(pod net, 3)", set()),
        ("NEAR(pod net, 4)", {"a"}),
        ("NEAR(pod net, 5)", {"a", "b"}),
        ("(login OR output) AND net", {"b"}),
        ("", set()),
        ('""', set()),
    ],
)
def test_matches(rows, index, query, ids):
    assert set(found(rows, query)) == ids
    plain = [(r["id"], r["rank"], pytest.approx(r["score"])) for r in fts.search(rows, query).orderBy("rank").collect()]
    assert [(r["id"], r["rank"], r["score"]) for r in index.search(query).orderBy("rank").collect()] == plain


def test_index_reads_only_the_terms_of_a_query(index):
    plan = index.search('"pod affinity" OR log*', None)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "EqualTo(term,pod)" in pushed and "StringStartsWith(term,log)" in pushed
    assert "tok_" not in plan and "Python" not in plan


@pytest.mark.parametrize("query", ["pod-affinity", "net.http", "(a", "a AND", "nope : a", '"open', "NEAR(a b, x)"])
def test_malformed_queries_raise(rows, query):
    with pytest.raises(fts.QueryError):
        fts.search(rows, query)


def naive_bm25(terms):
    tokens = {k: [t for part in v for t in fts.split_terms(part)] for k, v in TEXTS.items()}
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for k, t in tokens.items():
        if all(x in t for x in terms):
            out[k] = 0.0
            for x in terms:
                df, tf = sum(x in y for y in tokens.values()), t.count(x)
                idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                out[k] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
    return out


@pytest.mark.parametrize("terms", [["pod"], ["the"], ["pod", "net"], ["login", "handles"]])
def test_bm25_equals_the_formula(rows, terms):
    got = {r["id"]: r["score"] for r in fts.search(rows, " ".join(terms)).collect()}
    assert got == pytest.approx(naive_bm25(terms))


def test_index_gives_frequencies(index):
    assert {r["term"]: r["df"] for r in index.document_frequency(["pod", "login", "zz"]).collect()} == {"pod": 2, "login": 1}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \"():*^+-ANDORT{},", max_size=20))
def test_parser_never_breaks_otherwise(query):
    try:
        fts.parse(query)
    except fts.QueryError:
        pass


def symbols(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, kind string, source_tier int, signature string, doc_comment string")


def vectors(spark, rows):
    return spark.createDataFrame([(i, "m", v) for i, v in rows], "symbol_id string, model string, vector array<float>")


def test_semantic_order_and_tiers(spark):
    s = symbols(spark, [("log", "changelog", "section", 4, "", ""), ("code", "code", "function", 1, "", "")])
    v = vectors(spark, [("log", [0.99, 0.1, 0.1]), ("code", [0.9, 0.3, 0.3])])
    out = search.semantic_search(s, v, [1.0, 0.0, 0.0]).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["code", "log"]
    assert out[1]["score"] == pytest.approx(0.5 * 0.99 / math.sqrt(0.99**2 + 0.02), abs=1e-6)


def test_weighting_sees_only_the_preselection(spark):
    rows = [(f"v{i}", f"v{i}", "f", 4, "", "") for i in range(6)] + [("good", "good", "f", 1, "", "")]
    v = vectors(spark, [(f"v{i}", [1.0, 0.001 * i]) for i in range(6)] + [("good", [0.9, 0.4])])
    out = search.semantic_search(symbols(spark, rows), v, [1.0, 0.0], 2).collect()
    assert "good" not in {r["id"] for r in out} and len(out) == 2


def test_negative_scores_move_up_by_weight(spark):
    s = symbols(spark, [("a", "a", "f", 1, "", ""), ("b", "b", "f", 4, "", "")])
    out = search.semantic_search(s, vectors(spark, [("a", [-1.0, 0.0]), ("b", [-1.0, 0.0])]), [1.0, 0.0]).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in out] == [("b", -0.5), ("a", -1.0)]


def test_dedup_after_the_cut(spark):
    rows = [(f"f{i}:users:table", "users", "table", 1, "", "") for i in range(5)] + [("x", "x", "f", 1, "", "")]
    v = vectors(spark, [(r[0], [1.0, 0.1 * i]) for i, r in enumerate(rows)])
    out = search.semantic_search(symbols(spark, rows), v, [1.0, 0.0], 5).collect()
    assert [r["name"] for r in out] == ["users"]


def test_hybrid_prefers_rows_of_both_lists(spark):
    s = symbols(spark, [("Both", "Both", "f", 1, "", ""), ("OnlySem", "OnlySem", "f", 1, "", ""), ("OnlyKW", "other", "f", 1, "", "both words")])
    v = vectors(spark, [("Both", [1.0, 0.0, 0.0]), ("OnlySem", [0.95, 0.05, 0.0]), ("OnlyKW", [0.0, 0.0, 0.1])])
    toks = fts.tokenized(s)
    out = search.hybrid_search(s, v, toks, [1.0, 0.0, 0.0], "Both alpha-beta", 10, strict=True).orderBy("rank").collect()
    assert out[0]["id"] == "Both"
    names = [r["id"] for r in search.hybrid_search(s, v, toks, [1.0, 0.0, 0.0], "Both", 10).orderBy("rank").collect()]
    assert names[0] == "Both" and set(names) == {"Both", "OnlySem", "OnlyKW"}


def test_fusion_scores(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank long")
    right = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank long")
    got = {r["id"]: r["score"] for r in search.fuse(left, right, absent=130).collect()}
    assert got == pytest.approx({"a": 0.6 / 61 + 0.4 / 190, "b": 0.6 / 62 + 0.4 / 61, "c": 0.6 / 190 + 0.4 / 62})


def test_rerank(spark):
    ranked = spark.createDataFrame([("D", 1), ("C", 2), ("B", 3), ("A", 4)], "name string, rank long")
    edges = spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "C"), ("A", "Z")], "caller_symbol string, callee_symbol string")
    out = search.rerank_by_call_graph(ranked, edges).orderBy("rank").collect()
    assert [r["name"] for r in out] == ["B", "C", "D", "A"]
    assert [r["name"] for r in search.rerank_by_call_graph(ranked, edges.limit(0)).orderBy("rank").collect()] == ["D", "C", "B", "A"]


def test_self_call_counts_twice(spark):
    names = spark.createDataFrame([("A",), ("B",)], "name string")
    edges = spark.createDataFrame([("A", "A"), ("A", "B")], "caller_symbol string, callee_symbol string")
    assert {r["name"]: r["connections"] for r in search.connections(names, edges).collect()} == {"A": 3, "B": 1}


def test_failed_embedding_falls_back_to_keywords(spark):
    s = symbols(spark, [("a", "alpha", "f", 1, "", ""), ("b", "beta", "f", 1, "", "")])
    edges = spark.createDataFrame([], "caller_symbol string, callee_symbol string")

    def broken(query):
        raise RuntimeError("no server")

    parts = {"symbols": s, "embeddings": vectors(spark, [("a", [1.0])]), "tokens_of": fts.tokenized(s), "edges": edges, "embed": broken}
    assert [r["id"] for r in search.search("alpha", "", **parts).collect()] == ["a"]
    with pytest.raises(RuntimeError):
        search.search("alpha", "semantic", **parts)
    with pytest.raises(ValueError):
        search.search("", "keyword", **parts)



def test_terms_are_folded_as_the_tokens_are(spark):
    found = spark.createDataFrame([("a", "La Citación"), ("b", "la citacion")], "id string, doc_comment string")
    for folded, query, ids in ((False, "citación", ["a"]), (False, "CITACIÓN*", ["a"]), (False, '"la citacion"', ["b"]), (True, "citación", ["a", "b"])):
        index = fts.Index.build(found, columns=("doc_comment",), folded=folded)
        tokens = fts.tokenized(found, columns=("doc_comment",), folded=folded)
        for hits in (index.search(query, None), fts.search(tokens, query, limit=None, columns=("doc_comment",), folded=folded)):
            assert sorted(r["id"] for r in hits.collect()) == ids


def test_postings_are_made_without_a_shuffle(spark):
    found = spark.createDataFrame([(1, "b a b"), (2, None), (3, "A b"), (4, "")], "id long, doc_comment string")
    made = fts.postings(fts.tokenized(found, columns=("doc_comment",)), ("doc_comment",))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["term"], r["id"], r["col"], r["tf"], r["positions"], r["dl"]) for r in made.collect())
    assert rows == [("a", 1, "doc_comment", 1, [1], 3), ("a", 3, "doc_comment", 1, [0], 2), ("b", 1, "doc_comment", 2, [0, 2], 3), ("b", 3, "doc_comment", 1, [1], 2)]


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_an_index_is_written_in_sorted_runs(spark, rows, run):
    import pyarrow.parquet as pq

    source = spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id string, name string, signature string, doc_comment string").coalesce(1)
    index = fts.Index.build(source, run=run)
    assert index.n == len(TEXTS) and index.postings.where("term = ''").isEmpty()
    for path in index.stored.inputFiles():
        written = pq.ParquetFile(path.removeprefix("file://"))
        assert written.num_row_groups == -(-written.metadata.num_rows // run)
        for i in range(written.num_row_groups):
            keys = written.read_row_group(i, ["term", "id"]).to_pylist()
            assert keys == sorted(keys, key=lambda k: (k["term"], k["id"]))
    for query in ('pod OR "watch logs"', "pod NOT login", '"" OR pod', 'pod ""'):
        expected = {r["id"]: pytest.approx(r["score"]) for r in fts.search(rows, query, limit=None).collect()}
        assert {r["id"]: r["score"] for r in index.search(query, None).collect()} == expected
