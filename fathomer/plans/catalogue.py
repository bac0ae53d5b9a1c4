"""Every engine operator as a query over the provided tables, with the same in SQL.

The tables hold no source code, so they stand in for it: ``documents`` for
symbols, ``embeddings`` for their vectors, consecutive parts of an order for
calls, ``events`` for file changes; parsers get sources that are made for each
row of ``supplier`` (``plans.samples``).

What an index holds is made once an application, as an index is: the token
postings and the call edges.  All else is computed by each query.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomer.functions import text as T
from fathomer.functions import tiers
from fathomer.functions.vector import cosine
from fathomer.operators import fts, graph, search, tables
from fathomer.plans.samples import SAMPLES
from fathomer.workspace import new_path, once, read_table, written

_DOC = ("doc_comment",)
_QUERY = "the that with"
_TEXT_QUERY = "How do I use the erthe reading of thing-able files in net.http and pod_affinity for onthan erea"

#: Tables whose rows take long: texts, and those that a source is made and parsed for.
_DEALT = ("documents", "pages", "customer", "supplier")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return read_table(spark, path) if name in _DEALT else spark.read.parquet(path)


_PATH = """CASE doc_id % 6 WHEN 0 THEN 'src/d' || doc_id || '.go' WHEN 1 THEN 'docs/d' || doc_id || '.go'
    WHEN 2 THEN 'vendor/d' || doc_id || '.go' WHEN 3 THEN 'rel' || doc_id || '/CHANGELOG.md'
    WHEN 4 THEN 'pkg/d' || doc_id || '_test.go' ELSE 'api/d' || doc_id || '.pb.go' END"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.expr(_PATH).alias("path"))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as symbols; the name is the first token."""
    docs = _t(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("file"),
        F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), T.TOKEN, 0).alias("name"),
        F.col("lang").alias("kind"),
        F.lit("").alias("signature"),
        F.col("text").alias("doc_comment"),
        F.col("doc_id").cast("int").alias("start_line"),
        (F.col("doc_id") + F.col("n_chars") % 40).cast("int").alias("end_line"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("R"), F.col("doc_id") % 7)).otherwise("").alias("receiver"),
        F.lit("").alias("package"),
        tiers.source_tier(F.expr(_PATH)).alias("source_tier"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.lit("m").alias("model"), F.col("embedding").alias("vector"), "label")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive parts of an order as caller and callee: the table of call edges."""

    def build() -> DataFrame:
        lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        later = lines.select("l_orderkey", F.col("l_partkey").alias("callee_symbol"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
        edges = lines.join(later, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("caller_symbol"), "callee_symbol").distinct()
        return written(edges, "call-edges")

    return once(spark, "calls", sf, build)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("name"), "p_brand")


def _vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of row 0, as a query: what a model would give."""

    def build() -> list[float]:
        row = vectors(spark, sf).where("symbol_id = 0").select("vector").first()
        return [float(x) for x in row[0]] if row else []

    return once(spark, "query-vector", sf, build)


# -- projections and look-ups -------------------------------------------------------------------

_BRIEF = ("id", "file", "name", "kind", "start_line", "source_tier")


def symbol_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return tables.by_id(symbols(spark, sf), 7).select(*_BRIEF)


def symbols_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return tables.by_file(symbols(spark, sf), "src3").select(*_BRIEF)


def symbols_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tables.by_ids(symbols(spark, sf), [3, 5, 8, 13, 21, 10**9]).select(*_BRIEF)


def symbols_by_names(spark: SparkSession, sf: str) -> DataFrame:
    return tables.by_names(symbols(spark, sf), ["the", "la", "and"]).select(*_BRIEF)


def symbol_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol as result lists show it."""
    from fathomer.plans.tools import symbol_json as shown

    return symbols(spark, sf).select("id", F.to_json(shown()).alias("json"))


def id_build(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf)
    return s.select("id", T.symbol_id(F.col("file"), F.col("name"), F.col("kind"), F.col("receiver")).alias("symbol_id"))


def first_line(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, sf).select("doc_id", T.extension(p).alias("ext"), T.basename(p).alias("base"))


def url_path(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", T.url_path(F.col("url")).alias("path"))


def qualified_split(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("::", F.split("p_name", " "))
    return _t(spark, sf, "part").select("p_partkey", T.qualified_name(name).alias("last"), T.qualified_receiver(name).alias("scope"))


def extract_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select("item_id", T.extract_keywords(F.col("text")).alias("keywords"))


def source_tier(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).select("doc_id", tiers.source_tier(F.col("path")).alias("tier")).withColumn("weight", tiers.tier_weight(F.col("tier")))


def tier_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return source_tier(spark, sf).groupBy("tier").agg(F.count("*").alias("n"))


# -- full text ----------------------------------------------------------------------------------


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return fts.tokenized(symbols(spark, sf), columns=_DOC, folded=False)


def _index(spark: SparkSession, sf: str) -> fts.Index:
    """Postings of the texts, as they are written."""
    return once(spark, "index", sf, lambda: fts.Index.build(symbols(spark, sf), columns=_DOC, folded=False))


def _full_index(spark: SparkSession, sf: str) -> fts.Index:
    """Postings of all columns, folded: what search uses by default."""
    return once(spark, "full-index", sf, lambda: fts.Index.build(symbols(spark, sf)))


def tokenize_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index, made anew."""
    places = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return fts.postings(_tokens(spark, sf), _DOC).select("term", "id", "tf", "dl", places.alias("positions"))


def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("id", "dl")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


def df_table(spark: SparkSession, sf: str) -> DataFrame:
    distinct = _tokens(spark, sf).select(F.explode(F.array_distinct("tok_doc_comment")).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df"))


def _keyword(spark: SparkSession, sf: str, query: str) -> DataFrame:
    return _index(spark, sf).search(query, None).select("id", F.round("score", 6).alias("score"))


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword(spark, sf, _QUERY)


def keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same without an index, from the tokens of all rows."""
    return fts.search(_tokens(spark, sf), _QUERY, limit=None, columns=_DOC, folded=False).select("id", F.round("score", 6).alias("score"))


def keyword_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search(_QUERY, 10).select("id", "rank")


def keyword_default(spark: SparkSession, sf: str) -> DataFrame:
    """The best fifty over all columns, folded."""
    return _full_index(spark, sf).search("Thé OR ciON*", 50).select("id", F.round("score", 6).alias("score"), "rank")


def keyword_column(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of one column, and terms of any other."""
    return _full_index(spark, sf).search("name : the -name : of", None).select("id", F.round("score", 6).alias("score"))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    hits = _full_index(spark, sf).search("^the OR \"que la\"", None)
    return search.with_symbols(symbols(spark, sf), hits)


def keyword_first(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that begin with a term, or hold a phrase in any column, with their symbols."""
    return _matched(spark, sf).select("id", "name", "kind", F.round("score", 6).alias("score"))


def keyword_or(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword(spark, sf, "thing OR estiin OR citación")


def keyword_not(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword(spark, sf, "the NOT that")


def keyword_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword(spark, sf, "thing*")


def keyword_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword(spark, sf, '"of the"')


def keyword_near(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword(spark, sf, "NEAR(with that, 5)")


# -- vectors and fusion -------------------------------------------------------------------------


def cosine_all(spark: SparkSession, sf: str) -> DataFrame:
    found = search.similarities(vectors(spark, sf), _vector(spark, sf))
    return found.select(F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best ten vectors for the query vector: the flagship."""
    best = search.nearest(vectors(spark, sf), _vector(spark, sf), 10, digits=6)
    return search.with_rank(best, F.desc("cosine"), "id").select(F.col("id").alias("vec_id"), "cosine", "rank")


def _semantic(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    out = search.semantic_search(symbols(spark, sf), vectors(spark, sf), _vector(spark, sf), 10, digits=6, **options)
    return out.select("id", "score", "rank")


def semantic_tiered(spark: SparkSession, sf: str) -> DataFrame:
    return _semantic(spark, sf, dedup=False)


def semantic_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _semantic(spark, sf)


def knn_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest vectors of the query within each label."""
    v = vectors(spark, sf)
    scored = search.similarities(v, _vector(spark, sf)).withColumn("cosine", F.round("cosine", 6)).join(v.select(F.col("symbol_id").alias("id"), "label"), "id")
    best = Window.partitionBy("label").orderBy(F.desc("cosine"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where("rank <= 3")
    return ranked.select("label", F.col("id").alias("vec_id"), "cosine", "rank")


def search_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How well the ten nearest vectors of each of the first twenty share their label: searches by vector, judged."""
    from fathomer.plans.evaluation import judged

    v = vectors(spark, sf)
    asked = F.broadcast(v.where("symbol_id < 20").select(F.col("symbol_id").alias("query"), F.col("vector").alias("q"), F.col("label").alias("wanted")))  # twenty rows
    pairs = v.crossJoin(asked).where("symbol_id <> query")
    scored = pairs.select("query", F.col("symbol_id").alias("item"), F.round(cosine(F.col("vector"), F.col("q")), 6).alias("cosine"), (F.col("label") == F.col("wanted")).cast("int").alias("grade"))
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "item")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where("rank <= 10").select("query", "rank", "item")
    out = judged(ranked, scored.select("query", "item", "grade"), top=10)
    return out.select("query", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "reciprocal", "ndcg")])


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    semantic = search.semantic_search(symbols(spark, sf), vectors(spark, sf), _vector(spark, sf), 30, digits=6)
    keyword = _index(spark, sf).search(_QUERY, 30)
    return semantic, keyword


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion of both lists of thirty, before the cut."""
    fused = search.fuse(*_lists(spark, sf), absent=130)
    return fused.select("id", F.round("score", 9).alias("score"))


def hybrid_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = search.hybrid_search(symbols(spark, sf), vectors(spark, sf), _index(spark, sf), _vector(spark, sf), "thing with that", 10, digits=9)
    return out.select("id", "rank")


def search_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """A hybrid search as the tools run it: both lists, fusion, dedup, and re-ranking by calls from each document's name to the next one's."""
    s = symbols(spark, sf)
    later = s.select((F.col("id") - 1).alias("id"), F.col("name").alias("callee_symbol"))
    edges = s.select("id", F.col("name").alias("caller_symbol")).join(later, "id").select("caller_symbol", "callee_symbol")
    found = search.search(
        "ing tion", "", symbols=s, embeddings=vectors(spark, sf), tokens_of=_index(spark, sf), edges=edges, embed=lambda _: _vector(spark, sf), digits=6
    )
    return found.select("id", "rank")


def rerank_call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The sixty parts of highest price, re-ranked by the calls among them."""
    top = _t(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(60)
    ranked = search.with_rank(top.select(F.col("p_partkey").alias("name"), "p_retailprice"), F.desc("p_retailprice"), "name")
    return search.rerank_by_call_graph(ranked, calls(spark, sf)).select("name", "rank")


# -- graph --------------------------------------------------------------------------------------


def callees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callees(calls(spark, sf), 1)


def callers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callers(calls(spark, sf), 1)


def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    return graph.blast_radius(parts(spark, sf), calls(spark, sf), 1).select("id", "p_brand")


def connection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The calls among all parts, by part."""
    return search.connections(parts(spark, sf), calls(spark, sf))


def _traverse(spark: SparkSession, sf: str, depth: int) -> DataFrame:
    nodes = parts(spark, sf)
    return graph.traverse(nodes, calls(spark, sf), nodes.where("id = 1"), depth).select("id", F.col("hop").cast("long").alias("hop"))


def traverse_d1(spark: SparkSession, sf: str) -> DataFrame:
    return _traverse(spark, sf, 1)


def traverse_d3(spark: SparkSession, sf: str) -> DataFrame:
    return _traverse(spark, sf, 3)


def call_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered callees of each caller, as one text."""
    from fathomer.plans.ingest import in_order

    edges = calls(spark, sf).withColumn("seq", F.col("callee_symbol"))
    listed = in_order(edges, [F.col("caller_symbol")], "callee_symbol")
    return listed.select("caller_symbol", F.array_join(F.transform("callee_symbols", lambda x: x.cast("string")), ",").alias("callees"))


# -- tables -------------------------------------------------------------------------------------


def missing_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.missing_embeddings(symbols(spark, sf), vectors(spark, sf)).select("id")


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Indexed and seen files: every seventh has changed, every eleventh is new, every thirteenth is gone."""
    docs = _t(spark, sf, "documents")
    path = F.col("doc_id").cast("string")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    indexed = docs.where("doc_id % 11 <> 0").select(path.alias("path"), F.md5("text").alias("content_hash"))
    seen = docs.where("doc_id % 13 <> 0").select(path.alias("path"), F.md5(changed).alias("content_hash"))
    return indexed, seen


def incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    indexed, seen = _snapshots(spark, sf)
    return tables.changed_files(seen, indexed)


def reconcile_stale(spark: SparkSession, sf: str) -> DataFrame:
    indexed, seen = _snapshots(spark, sf)
    return tables.stale_files(indexed, seen)


def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with those of segment BUILDING replaced."""
    old = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("REBUILT").alias("c_mktsegment"))
    return tables.upsert(old, new, ["c_custkey"])


def _indexed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    s = symbols(spark, sf)
    return {
        "files": s.select(F.col("file").alias("path")).distinct().withColumn("content_hash", F.lit("h")),
        "symbols": s.select("id", "file", "name"),
        "embeddings": vectors(spark, sf).select("symbol_id", "model"),
        "call_edges": s.select(
            F.col("file").alias("caller_file"), F.col("name").alias("caller_symbol"), F.col("kind").alias("callee_symbol"), F.col("start_line").alias("line")
        ).distinct(),
        "import_edges": s.select(F.col("file").alias("importer_file"), F.col("kind").alias("imported_path")).distinct(),
    }


def _store(spark: SparkSession, sf: str, *names: str):  # noqa: ANN202
    """A store on disk that holds some of the five tables; ids begin with the file, as ``symbol_id`` makes them."""
    from fathomer.plans.store import Store

    found = _indexed(spark, sf)
    own = F.concat_ws(":", "file", F.col("id").cast("string"))
    of = symbols(spark, sf).select(F.col("id").alias("symbol_id"), own.alias("own"))
    found["embeddings"] = vectors(spark, sf).join(of, "symbol_id").select(F.col("own").alias("symbol_id"), "model", F.size("vector").alias("dims"), "vector")
    found["symbols"] = found["symbols"].withColumn("id", own)
    store = Store(spark, new_path(spark, "store"), buckets=8)
    for name in names:
        store.upsert(name, found[name])
    return store


def stored_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What a store on disk holds after all tables are put there and two files are deleted."""
    store = _store(spark, sf, *_KEY_COLUMNS)
    store.delete_files(_chosen(spark))
    return _keys(store.tables())


def stored_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The stored hash of a file that is indexed, and of one that is not."""
    indexed, _ = _snapshots(spark, sf)
    return spark.createDataFrame([(p, tables.file_hash(indexed, p)) for p in ("7", "none")], "path string, content_hash string")


def store_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of a store whose symbols had some, after the others are embedded."""
    from fathomer.plans.ingest import backfill
    from fathomer.sources.embedders import HashingEmbedder

    store = _store(spark, sf, "symbols", "embeddings")
    backfill(store, HashingEmbedder(8, "m"))
    return store.table("embeddings").select("symbol_id", "model", F.size("vector").alias("size"))


def index_run(spark: SparkSession, sf: str) -> DataFrame:
    """A store after three runs over a tree of Java files: all, one in ten with another type, and none changed."""
    from fathomer.plans import samples
    from fathomer.plans.ingest import index_files
    from fathomer.plans.store import Store
    from fathomer.sources.files import with_hash

    tree = samples.files(_t(spark, sf, "supplier"), "java").withColumn("mod_time", F.lit(1).cast("long"))
    more = F.concat(F.col("content"), F.lit("class Added {}\n").cast("binary"))
    other = tree.withColumn("content", F.when(F.col("path").rlike(r"0\.java$"), more).otherwise(F.col("content")))
    store = Store(spark, new_path(spark, "store"))
    runs = [index_files(store, with_hash(t)) for t in (tree, other, other)]
    counts = spark.createDataFrame([(f"run {i}", str(r.files_indexed), str(r.symbols)) for i, r in enumerate(runs)], "file string, name string, kind string")
    edges = store.table("call_edges").select("caller_file", F.concat_ws(">", "caller_symbol", "callee_symbol"), F.lit("call"))
    return store.table("symbols").select("file", "name", "kind").union(edges).union(counts)


def _chosen(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src1",), ("src2",)], "path string")


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What each table keeps when two files go."""
    return _keys(tables.delete_files(_indexed(spark, sf), _chosen(spark)))


def delete_keep_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(tables.delete_files(_indexed(spark, sf), _chosen(spark), keep_orphan_edges=True))


def replace_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """What each table holds when two files are replaced by their even symbols and the imports of one kind."""
    now = _indexed(spark, sf)
    chosen = ["src1", "src2"]
    even = now["symbols"].where(F.col("file").isin(chosen) & (F.col("id") % 2 == 0))
    parsed = {
        "files": now["files"].where(F.col("path").isin(chosen)),
        "symbols": even,
        "call_edges": now["call_edges"].where(F.col("caller_file").isin(chosen) & (F.col("line") % 2 == 0)),
        "import_edges": now["import_edges"].where(F.col("importer_file").isin(chosen) & (F.col("imported_path") == "en")),
    }
    return _keys(tables.replace_files(now, parsed, _chosen(spark)))


_KEY_COLUMNS = {
    "files": ("path",), "symbols": ("file", "id"), "embeddings": ("symbol_id",), "import_edges": ("importer_file", "imported_path"),
    "call_edges": ("caller_file", "caller_symbol", "callee_symbol", "line"),
}


def _keys(found: dict[str, DataFrame]) -> DataFrame:
    """``table, key``: a row for each row of each table."""
    out = None
    for name, table in sorted(found.items()):
        one = table.select(F.lit(name).alias("table"), F.concat_ws("|", *[F.col(c).cast("string") for c in _KEY_COLUMNS[name]]).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def edges_dedup_pk(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each order and number: inserting and ignoring repeats."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").asc()
    return tables.first_by_key(lines, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text by which each symbol is embedded, with its first 80 characters as snippet, the callees of the part of its number, and its file's kinds as imports."""
    from fathomer.plans.ingest import enriched

    shown = symbols(spark, sf).withColumns({"snippet": F.left(F.coalesce("doc_comment", F.lit("")), F.lit(80)), "doc_comment": T.first_line(F.col("doc_comment"))})
    own = shown.select(F.col("id").alias("caller_symbol_id"), F.col("file").alias("caller_file"), F.col("name").alias("caller_symbol"))
    edges = calls(spark, sf).select(F.col("caller_symbol").alias("caller_symbol_id"), F.col("callee_symbol").cast("string").alias("callee_symbol"), F.col("callee_symbol").alias("seq"))
    edges = edges.join(own, "caller_symbol_id").select("caller_file", "caller_symbol", "callee_symbol", "seq").distinct()
    imports = shown.select(F.col("file").alias("importer_file"), F.col("kind").alias("imported_path"), F.ascii("kind").alias("seq")).distinct()
    return enriched(shown, edges, imports).select(F.col("symbol_id").alias("id"), "text")


def doc_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """A text file as one symbol: its first five lines, at most 300 characters, and 4000 of the whole."""
    lines = F.slice(F.split("text", "\n", -1), 1, 5)
    return (
        _t(spark, sf, "documents")
        .where("text <> ''")
        .select("doc_id", F.left(F.array_join(lines, "\n"), F.lit(300)).alias("signature"), F.md5(F.left("text", F.lit(4000))).alias("doc_md5"))
    )


def percentiles_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return tables.percentiles(_t(spark, sf, "events"), "value", [50, 95, 99])


def latency_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("average"))


def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of a user's events with no gap of six hours: one reindexing each."""
    from fathomer.streaming.debounce import debounced

    rows = _t(spark, sf, "events").select(F.col("user_id").alias("path"), "ts", F.col("event_id").alias("seq"))
    out = debounced(rows, gap="6 hours")
    return out.select(F.col("path").alias("user_id"), "first_ts", "last_ts", "n", F.col("last_seq").alias("last_event"))


def index_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Files, symbols and symbols by kind of one indexing run."""
    s = symbols(spark, sf)
    return s.agg(F.countDistinct("file").alias("files"), F.count("*").alias("symbols"), F.count_if(F.col("kind") == "en").alias("en"))


def html_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and headings of pages, as the HTML parser gives them."""
    from fathomer.sources.parsing import parse_files

    files = _t(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return parse_files(files)["symbols"].select("file", "name", "kind")


def route_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that a parser takes, by extension or name."""
    from fathomer.sources.parsing import routed

    other = F.when(F.col("doc_id") % 9 == 0, F.concat("path", F.lit(".py"))).when(F.col("doc_id") % 9 == 1, F.lit("x/Makefile")).otherwise(F.col("path"))
    return routed(paths(spark, sf).select("doc_id", other.alias("path")))


def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that an ignore file and the folder rules leave."""
    from fathomer.sources.files import eligible, ignore_patterns, ignored

    patterns = ignore_patterns("vendor/\n*.pb.go\n!d5.pb.go\n/pkg/d1*_test.go\n")
    found = paths(spark, sf).withColumn("path", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(".git/"), "path")).otherwise(F.col("path")))
    return found.where(eligible(F.col("path")) & ~ignored(F.col("path"), patterns))


def vector_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through the blob form and back."""
    from fathomer.functions.vector import decode_floats, encode_floats

    there = vectors(spark, sf).select("symbol_id", encode_floats("vector").alias("blob"))
    back = there.select("symbol_id", F.octet_length("blob").alias("bytes"), decode_floats("blob").alias("v"))
    return back.select("symbol_id", "bytes", F.round(F.col("v")[0].cast("double"), 6).alias("head"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The content hash of each document's bytes."""
    from fathomer.functions.hashing import content_hash

    return _t(spark, sf, "documents").select("doc_id", content_hash(F.col("text").cast("binary")).alias("content_hash"))


def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through the default embedder: the numbers that are not zero."""
    from fathomer.sources.embedders import HashingEmbedder, embed_rows

    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("symbol_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = embed_rows(rows, HashingEmbedder(32)).select("symbol_id", "model", "dims", F.posexplode("vector").alias("place", "value"))
    return found.where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 5))


def embed_without_model(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through the embedder that stands for having none."""
    from fathomer.sources.embedders import ZeroEmbedder, embed_rows

    out = embed_rows(_t(spark, sf, "documents").select(F.col("doc_id").alias("symbol_id"), "text"), ZeroEmbedder(4))
    return out.select("symbol_id", "model", "dims", F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))).alias("total"))


class _Picky:
    """A model that fails on every batch that holds one of some texts."""

    model, dims = "picky", 1

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any(t.endswith("3") for t in texts):
            raise RuntimeError("not this one")
        return [[float(len(t))] for t in texts]


def embed_one_by_one(spark: SparkSession, sf: str) -> DataFrame:
    """Batches that fail are tried text by text: all vectors but those of the texts that fail alone."""
    from fathomer.sources.embedders import embed_rows

    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("symbol_id"), F.col("doc_id").cast("string").alias("text"))
    return embed_rows(rows, _Picky(), batch=7).select("symbol_id", F.col("vector")[0].cast("int").alias("length"))


def embed_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Queries through the cache of two: how often the model was asked, and what came out."""
    from fathomer.sources.embedders import cache_trace

    asked = _t(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey")
    return cache_trace(spark, [r[0] % 3 for r in asked.collect()] * 2, size=2)  # five rows at any size


def _sample(spark: SparkSession, sf: str, language: str) -> DataFrame:
    """What the parser of a language finds in a source for each supplier."""
    from fathomer.plans import samples
    from fathomer.sources.parsing import parse_files

    return samples.flat(parse_files(samples.files(_t(spark, sf, "supplier"), language)))


def synthetic_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols and calls by file of a synthetic tree with a file for each customer."""
    from fathomer.sources.parsing import parse_files
    from fathomer.sources.synthetic import LANGUAGES, source_files

    out = None
    for language in LANGUAGES:
        found = parse_files(source_files(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), language))
        kinds = ("struct", "method", "function")
        counts = found["symbols"].groupBy(F.col("file").alias("path")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
        edges = found["call_edges"].groupBy(F.col("caller_file").alias("path")).agg(F.count("*").alias("calls"))
        one = counts.join(edges, "path", "left").select("path", *kinds, F.coalesce("calls", F.lit(0)).alias("calls"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    name: globals()[name]
    for name in """
    symbol_by_id symbols_by_file symbols_by_ids symbols_by_names symbol_json id_build first_line path_parts url_path
    qualified_split extract_keywords source_tier tier_histogram tokenize_postings doc_stats corpus_stats df_table
    keyword_search keyword_top10 keyword_or keyword_not keyword_prefix keyword_phrase keyword_near cosine_all
    semantic_topk semantic_tiered semantic_dedup knn_per_label hybrid_rrf hybrid_dedup rerank_call_graph callees callers
    blast_radius connection_counts traverse_d1 traverse_d3 call_lists missing_embeddings incremental_skip
    reconcile_stale upsert_rows delete_cascade delete_keep_edges replace_by_file edges_dedup_pk embed_text doc_symbol
    percentiles_nearest_rank latency_rollup debounce_sessions index_counters html_symbols
    route_files ignore_filter vector_codec content_hashes embed_documents embed_cached synthetic_trees
    keyword_scan keyword_default keyword_column keyword_first search_quality search_dispatch stored_tables stored_hash
    store_backfill index_run embed_without_model embed_one_by_one
    """.split()
} | {f"{language}_symbols": functools.partial(_sample, language=language) for language in SAMPLES if language != "html"}
