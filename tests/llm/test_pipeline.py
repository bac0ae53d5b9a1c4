"""The pipeline against its stages in plain Python, and the queries against their SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomer.llm import langid
from fathomer.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf, oracle):
    mine, theirs = oracle(QUERIES[name], ORACLE_SQL[name], spark, sf)
    assert mine == theirs


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_equals_its_stages_in_plain_python(spark, sf):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.lang, r.source or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    told = brute.languages(rows, langid.SUFFIX_LANGUAGE)
    docs = [(r[0], r[1]) for r, (lang, _) in zip(rows, told, strict=True) if lang != "und"]
    docs = [(d, text) for d, _, _, text in brute.line_dedup(docs)]
    group = brute.components(docs, 5, 80)
    docs = [(d, text) for d, text in docs if group[d] == d]
    leaked = {d for d, _ in brute.contaminated(docs, items)}
    library = Tokenizer.from_file(vocabulary())
    want = {d: len(library.encode(text, add_special_tokens=False).ids) + 1 for d, text in docs if d not in leaked}
    out = corpus_pipeline.run(spark, sf).collect()
    got: dict[int, int] = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and all(r.doc_tokens == want[r.doc_id] for r in out)


ODD = [
    (1, None, "en", "s", 0), (2, "", "en", None, 0), (None, "the house that they had when it was with this", "en", "s", None),
    (3, "the house that they had when it was with this\nanother line of the text that is there", None, "s", 1),
    (3, "the house that they had when it was with this\nanother line of the text that is there", None, "s", 1),
    (4, "the house that they had when it was with this\nsomething else of the day and the night", "en", "s", 2),
    (5, "the house that they had when it was with this " * 3000, "en", "s", 3),
]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_odd_rows(spark, sf, name, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stage(spark, docs, sf)
    assert out.dtypes == docs.dtypes and out.count() > 0
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that the operators use themselves.
    odd = odd.withColumns({c: F.lit(1) for c in ("keep", "kept_text", "n_lines", "n_dropped", "kept", "component_id", "item_id", "row", "predicted", "_host", "bucket", "class")})
    out = stage(spark, odd, sf)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} <= {1, 2, 3, 4, 5, None}
    ids = sorted(str(r.doc_id) for r in out.collect())
    if name == "language_id":
        assert ids == ["3", "3", "4", "5", "None"]  # texts without a letter go
    if name == "line_dedup":
        texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
        line = "the house that they had when it was with this"
        assert len(ids) == len(ODD) and texts[1] == ("", 0) and texts[None][0] == line
        assert texts[4] == (ODD[5][1], len(ODD[5][1]))  # of documents 3 and 4 alone, two hold the line
    if name == "minhash_near_dedup":
        assert ids == ["1", "2", "3", "3", "4", "5", "None"]  # rows of one id stay together
    if name == "benchmark_decontamination":
        assert len(ids) == len(ODD)
    empty = stage(spark, odd.limit(0), sf)
    assert empty.columns == odd.columns and empty.count() == 0


def test_packing_takes_odd_rows(spark, sf):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumn("start", F.lit(1))
    pack = corpus_pipeline.STAGES[-1][1]
    assert sum(r.length for r in pack(spark, odd, sf).collect() if r.doc_id in (1, 2)) == 2
    assert pack(spark, odd.limit(0), sf).count() == 0
