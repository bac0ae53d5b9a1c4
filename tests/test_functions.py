"""Text, tier, vector and hash functions against known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomer.functions import text as T
from fathomer.functions import tiers, vector
from fathomer.functions.hashing import content_hash, hash_bytes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "terms"),
    [
        ("", ""),
        ("the and of", ""),
        ("How does the scheduler handle pod-affinity?", "scheduler handle pod-affinity"),
        ("net.http and net.http again", "net.http"),
        ("Use pod_affinity in a FILE", "pod_affinity"),
        ("ab abc " + "x" * 31, "abc"),
        (" ".join(f"term{i}" for i in range(20)), " ".join(f"term{i}" for i in range(12))),
        (None, ""),
    ],
)
def test_extract_keywords(spark, query, terms):
    assert one(spark, T.extract_keywords(F.lit(query).cast("string"))) == terms


@pytest.mark.parametrize(
    ("path", "tier"),
    [
        ("pkg/server.go", 1),
        ("CHANGELOG.md", 4),
        ("docs/changelog-1.2.txt", 4),
        ("CHANGES", 4),
        ("x/HISTORY.md", 4),
        ("api/zz_generated_deepcopy.go", 4),
        ("api/types_generated.go", 4),
        ("api/foo.generated.ts", 4),
        ("api/generated.pb.go", 4),
        ("api/foo.pb.go", 4),
        ("kind_string.go", 4),
        ("vendor/a/b.go", 3),
        ("pkg/vendor/a.go", 3),
        ("pkg/revendor/a.go", 1),
        ("web/node_modules/x.js", 3),
        ("vendor/CHANGELOG.md", 4),
        ("docs/a.go", 2),
        ("a/testdata/b.go", 2),
        ("hack/x.sh", 2),
        ("README.md", 2),
        ("conf/app.YAML", 2),
        ("pkg/a_test.go", 2),
        ("contest/a.go", 1),
    ],
)
def test_source_tier(spark, path, tier):
    assert one(spark, tiers.source_tier(F.lit(path))) == tier


def test_tier_weight(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,), (None,)], "t int").select(tiers.tier_weight(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in rows] == [1.0, 0.85, 0.7, 0.5, 1.0, 1.0]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([], [], 0), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 0.0], 0), (None, [1.0], 0)],
)
def test_cosine(spark, a, b, expected):
    df = spark.createDataFrame([(a,)], "v array<float>")
    assert df.select(vector.cosine(F.col("v"), b).alias("c")).first()["c"] == pytest.approx(expected, abs=1e-9)


def test_cosine_of_long_vectors_and_columns_agrees(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=400).tolist(), rng.normal(size=400).tolist()
    df = spark.createDataFrame([(x, y)], "x array<float>, y array<float>")
    row = df.select(vector.cosine(F.col("x"), y).alias("a"), vector.cosine(F.col("x"), F.col("y")).alias("b")).first()
    real = np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    assert row["a"] == pytest.approx(real, abs=1e-6) == row["b"]


def test_float_codec_round_trip_and_tail(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>")
    rows = df.select(vector.decode_floats(vector.encode_floats("v")).alias("v")).collect()
    assert [r["v"] for r in rows] == [[1.5, -2.0], None, []]
    tail = spark.createDataFrame([(bytearray(vector.pack([3.0]) + b"\x01"),)], "b binary")
    assert tail.select(vector.decode_floats("b").alias("v")).first()["v"] == [3.0]


def test_content_hash_is_unpadded_and_seeded_with_zero(spark):
    assert hash_bytes(b"a") == "d24ec4f1a98c6e5b"
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b""),), (None,)], "c binary")
    assert [r["h"] for r in df.select(content_hash("c").alias("h")).collect()] == ["d24ec4f1a98c6e5b", "ef46db3751d8e999", None]


def test_embed_text_parts(spark):
    lit = F.lit
    full = T.embed_text(
        lit("a.go"), lit("method"), lit("Run"), receiver=lit("S"), signature=lit("func Run()"), doc=lit("Runs."), snippet=lit("body"),
        calls=F.array(*[lit(x) for x in ["a", "b", "a", ""]]), imports=F.array(lit("fmt")),
    )
    assert one(spark, full) == "a.go method S.Run: func Run()\nRuns.\nbody\ncalls: a, b\nimports: fmt"
    bare = T.embed_text(lit("a.go"), lit("function"), lit("Run"), receiver=lit(""), signature=lit(""), doc=lit(""), calls=F.array().cast("array<string>"))
    assert one(spark, bare) == "a.go function Run"
    many = T.embed_text(lit("f"), lit("k"), lit("n"), calls=F.array(*[lit(f"c{i}") for i in range(12)]))
    assert one(spark, many).endswith("c8, c9")


def test_paths_and_lines(spark):
    assert one(spark, T.extension(F.lit("a.b/c.GO"))) == ".go"
    assert one(spark, T.extension(F.lit("a.b/Makefile"))) == ""
    assert one(spark, T.first_line(F.lit("func A() {\n}"))) == "func A()"
    assert one(spark, T.symbol_id(F.lit("f"), F.lit("n"), F.lit("method"), F.lit("R"))) == "f:R.n:method"
    for url, path in [("http://a/b/c?d#e", "/b/c"), ("https://a", "/"), ("", "/"), ("/x?y", "/x")]:
        assert one(spark, T.url_path(F.lit(url))) == path
    assert one(spark, T.qualified_name(F.lit("a::b::c"))) == "c"
    assert one(spark, T.qualified_receiver(F.lit("a::b::c"))) == "a::b"


def test_tokens_fold_marks_and_split_underscores(spark):
    assert one(spark, T.tokens(F.lit("Pod_Affinity CaféÑ x9-y"))) == ["pod", "affinity", "cafen", "x9", "y"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
