"""Line dedup, license scans and quality rules against plain Python."""

from __future__ import annotations

import math
import struct
from collections import Counter

import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomer.llm import licenses, line_dedup, quality
from tests.llm import brute

LONG = "this line is long enough to count"
DOCS = [
    (1, f"{LONG}\nshort\nown line of the first document"),
    (2, f"  {LONG.upper()}\t\nshort\n\n{LONG}"),
    (3, f"{LONG}\r\nÉcole {LONG}\nécole {LONG}"),
    (4, ""),
    (5, None),
    (6, "École " + LONG),
    (7, "École " + LONG + "\n"),
    (None, LONG),
    (3, "another text of the same document\n" + LONG),
]


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_line_dedup_equals_brute_force(spark):
    out = line_dedup.with_kept_text(table(spark, DOCS)).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out), key=key) == sorted(brute.line_dedup(DOCS), key=key)


def test_line_dedup_bitmaps_are_runs(spark):
    docs = [(i, "\n".join(["unique line number %d of it all" % i, LONG, LONG, "tail of document %d, which is long" % i])) for i in range(4)]
    runs = {r.doc_id: [tuple(x) for x in r.keep] for r in line_dedup.keep_bitmaps(table(spark, docs)).collect()}
    assert runs == {i: [(0, 1), (3, 1)] for i in range(3)}


def test_line_dedup_keeps_other_columns_and_empty_tables(spark):
    docs = table(spark, DOCS[:3]).withColumns({"keep": F.lit("mine"), "h1": F.lit(1), "slice": F.lit(2), "text_hash": F.lit(3)})
    out = line_dedup.with_kept_text(docs)
    assert out.columns == ["doc_id", "text", "h1", "slice", "text_hash", "n_lines", "n_dropped", "keep", "kept_text"] and out.count() == 3
    assert line_dedup.with_kept_text(table(spark, [])).count() == 0


def test_line_dedup_long_text(spark):
    docs = [(i, "\n".join(f"line number {j % 4000:06d} of a long text" for j in range(20_000))) for i in range(3)]
    out = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.with_kept_text(table(spark, docs)).collect()}
    assert out == {0: (20_000, 20_000), 1: (20_000, 20_000), 2: (20_000, 0)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["ab", "AB ", "\tab", "abc", "", " ", "É", "é"]), max_size=5), max_size=6))
def test_line_dedup_property(spark, lines):
    docs = [(i, "\n".join(x)) for i, x in enumerate(lines)]
    out = line_dedup.with_kept_text(table(spark, docs), min_chars=1, min_docs=2).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out) == sorted(brute.line_dedup(docs, 1, 2))


def scanned(spark, docs):
    return {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses.scan(table(spark, docs)).collect()}


def test_license_scan(spark):
    mit = dict(licenses.TEXTS)["MIT"].replace("The MIT License (MIT)\n", "")
    noisy = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;").replace("SUBLICENSE", "sub-licence")
    docs = [
        (1, mit),
        (2, noisy),
        (3, "prose\nReleased under the MIT Licence\nmore\nLicensed under the Apache License, Version 2.0."),
        (4, "prose\n\n" + mit + "\n\nmore prose"),
        (5, "licensed to kill"),
        (6, None),
        (7, ""),
        (8, "Licensed under CC BY-NC 4.0."),
        (9, "SPDX-License-Identifier: gpl-3.0"),
        (3, "nothing"),
        (None, "Released under the MIT License."),
    ]
    assert scanned(spark, docs) == {
        1: ("MIT", "MIT", 1),
        2: ("MIT", "MIT", 1),
        3: (None, "Apache-2.0,MIT", 2),
        4: (None, "MIT", 1),
        5: (None, "", 0),
        6: (None, "", 0),
        7: (None, "", 0),
        8: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
        9: ("GPL-3.0", "GPL-3.0", 1),
        None: ("MIT", "MIT", 1),
    }
    assert scanned(spark, []) == {}


def test_every_known_text_has_a_hint_and_one_license(spark):
    assert all(any(h in text.lower() for h in licenses.HINTS) for _, text in licenses.known_texts())
    known = licenses.known_digests(spark)
    assert known.count() == known.select("digest").distinct().count()


def test_base_counts(spark):
    eight = "a b c d e f g h"
    docs = [
        (0, None), (1, ""), (2, "one\ntwo\none\n \n "), (3, f"{eight} {eight}"), (4, f"{eight} x {eight} y a b"), (5, "a " * 40), (6, "a " * 7), (7, "a " * 9),
        (8, "#*$%&|<> é漢 x\x1fy"), (9, "\n\n"), (10, " ".join(str(i % 50) for i in range(3000))),
    ]
    out = quality.judge(table(spark, docs), spark.createDataFrame([], "doc_id long, quality int")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out}
    assert got == {k: brute.base_counts(t) for k, t in docs}
    failed = {k: n[0] < 20 or 100 * n[4] > 30 * n[0] for k, n in got.items()}
    assert {r.doc_id: r.base_failed for r in out} == failed and all(r.kept == (not r.base_failed) for r in out)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def buckets(text):
    """Spark's xxhash64 has seed 42, and takes a second argument with the first one's hash as seed."""
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in brute.words(text)]
    eight = lambda h: struct.pack("<q", h)
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(eight(b), xxhash.xxh64_intdigest(eight(a), 42)))
    return [h % quality.BUCKETS for h in hashes] + [pair(a, b) % quality.BUCKETS for a, b in zip(hashes, hashes[1:], strict=False)]


def test_quality_scores_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    corpus, good = Counter(), Counter()
    for doc, text in docs:
        corpus.update(buckets(text))
        if doc in trusted:
            good.update(buckets(text))
    ratio = lambda b: math.log((good[b] + quality.SHRINK) / (good.total() * corpus[b] / corpus.total() + quality.SHRINK))
    want = {doc: sum(map(ratio, x)) / len(x) if (x := buckets(text)) else 0.0 for doc, text in docs}
    out = quality.judge(table(spark, docs), labels).collect()
    assert {r.doc_id: r.score for r in out} == pytest.approx(want, abs=1e-9)
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in out)


def test_quality_keeps_repeats_and_extra_columns(spark):
    docs = table(spark, [(1, "word " * 3), (1, "word " * 3), (None, "x")]).withColumn("buckets", F.lit(1)).withColumn("score", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1)], "doc_id long, quality int")
    assert sorted(str(r.doc_id) for r in quality.judge(docs, labels).collect()) == ["1", "1", "None"]
    assert quality.judge(table(spark, []), labels).count() == 0
