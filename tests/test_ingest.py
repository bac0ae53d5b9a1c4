"""Trees to tables: reading, skipping, replacing, deleting, embedding, tools, streaming."""

from __future__ import annotations

import io
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomer.cli import main
from fathomer.plans.ingest import backfill, index_files, index_tree, reconcile
from fathomer.plans.store import Store
from fathomer.plans.tools import Tools, as_json
from fathomer.server import Server
from fathomer.sources import embedders as E
from fathomer.sources import files, languages
from fathomer.sources.languages.code import Symbol
from fathomer.streaming.debounce import debounced
from fathomer.streaming.watch import Pass, checkpoint_of, watch

CHAIN = """package a

// Orchestrate runs the whole chain.
func Orchestrate() { DoStep() }

// DoStep does one step.
func DoStep() { Finalize() }

func Finalize() {}
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src tree+1"
    for name, text in {
        "a.go": CHAIN,
        "docs/guide.md": "# Guide\nHow to orchestrate.\n",
        "vendor/v.go": "package v\n\nfunc Vendored() {}\n",
        "node_modules/x.js": "function hidden() {}\n",
        ".git/y.go": "package y\n\nfunc Hidden() {}\n",
        "skip/z.go": "package z\n\nfunc Skipped() {}\n",
        "notes.unknown": "nothing",
        "Makefile": "all:\n\tgo build\n",
        ".env": "A=1\n",
        ".gitignore": "skip/\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "index"))


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_tree_rules(spark, tree):
    seen = ["Makefile", "a.go", "docs/guide.md", "notes.unknown", "vendor/v.go"]
    (tree / "_ex").mkdir()
    (tree / "_ex/b.go").write_text("package b\n")
    every = sorted([*seen, ".env", ".gitignore", "_ex/b.go"])
    assert names(files.read_tree(spark, str(tree), hidden=False), "path") == seen
    assert names(files.read_tree(spark, str(tree)), "path") == names(files.list_tree(spark, str(tree)), "path") == every
    assert [(r.path, bytes(r.content)) for r in files.read_tree(spark, str(tree), only=["_ex/b.go", "skip/z.go"]).collect()] == [("_ex/b.go", b"package b\n")]
    # By an address that only Spark's readers open.
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./src", tree.as_uri())
    assert names(files.read_tree(spark, "viewfs://trees/src"), "path") == names(files.list_tree(spark, "viewfs://trees/src"), "path") == every
    assert [bytes(r.content) for r in files.read_tree(spark, "viewfs://trees/src", only=["_ex/b.go"]).collect()] == [b"package b\n"]


@pytest.mark.parametrize(
    ("patterns", "path", "ignored"),
    [
        ("*.log", "a/b.log", True),
        ("/x", "a/x", False),
        ("/x", "x/y", True),
        ("a/**/b", "a/c/d/b", True),
        ("build/", "build", False),
        ("build/", "q/build/f", True),
        ("*.log\n!keep.log", "keep.log", False),
        ("# no\n\nf?o", "foo", True),
        ("[ab].c", "b.c", True),
        ("[!ab].c", "b.c", False),
    ],
)
def test_ignore_patterns(spark, patterns, path, ignored):
    df = spark.range(1).select(files.ignored(F.lit(path), files.ignore_patterns(patterns)).alias("x"))
    assert df.first()["x"] is ignored


def test_index_skip_force_change_and_delete(spark, tree, store):
    first = index_tree(spark, str(tree), store)
    assert (first.files_indexed, first.files_skipped) == (5, 0)
    symbols = store.table("symbols")
    assert names(symbols) == [".env", "DoStep", "Finalize", "Guide", "Makefile", "Orchestrate", "Vendored"]
    assert {r["name"]: r["source_tier"] for r in symbols.collect()}["Vendored"] == 3
    assert store.table("embeddings").count() == 7
    again = index_tree(spark, str(tree), store)
    assert (again.files_indexed, again.files_skipped, again.symbols) == (0, 5, 0)
    assert index_tree(spark, str(tree), store, force=True).files_indexed == 5
    (tree / "a.go").write_text("package a\n\nfunc Other() {}\n")
    assert index_tree(spark, str(tree), store).files_indexed == 1
    assert "Other" in names(store.table("symbols")) and "DoStep" not in names(store.table("symbols"))
    assert store.table("call_edges").count() == 0 and store.table("embeddings").count() == 5
    os.remove(tree / "docs/guide.md")
    assert reconcile(spark, str(tree), store) == 1 and reconcile(spark, str(tree), store) == 0
    assert "Guide" not in names(store.table("symbols"))


def test_no_model_then_backfill(spark, tree, store):
    index_tree(spark, str(tree), store, embedder=E.ZeroEmbedder())
    assert store.table("embeddings").count() == 0
    model = E.HashingEmbedder(dims=16)
    assert backfill(store, model) == 7 and backfill(store, model) == 0
    assert {r["dims"] for r in store.table("embeddings").collect()} == {16}


def test_tools(spark, tree, store, capsys):
    tools = Tools(spark, store)
    tools.index(str(tree))
    assert names(tools.feature_traverse("Orchestrate", 1)) == ["DoStep", "Orchestrate"]
    assert names(tools.feature_traverse("Orchestrate", 0)) == ["DoStep", "Finalize", "Orchestrate"]
    assert names(tools.feature_traverse("Orchestrate", 2, seed="fts10")) == ["DoStep", "Finalize", "Orchestrate"]
    assert names(tools.blast_radius("DoStep")) == ["Orchestrate"]
    assert json.loads(tools.blast_radius_json("Orchestrate")) == {"symbol": "Orchestrate", "callers": None}
    skeleton = json.loads(as_json(tools.file_skeleton("a.go"), "start_line", "id"))
    assert skeleton[0] == {"file": "a.go", "name": "Orchestrate", "kind": "function", "signature": "func Orchestrate()", "lines": "4-4", "doc": "Orchestrate runs the whole chain.", "package": "a"}
    for mode in ("keyword", "semantic", "hybrid"):
        assert "DoStep" in names(tools.search("DoStep", mode)), mode
    assert tools.search("the", "keyword").count() >= 1
    for call in (tools.file_skeleton, tools.blast_radius, tools.feature_traverse):
        with pytest.raises(ValueError):
            call("")
    assert main(["--store", store.root, "blast", "DoStep"], spark) == 0
    assert json.loads(capsys.readouterr().out)["callers"][0]["name"] == "Orchestrate"


def test_one_file_changes_one_bucket(spark, tree, store):
    index_tree(spark, str(tree), store)
    before = store._latest()[1]["tables"]["symbols"]
    (tree / "a.go").write_text("package a\n\nfunc Other() {}\n")
    index_tree(spark, str(tree), store)
    after = store._latest()[1]["tables"]["symbols"]
    assert len(before) > 1 and sum(before[b] != after.get(b) for b in before) == 1
    store.vacuum()
    assert "Other" in names(store.table("symbols")) and len(os.listdir(store.root + "/versions")) <= 2


def test_a_writer_that_comes_second_works_on_what_the_first_left(spark, store, monkeypatch):
    row = lambda path: spark.createDataFrame([(path, "h", 1, "go")], "path string, content_hash string, mod_time long, lang string")
    other, publish, tried = Store(spark, store.root), Store._publish, []

    def late(self, number, version):
        if self is store and not tried:
            tried.append(number)
            other.upsert("files", row("b.go"))
        return publish(self, number, version)

    monkeypatch.setattr(Store, "_publish", late)
    store.upsert("files", row("a.go"))
    assert names(store.table("files"), "path") == ["a.go", "b.go"] and tried


def test_a_change_is_indexed_once_it_is_left_alone(spark, tree, store):
    index_tree(spark, str(tree), store)
    one = Pass(spark, str(tree), store, quiet=60)
    (tree / "new.go").write_text("package n\n\nfunc Fresh() {}\n")
    assert one.run() is None and "Fresh" not in names(store.table("symbols"))
    assert one.run(now=time.time() + 61).files_indexed == 1 and "Fresh" in names(store.table("symbols"))
    assert one.run(now=time.time() + 61) is None
    os.utime(tree / "new.go", (1, 1))  # the same contents, another time
    assert one.run().files_indexed == 0 and one.run() is None


def _until(holds, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if holds():
            return True
        time.sleep(0.5)
    return False


def test_watch_sees_changes_and_deletions_of_their_own(spark, tree, store, tmp_path):
    seen = []
    query = watch(spark, str(tree), store, checkpoint=str(tmp_path / "checkpoint"), quiet=0.1, on_batch=seen.append)
    try:
        assert seen[0].files_indexed == 5
        os.remove(tree / "vendor/v.go")  # nothing else changes
        assert _until(lambda: "Vendored" not in names(store.table("symbols")))
        (tree / "deep/er").mkdir(parents=True)
        (tree / "deep/er/new.go").write_text("package n\n\nfunc Fresh() {}\n")
        assert _until(lambda: "Fresh" in names(store.table("symbols")))
        os.rename(tree / "deep/er/new.go", tree / "moved.go")
        assert _until(lambda: names(store.table("symbols").where("name = 'Fresh'"), "file") == ["moved.go"])
    finally:
        query.stop()
    assert checkpoint_of(spark, "a", store) != checkpoint_of(spark, "b", store)


def test_languages_that_are_added_are_parsed_by_workers(spark, store):
    def parse(source, path):
        return languages.Parsed([Symbol(line, "function") for line in source.split()])

    languages.register(languages.Language("lines", parse, (".lines",)))
    try:
        seen = files.with_hash(spark.createDataFrame([("a.lines", 1, bytearray(b"one two"))], "path string, mod_time long, content binary"))
        assert index_files(store, seen).files_indexed == 1 and names(store.table("symbols")) == ["one", "two"]
    finally:
        languages.LANGUAGES.pop()


def test_server_answers_tool_calls(spark, tree, store):
    server = Server(Tools(spark, store), str(tree))
    ask = lambda method, key=1, **params: json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": key, "method": method, "params": params})))
    call = lambda name, **arguments: ask("tools/call", name=name, arguments=arguments)["result"]
    assert ask("initialize")["result"]["serverInfo"]["name"] == "fathomer" and ask("ping")["result"] == {}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["index", "search", "file_skeleton", "feature_traverse", "blast_radius"]
    assert "indexed 5 files" in call("index")["content"][0]["text"]
    assert json.loads(call("search", query="DoStep", mode="keyword", limit=3)["content"][0]["text"])[0]["name"] == "DoStep"
    assert {s["name"] for s in json.loads(call("feature_traverse", query="Orchestrate", depth=1)["content"][0]["text"])} == {"Orchestrate", "DoStep"}
    assert len(json.loads(call("file_skeleton", path="a.go")["content"][0]["text"])) == 3
    assert json.loads(call("blast_radius", symbol="DoStep")["content"][0]["text"])["callers"][0]["name"] == "Orchestrate"
    assert call("search")["isError"] and call("search", query="x", mode="zzz")["isError"]
    assert ask("tools/call", name="nope")["error"]["code"] == -32602 and ask("nope")["error"]["code"] == -32601
    assert json.loads(server.answer("{"))["error"]["code"] == -32700 and server.answer('{"method": "notifications/initialized"}') is None
    out = io.StringIO()
    server.run(io.StringIO('{"id": 1, "method": "ping"}\n\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 1, "result": {}}


def test_debounce_on_a_stream(spark, tmp_path):
    source, schema = tmp_path / "events", "path string, ts timestamp, seq long"
    rows = [("a", "2024-01-01 00:00:00.000", 1), ("a", "2024-01-01 00:00:00.400", 2), ("a", "2024-01-01 00:00:02", 3), ("b", "2024-01-01 00:00:00.100", 4), ("z", "2024-01-01 00:10:00", 5)]
    spark.createDataFrame(rows, "path string, ts string, seq long").selectExpr("path", "cast(ts as timestamp) ts", "seq").write.parquet(str(source))
    stream = debounced(spark.readStream.schema(schema).parquet(str(source)), watermark="1 second")
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["path"], r["n"], r["last_seq"]) for r in spark.table("bursts").collect()}
    assert got == {("a", 2, 2), ("a", 1, 3), ("b", 1, 4)}  # the last is still open


class Flaky:
    model, dims = "flaky", 1

    def __init__(self, failures):
        self.failures, self.calls = list(failures), 0

    def embed(self, texts):
        self.calls += 1
        if self.failures:
            raise self.failures.pop(0)
        return [[1.0]] * len(texts)


def test_retry_and_cache():
    waits = []
    assert E.Retrying(f := Flaky([RuntimeError(), RuntimeError()]), sleep=waits.append).embed(["a"]) == [[1.0]]
    assert f.calls == 3 and 0.075 <= waits[0] <= 0.125 and 0.15 <= waits[1] <= 0.25
    with pytest.raises(RuntimeError):
        E.Retrying(Flaky([RuntimeError()] * 9), sleep=lambda s: None).embed(["a"])
    with pytest.raises(E.Permanent):
        E.Retrying(once := Flaky([E.Permanent()]), sleep=lambda s: None).embed(["a"])
    assert once.calls == 1
    cached = E.Caching(f, size=2)
    before = f.calls
    for q in ("a", "b", "a", "c", "b", "a"):
        cached(q)
    assert f.calls - before == 4  # "a" has gone when it is asked for again


class Picky:
    model, dims = "picky", 1

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[float(len(t))] for t in texts]


def test_a_failed_batch_is_tried_text_by_text(spark):
    out = E._embedded(["1", "2", "3"], ["a", "bad", "abc"], Picky())
    assert out["symbol_id"].tolist() == ["1", "3"] and [v.tolist() for v in out["vector"]] == [[1.0], [3.0]]


def test_answers_of_servers_are_checked(monkeypatch):
    monkeypatch.setattr(E, "_post", lambda *a, **k: {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert E.OpenAIEmbedder("u", "m", 1).embed(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(RuntimeError):
        E.OpenAIEmbedder("u", "m", 1).embed(["a", "b", "c"])
    with pytest.raises(RuntimeError):
        E.OpenAIEmbedder("u", "m", 2).embed(["a", "b"])
    monkeypatch.setattr(E, "_post", lambda *a, **k: {"embeddings": [[1.0]]})
    with pytest.raises(RuntimeError):
        E.OllamaEmbedder().embed(["a", "b"])


@pytest.fixture
def model_server():
    """A server with the interfaces of the three model servers; it lists what it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def reply(self, code, body):
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.reply(200 if self.path in server.known else 404, {})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body, self.headers.get("Authorization")))
            texts = body.get("input") or body.get("inputs")
            vectors = [[float(len(t)), 1.0] for t in texts]
            if self.path == "/api/embed":
                self.reply(200, {"embeddings": vectors})
            elif self.path == "/embed":
                self.reply(200, vectors)
            elif texts == ["refused"]:
                self.reply(400, {"error": "no"})
            else:
                self.reply(200, {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]})

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.known, server.asked = {"/health"}, asked
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_model_servers_are_found_and_asked(model_server):
    url = f"http://127.0.0.1:{model_server.server_address[1]}"
    assert isinstance(E.detect({"FATHOMER_EMBED_URL": url}).inner, E.TeiEmbedder)
    model_server.known = {"/api/tags"}
    assert isinstance(E.detect({"FATHOMER_EMBED_BACKEND": "auto", "FATHOMER_EMBED_URL": url}).inner, E.OllamaEmbedder)
    model_server.known = set()
    assert isinstance(E.detect({"FATHOMER_EMBED_URL": url}), E.HashingEmbedder)
    want = [[2.0, 1.0], [3.0, 1.0]]
    assert E.OllamaEmbedder(url, "m").embed(["ab", "abc"]) == E.TeiEmbedder(url).embed(["ab", "abc"]) == E.OpenAIEmbedder(url, "m", 2, "key").embed(["ab", "abc"]) == want
    assert [(path, auth) for path, _, auth in model_server.asked] == [("/api/embed", None), ("/embed", None), ("/v1/embeddings", "Bearer key")]
    assert model_server.asked[0][1] == {"model": "m", "input": ["ab", "abc"]}
    with pytest.raises(E.Permanent):
        E.OpenAIEmbedder(url, "m", 2).embed(["refused"])
    with pytest.raises(RuntimeError):
        E.OpenAIEmbedder(url, "m", 3).embed(["ab"])


def test_hashing_embedder_is_steady_and_normal():
    a, b, empty = E.HashingEmbedder(64).embed(["parse config", "parse config", ""])
    assert a == b and np.linalg.norm(a) == pytest.approx(1) and not any(empty)
    assert isinstance(E.detect({}), E.HashingEmbedder) and isinstance(E.detect({"FATHOMER_EMBED_BACKEND": "none"}), E.ZeroEmbedder)
    with pytest.raises(ValueError):
        E.detect({"FATHOMER_EMBED_BACKEND": "zzz"})


def test_synthetic_tree_and_evaluation(spark, store):
    from fathomer.plans.evaluation import evaluate, latencies
    from fathomer.plans.ingest import index_files
    from fathomer.sources.synthetic import go_files

    seen = files.with_hash(go_files(spark, 6))
    assert [r.content_hash for r in seen.orderBy("path").collect()] == [r.content_hash for r in files.with_hash(go_files(spark, 6)).orderBy("path").collect()]
    stats = index_files(store, seen)
    assert stats.files_indexed == 6 and stats.symbols >= 6 * (2 + 4 + 3)
    tools = Tools(spark, store)
    out = evaluate(tools, ["Helper0_1", "nothing like it"], mode="keyword")
    assert {(r["query"], r["name"]) for r in out.collect()} >= {("Helper0_1", "Helper0_1"), ("nothing like it", None)}
    assert [r["p"] for r in latencies(out).orderBy("p").collect()] == [50.0, 95.0, 99.0]
    assert names(tools.feature_traverse("Helper0_1", 2))[:3] == ["Helper0_1", "Helper0_2", "Helper0_3"]


def test_lists_are_cut_before_they_are_joined(spark):
    """The first ten different callees and six imports that are not empty, by their first place; no row holds a longer list."""
    from fathomer.plans.ingest import enriched, first_different

    calls = [("f", "n", None if i == 3 else "" if i < 3 else f"c{i % 40:02d}", i) for i in range(500)]
    imports = [("f", f"m{9 - i % 10}", i) for i in range(100)]
    made = spark.createDataFrame(calls, "caller_file string, caller_symbol string, callee_symbol string, seq int")
    some = first_different(made, {"file": "caller_file", "name": "caller_symbol"}, "callee_symbol", 10)
    assert sorted((r["seq"], r["callee_symbol"]) for r in some.collect()) == [(i + 1, f"c{i + 4:02d}") for i in range(10)]
    shown = "id string, file string, kind string, name string, receiver string, signature string, doc_comment string, snippet string"
    symbols = spark.createDataFrame([("1", "f", "function", "n", "", "", "", ""), ("2", "g", "function", "n", "", "", "", "")], shown)
    got = enriched(symbols, made, spark.createDataFrame(imports, "importer_file string, imported_path string, seq int"))
    texts = {r["symbol_id"]: r["text"] for r in got.collect()}
    assert texts == {"1": "f function n\ncalls: " + ", ".join(f"c{i:02d}" for i in range(4, 14)) + "\nimports: m9, m8, m7, m6, m5, m4", "2": "g function n"}


def test_each_token_of_a_batch_is_hashed_once(monkeypatch):
    import hashlib

    from fathomer.sources import embedders

    asked = []
    md5 = hashlib.md5
    monkeypatch.setattr(embedders.hashlib, "md5", lambda data, **k: (asked.append(data), md5(data, **k))[1])
    texts = ["ab abCd x1 Äb", "", "cd AB ab " * 50, "Cd"]
    found = embedders.HashingEmbedder(8).embed(texts)
    assert sorted(asked) == sorted(t.encode() for t in ("ab", "cd", "x1", "äb"))
    for text, vector in zip(["ab ab cd x1 äb", "", "cd ab ab " * 50, "cd"], found, strict=True):
        sums = [0.0] * 8
        for token in text.split():
            h = int.from_bytes(md5(token.encode()).digest()[:4], "big")
            sums[h % 8] += 1.0 if h >> 31 else -1.0
        norm = sum(x * x for x in sums) ** 0.5
        assert vector == pytest.approx([x / norm if norm else 0.0 for x in sums])
