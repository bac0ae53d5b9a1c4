"""Source trees as tables, with the rules of what is indexed."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathomer.functions.hashing import content_hash
from fathomer.workspace import hadoop_path, new_path

FILE_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("mod_time", T.LongType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())]
)
#: Folders that are not walked into, besides those that begin with a dot.
PRUNED = ("node_modules",)


def eligible(path: Column) -> Column:
    """Whether no folder of a relative path is pruned; files may begin with a dot."""
    folders = "|".join(re.escape(x) for x in PRUNED)
    return ~path.rlike(rf"(^|/)(\.[^/]*|{folders})/")


def ignore_patterns(text: str) -> list[tuple[str, bool]]:
    """(regular expression, negated) for each line of an ignore file.

    The expressions match relative paths with ``/``; a pattern that names a
    folder matches everything in it.
    """
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line.removeprefix("\\")
        folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
        line = line.strip("/")
        if not line:
            continue
        body, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                body, i = body + ".*", i + 2
            elif line[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif line[i] == "?":
                body, i = body + "[^/]", i + 1
            elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
                inner = line[i + 1 : end]
                body, i = body + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
            else:
                body, i = body + re.escape(line[i]), i + 1
        out.append((("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), negated))
    return out


def ignored(path: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Whether a path is ignored; of several patterns that match, the last decides."""
    return reduce(lambda so_far, p: F.when(path.rlike(p[0]), F.lit(not p[1])).otherwise(so_far), patterns, F.lit(False))


def read_ignore_file(spark: SparkSession, root: str) -> str:
    """The text of the ignore file at a root, in any store; empty if there is none."""
    system, path = hadoop_path(spark, f"{root.rstrip('/')}/.gitignore")
    if not system.exists(path):
        return ""
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _base(spark: SparkSession, root: str) -> str:
    """The full address of a root, without a last slash."""
    system, path = hadoop_path(spark, root.rstrip("/") or "/")
    return system.makeQualified(path).toString().rstrip("/")


def _kept(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    patterns = ignore_patterns(read_ignore_file(spark, root))
    return rows.where(eligible(F.col("path")) & ~ignored(F.col("path"), patterns))


def _tree(spark: SparkSession, root: str, *, hidden: bool, content: bool, only: list[str] | None) -> DataFrame:
    base = _base(spark, root)
    columns = ["path", "mod_time", "length", *(["content"] if content else [])]
    if base.startswith("file:"):
        spark.dataSource.register(TreeSource)
        reader = spark.read.format(TreeSource.name()).option("content", str(content).lower()).option("hidden", str(hidden).lower())
        reader = reader if only is None else reader.option("only", json.dumps(only))
        return reader.load("/" + base.removeprefix("file:").lstrip("/")).select(*columns)
    paths = [root] if only is None else [f"{root.rstrip('/')}/{p}" for p in only if not _is_hidden(p)]
    rows = None
    if paths:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        name = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^" + re.escape(base) + "/?", "")
        rows = raw.select(name.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mod_time"), *columns[2:])
    if hidden:
        extra = _hidden_files(spark, root, base, only).select(*columns)
        rows = extra if rows is None else rows.union(extra)
    return rows if rows is not None else spark.createDataFrame([], FILE_SCHEMA).select(*columns)


def read_tree(spark: SparkSession, root: str, *, hidden: bool = True, only: list[str] | None = None) -> DataFrame:
    """The files below a root that are indexed: ``path`` (relative), ``mod_time`` (ns), ``length``, ``content``.

    Files are read by tasks, from any store.  Names that begin with ``.`` or
    ``_`` count like others unless ``hidden`` is off; folders that begin with a
    dot are not walked into.  ``only`` names the files wanted.
    """
    return _kept(spark, root, _tree(spark, root, hidden=hidden, content=True, only=only))


def list_tree(spark: SparkSession, root: str, *, hidden: bool = True) -> DataFrame:
    """``path, mod_time, length`` of the files that ``read_tree`` gives; no file is opened."""
    return _kept(spark, root, _tree(spark, root, hidden=hidden, content=False, only=None))


def _is_hidden(path: str) -> bool:
    return any(part.startswith(("_", ".")) for part in path.split("/"))


def _walked(folder: str) -> bool:
    return not folder.startswith(".") and folder not in PRUNED


#: Bytes of hidden files that are written at a time.
_HIDDEN_BYTES = 32 << 20


def _hidden_files(spark: SparkSession, root: str, base: str, only: list[str] | None) -> DataFrame:
    """Files that Spark's readers pass over, read through the store's own interface.

    They are few in most trees; the driver copies them to a table, a bounded
    number of bytes at a time.
    """
    system, top = hadoop_path(spark, root.rstrip("/") or "/")
    path, todo, rows, size = new_path(spark, "hidden-files"), [top], [], 0

    def flush() -> None:
        nonlocal rows, size
        spark.createDataFrame(rows, FILE_SCHEMA).write.mode("append").parquet(path)
        rows, size = [], 0

    wanted = None if only is None else set(only)
    while todo:
        for status in system.listStatus(todo.pop()):
            name = status.getPath().toString().removeprefix(base).lstrip("/")
            if status.isDirectory():
                if _walked(status.getPath().getName()):
                    todo.append(status.getPath())
            elif _is_hidden(name) and (wanted is None or name in wanted):
                stream = system.open(status.getPath())
                try:
                    data = bytes(stream.readAllBytes())
                finally:
                    stream.close()
                rows.append((name, status.getModificationTime() * 1_000_000, len(data), bytearray(data)))
                size += len(data)
                if size >= _HIDDEN_BYTES:
                    flush()
    flush()
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", content_hash("content"))


class _Names(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, *, content: bool, hidden: bool, only: list[str] | None) -> None:
        self.root, self.content, self.hidden, self.only = root, content, hidden, only

    def partitions(self) -> list[_Names]:
        names = self.only
        if names is None:
            names = []
            for folder, folders, files in os.walk(self.root):
                folders[:] = sorted(d for d in folders if _walked(d))
                names += [os.path.relpath(os.path.join(folder, f), self.root) for f in sorted(files)]
        names = names if self.hidden else [n for n in names if not _is_hidden(n)]
        step = 256 if self.content else 4096
        return [_Names(names[i : i + step]) for i in range(0, len(names), step)] or [_Names([])]

    def read(self, partition: _Names) -> Iterator[tuple]:
        for name in partition.names:
            full = os.path.join(self.root, name)
            try:
                about, data = os.stat(full), None
                if self.content:
                    with open(full, "rb") as f:
                        data = f.read()
                yield name, about.st_mtime_ns, about.st_size, data
            except OSError:  # what cannot be read is passed over
                continue


class TreeSource(DataSource):
    """A tree of a shared file system; options ``content`` and ``hidden`` (true or false) and ``only`` (a list of paths, in JSON)."""

    @classmethod
    def name(cls) -> str:
        return "fathomer_tree"

    def schema(self) -> T.StructType:
        return FILE_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        only = self.options.get("only")
        return _TreeReader(self.options["path"], content=self.options.get("content") != "false", hidden=self.options.get("hidden") != "false", only=json.loads(only) if only else None)
