"""The tables on disk: buckets of Parquet folders behind numbered versions.

Each table is dealt into buckets by a hash of the file that a row belongs to, so
a write that concerns some files reads and rewrites their buckets alone.  The
file of a vector is what its symbol's id begins with (``functions.text.symbol_id``).  A
version is a small file that names the folder of every bucket.  It is put in
place by one rename that fails if another writer has taken the number, in which
case the change is worked out anew on what that writer left.  So readers see all
of a write or nothing of it, a failed write leaves the last version, and no
update is lost.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomer.operators import tables as ops
from fathomer.schema import FILE_COLUMN, KEYS, TABLES
from fathomer.workspace import hadoop_path, written

#: The column whose beginning, up to a colon, tells a row's bucket; symbol ids begin with their file.
_PLACED_BY = {**FILE_COLUMN, "embeddings": "symbol_id"}
ATTEMPTS = 10


class Store:
    """Tables below ``root``; a new store has ``buckets`` buckets, an old one those it was made with."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 32) -> None:
        self.spark, self.root, self._new_buckets = spark, root.rstrip("/"), buckets
        self._superseded: list[str] = []
        system, path = hadoop_path(spark, f"{self.root}/versions")
        system.mkdirs(path)

    # -- versions --------------------------------------------------------------------------

    def _latest(self) -> tuple[int, dict]:
        """The number and the contents of the current version."""
        system, folder = hadoop_path(self.spark, f"{self.root}/versions")
        numbers = [int(m[1]) for f in system.listStatus(folder) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName()))]
        if not numbers:
            return 0, {"buckets": self._new_buckets, "tables": {}}
        stream = system.open(hadoop_path(self.spark, f"{self.root}/versions/{max(numbers)}.json")[1])
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, version: dict) -> bool:
        """Put a version in place; False if the number is taken."""
        system, target = hadoop_path(self.spark, f"{self.root}/versions/{number}.json")
        _, draft = hadoop_path(self.spark, f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(version).encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(system.makeQualified(draft), system.makeQualified(target), none)  # fails if the target is there
        except Py4JJavaError as problem:
            system.delete(draft, False)
            if "FileAlreadyExistsException" in str(problem.java_exception):
                return False
            raise
        return True

    def version(self, name: str) -> str:
        """What changes whenever a table does."""
        folders = self._latest()[1]["tables"].get(name, {})
        return hashlib.sha256(json.dumps(folders, sort_keys=True).encode()).hexdigest()

    # -- reading ---------------------------------------------------------------------------

    def _read(self, version: dict, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        folders = version["tables"].get(name, {})
        paths = [path for b, path in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str) -> DataFrame:
        """A table; columns that an old version lacks are null."""
        return self._read(self._latest()[1], name)

    def tables(self) -> dict[str, DataFrame]:
        version = self._latest()[1]
        return {name: self._read(version, name) for name in TABLES}

    # -- writing ---------------------------------------------------------------------------

    def _change(self, files: DataFrame | None, build: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
        """Rewrite the buckets of ``files`` (one column; None: all buckets) by what ``build`` makes of their rows in all tables."""
        for _ in range(ATTEMPTS):
            number, version = self._latest()
            place = lambda column: F.pmod(F.xxhash64(F.substring_index(column, ":", 1)), F.lit(version["buckets"])).cast("int")  # noqa: B023, E731
            if files is None:
                touched = set(range(version["buckets"]))
            else:
                touched = {r["b"] for r in files.select(place(F.col(files.columns[0])).alias("b")).distinct().collect()}  # at most as many as there are buckets
            if not touched:
                return
            now = {name: self._read(version, name, touched) for name in TABLES}
            changed = {name: table for name, table in build(now).items() if table is not now[name]}
            new = {"buckets": version["buckets"], "tables": {name: dict(folders) for name, folders in version["tables"].items()}}
            made, old = [], []
            for name, table in changed.items():
                folder, found = self._written(name, table, place)
                made.append(folder)
                listed = new["tables"].setdefault(name, {})
                old += [listed.pop(str(b)) for b in touched if str(b) in listed]
                listed.update(found)
            if self._publish(number + 1, new):
                self._superseded += old
                return
            for folder in made:
                self._delete(folder)
        raise RuntimeError("other writers changed the store again and again")

    def _written(self, name: str, table: DataFrame, place: Callable[[Column], Column]) -> tuple[str, dict[str, str]]:
        """A new folder with a table's rows, and the folder of each bucket in it."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
        placed = table.select(*columns).withColumn("bucket", place(F.col(_PLACED_BY[name])))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        system, folder = hadoop_path(self.spark, path)
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return path, {n.removeprefix("bucket="): f"{path}/{n}" for n in names if n.startswith("bucket=")}

    def _delete(self, path: str) -> None:
        system, where = hadoop_path(self.spark, path)
        system.delete(where, True)

    def vacuum(self) -> None:
        """Delete the bucket folders that this object has replaced, and all versions but the last."""
        for path in self._superseded:
            self._delete(path)
        self._superseded = []
        last = self._latest()[0]
        system, folder = hadoop_path(self.spark, f"{self.root}/versions")
        for f in system.listStatus(folder):
            if f.getPath().getName() != f"{last}.json":
                system.delete(f.getPath(), False)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Put rows in place of those of equal key; columns that they lack are null."""
        kinds = {f.name: f.dataType for f in TABLES[name].fields}
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        rows = written(rows, "upsert")  # read twice, and again if another writer is first
        self._change(rows.select(_PLACED_BY[name]), lambda now: {name: ops.upsert(now[name], rows, KEYS[name])})

    def replace(self, changed: dict[str, DataFrame]) -> None:
        """Whole tables in place of those of their names, all together; other tables stay."""
        self._change(None, lambda now: changed)

    def replace_files(self, parsed: dict[str, DataFrame], paths: DataFrame) -> None:
        """Everything that some files hold, in all tables at once."""
        self._change(paths.select("path"), lambda now: ops.replace_files(now, parsed, paths))

    def delete_files(self, paths: DataFrame, *, keep_orphan_edges: bool = False) -> None:
        self._change(paths.select("path"), lambda now: ops.delete_files(now, paths, keep_orphan_edges=keep_orphan_edges))
