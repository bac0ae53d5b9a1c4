"""Continuous ingestion: a stream of ticks, each of which compares the tree with the index.

A file source reports new and changed files but no deletions, so the stream is a
clock: at each tick the tree is listed (no file is opened) and joined with the
stored paths and times.  Files that are gone are deleted, whether or not another
has changed.  Files that are new or have another time are read and indexed, but
for those that changed within the last ``quiet`` seconds: these wait for a later
tick, so that a burst of writes of a path is indexed once.  Contents whose hash
is stored already change nothing.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomer.plans.ingest import IndexStats, index_files, index_tree
from fathomer.plans.store import Store
from fathomer.sources.embedders import Embedder
from fathomer.sources.files import list_tree, read_tree, with_hash
from fathomer.sources.parsing import routed
from fathomer.workspace import work_dir, written

#: Seconds for which a path must be left alone before it is indexed.
QUIET = 0.5
#: Paths that are named to the reader; of more changes the whole tree is read.
NAMED = 5000


@dataclass
class Pass:
    """One comparison of a tree with its index."""

    spark: SparkSession
    root: str
    store: Store
    embedder: Embedder | None = None
    quiet: float = QUIET

    def changes(self, now: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(``path, mod_time`` of new and changed files that have been left alone, ``path`` of files that are gone)."""
        known = self.store.table("files").select("path", "mod_time")
        there = written(routed(list_tree(self.spark, self.root)).select("path", "mod_time"), "listing")
        latest = int(((time.time() if now is None else now) - self.quiet) * 1e9)
        changed = there.join(known, ["path", "mod_time"], "left_anti").where(F.col("mod_time") <= latest)
        return changed, known.select("path").join(there.select("path"), "path", "left_anti")

    def run(self, now: float | None = None) -> IndexStats | None:
        """Bring the index up to date; None if nothing has changed."""
        changed, gone = (written(x, "changes") for x in self.changes(now))
        none = gone.isEmpty()
        if not none:
            self.store.delete_files(gone)
        some = [r["path"] for r in changed.select("path").limit(NAMED + 1).collect()]
        if some:
            files = read_tree(self.spark, self.root, only=some if len(some) <= NAMED else None)
            files = files if len(some) <= NAMED else files.join(changed.select("path"), "path", "left_semi")
            return index_files(self.store, with_hash(files), embedder=self.embedder)
        return None if none else IndexStats(0, 0, 0, 0.0)


def checkpoint_of(spark: SparkSession, root: str, store: Store) -> str:
    """The default checkpoint of a watch: one for each tree and store."""
    name = hashlib.sha256(f"{root}\n{store.root}".encode()).hexdigest()[:16]
    return f"{work_dir(spark)}/fathomer/watch-{name}"


def watch(
    spark: SparkSession,
    root: str,
    store: Store,
    *,
    embedder: Embedder | None = None,
    checkpoint: str | None = None,
    interval: str = "1 second",
    quiet: float = QUIET,
    force: bool = False,
    on_batch: Callable[[IndexStats], None] | None = None,
) -> StreamingQuery:
    """Bring the index up to date and keep it so, until the query is stopped.

    Starts with a batch run and a comparison, so changes made while nobody
    watched are found; ``force`` indexes everything then.  ``interval`` is how
    often the tree is listed.  ``on_batch`` gets the figures of each change.
    """
    one = Pass(spark, root, store, embedder, quiet)
    first = index_tree(spark, root, store, embedder=embedder, force=force)
    one.run()
    if on_batch:
        on_batch(first)

    def tick(batch: DataFrame, number: int) -> None:
        stats = one.run()
        if stats and on_batch:
            on_batch(stats)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint or checkpoint_of(spark, root, store))
    return writer.trigger(processingTime=interval).start()
