"""The shared work folder: where lineage is cut by writing a table.

A table written here survives the loss of any executor, as opposed to blocks
that executors hold.  The folder is the one the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at a time, where the session does not say.
BATCH_BYTES = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Where the setting is missing a temporary folder serves, but only for a
    local master, whose executors are threads of the driver.
    """
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fathomer-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """What this application writes lies apart from what others do."""
    return f"{work_dir(spark)}/fathomer/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder that nothing has used before."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


_made: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, folder: str, build: Callable[[], object]) -> object:
    """What ``build`` makes of the tables in a folder, made once an application while their files stay as they are."""
    system, path = hadoop_path(spark, folder)
    files = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(path)))
    key = (spark.sparkContext.applicationId, name, folder)
    if key not in _made or _made[key][0] != files:
        _made[key] = (files, build())
    return _made[key][1]


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """``df`` as a Parquet table of the work folder, read again; ``options`` are the writer's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at a time, unless the session has set it.

    Spark's own bound is 64 MB, which the executor and the worker both hold, for
    each task and again as Python objects.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, dealt over all cores where its files make fewer partitions than there are cores.

    A file of one row group is one task, however long its rows take.  Large
    inputs have partitions enough and are read as they are.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    few = table._jdf.queryExecution().toRdd().getNumPartitions() < cores  # a scan alone: nothing runs
    return table.repartition(cores) if few else table


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of a path in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def release(spark: SparkSession) -> None:
    """Delete every table and archive that this application has left in the work folder."""
    system, path = hadoop_path(spark, _own_folder(spark))
    system.delete(path, True)
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]
