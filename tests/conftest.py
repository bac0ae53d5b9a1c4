"""One local session for all tests; workers find the repository."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), os.environ.get("PYTHONPATH", "")])
os.environ["OMP_NUM_THREADS"] = "1"
sys.path.insert(0, str(HERE))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf(request) -> str:
    folder = DATA / "sf0.001"
    if not folder.is_dir():
        pytest.skip("the test tables are not here")
    return str(folder)


@pytest.fixture(scope="session")
def oracle():
    """Rows of a query and of its SQL at a size, in a form that can be compared."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def normal(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(columns), sorted(tuple(repr(tuple(r[i]) if isinstance(r[i], list) else r[i]) for i in order) for r in rows)

    def compare(query, sql, spark, folder):
        base = duckdb.connect()
        for t in tables:
            base.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
        df = query(spark, folder)
        found = base.execute(sql)
        names = [c[0] for c in found.description]
        return normal([tuple(r) for r in df.collect()], df.columns), normal(found.fetchall(), names)

    return compare
