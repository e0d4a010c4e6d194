"""Tables, and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one, removed at the end, only where the
    session is local and names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    made = tempfile.mkdtemp(prefix="termloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/termloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later readers start from the files, so a lost
    executor costs a re-read and not the work before it, and joins see its true size."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets rows one at a time where each holds a whole block. For steps that are written within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 1)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@functools.cache
def _zipped() -> str:
    root = Path(__file__).resolve().parent
    made = tempfile.mkdtemp(prefix="termloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(f"{made}/{root.name}.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return f"{made}/{root.name}.zip"


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query(spark, ...), after giving this package to the executors: their Python may not have it."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        spark.sparkContext.addPyFile(_zipped())
        return query(spark, *args)

    return run
