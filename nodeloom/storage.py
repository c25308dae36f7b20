"""Tables in the shared folder, which cut lineage and outlive executors; they go when the application ends, or earlier by ``scratch``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets a step's shuffle files go as soon as its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one, kept for the application, only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app = spark.sparkContext.applicationId
        named = _temporary.get(app) or _temporary.setdefault(app, "file://" + tempfile.mkdtemp(prefix="nodeloom-"))
    return named.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as a shuffle has: rows of a small file that become many do not stay one task's."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)


_made: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes all tables that are materialized within, but for the last: what is asked for must be the last and be written."""
    _made.append([])
    done = False
    try:
        yield
        done = True
    finally:
        made = _made.pop()
        for path in made[:-1] if done else made:
            at, files = _path(spark, path)
            files.delete(at, True)
        if done and made and _made:  # what is left belongs to the block around
            _made[-1].append(made[-1])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from the files, whoever is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    if _made:
        _made[-1].append(path)
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept) if kept is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
