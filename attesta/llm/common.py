"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LONG_MAX = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); one of its own only in local mode, where all share it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Tables made in the innermost of_one_step(), with their session.
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor; the files go with
    the step that made them (see of_one_step), or if it ``stays`` or there is no
    step when the driver's file system closes.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    made = None if stays else _made.get()
    if made is None:
        path, files = _path(spark, at)
        files.deleteOnExit(path)
    else:
        made.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def of_one_step():
    """Tables stored inside go at the end, but for those that stay, as a step's own result must."""
    made: list[tuple[SparkSession, str]] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for spark, at in made:
            path, files = _path(spark, at)
            files.delete(path, True)


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``df``'s schema with more fields behind it."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def hidden(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    have, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in have:
        name += "_"
    return name
