"""Intermediate tables in the folder that the cluster's machines share."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Since Spark 4.1; older versions ignore it and wait for the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("tables made within scratch()", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode a temporary folder where it is unset, elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own[app]


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within this, a query's shuffle files are deleted when the query ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again.

    This cuts the lineage: what stands above is computed once, and a lost executor costs
    only the tasks that it was running. Empty frames keep their schema. The write's shuffle
    files go as soon as it ends, where the session can do that: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Within this, tables that :func:`materialise` writes are listed; those still in the list at the end are deleted.

    For a step whose result is written before it ends: take the result out of the list.
    """
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for df in made:
            release(df)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`materialise` returned and nobody reads any more."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
