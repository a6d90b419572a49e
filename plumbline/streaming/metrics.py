"""Structured Streaming over growing metric files: each completed epoch once, and keyed upserts of scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.audit import last_rows
from plumbline.sources.storage import shared_dir


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def epochs(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key with merged metrics; in update mode a key comes out again only when its rows change it."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("highest"), F.min(value).alias("lowest"))


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared store; none where it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _whole(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The numbers of the deltas (``d``) or bases (``c``) in ``root`` that were written to their end."""
    found = [int(x[1:]) for x in _children(spark, root) if x[0] == kind and x[1:].isdigit()]
    return sorted(k for k in found if "_SUCCESS" in _children(spark, f"{root}/{kind}{k}"))


def _buckets(spark: SparkSession, path: str) -> list[int]:
    return [int(x.partition("=")[2]) for x in _children(spark, path) if x.startswith("_bucket=")]


def upsert_root(spark: SparkSession, name: str) -> str:
    """The folder of the stream ``name``."""
    return f"{shared_dir(spark)}/plumbline/stream-{name}"


def pending_deltas(spark: SparkSession, root: str) -> list[int]:
    """Batches that no compaction holds yet."""
    last = max(_whole(spark, root, "c"), default=-1)
    return [k for k in _whole(spark, root, "d") if k > last]


def bucket_bases(spark: SparkSession, root: str) -> dict[int, int]:
    """For each bucket the newest compaction that wrote it."""
    return {b: k for k in _whole(spark, root, "c") for b in _buckets(spark, f"{root}/c{k}")}


def _newest(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each key that of the latest batch; a batch has one row for each key."""
    named = [F.col("row").getField(k).alias(f"k{i}") for i, k in enumerate(keys)]
    return parts.select("row", "batch", *named).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max_by("row", "batch").alias("row"), F.max("batch").alias("batch")).select("row", "batch")


def _delta_paths(spark: SparkSession, root: str, deltas: list[int]) -> list[str]:
    return [f"{root}/d{k}/_bucket={b}" for k in deltas for b in _buckets(spark, f"{root}/d{k}")]


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths)


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col("row").getField(k) for k in keys]), F.lit(buckets)))


def _compact(spark: SparkSession, root: str, keys: list[str], buckets: int, schema, upto: int) -> None:
    """Merges the pending deltas into the buckets that they touch; other buckets stay where they are.

    The new bases are complete before anything is deleted, and what they replace is told by number, so a run that is cut off at any point leaves
    a readable state and is made good by the next one.
    """
    deltas = [k for k in pending_deltas(spark, root) if k <= upto]
    touched = sorted({b for k in deltas for b in _buckets(spark, f"{root}/d{k}")})
    bases = bucket_bases(spark, root)
    paths = _delta_paths(spark, root, deltas) + [f"{root}/c{bases[b]}/_bucket={b}" for b in touched if b in bases]
    merged = _newest(_read(spark, paths, schema), keys) if paths else spark.createDataFrame([], schema)
    # A bucket is one file of the new base: rows meet by bucket before they are written.
    _bucketed(merged, keys, buckets).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/c{upto}")
    for b in touched:
        if b in bases:
            _remove(spark, f"{root}/c{bases[b]}/_bucket={b}")
    for k in _whole(spark, root, "d"):
        if k <= upto:
            _remove(spark, f"{root}/d{k}")


def run_upsert(stream: DataFrame, keys: list[str], mode: str = "update", order: list[str] | None = None, name: str | None = None, buckets: int = 32, compact_every: int = 8) -> DataFrame:
    """Runs a stream over all that is there and upserts each micro-batch by ``keys`` into a table in the shared folder.

    The table is a log of bucketed deltas over bases: a batch writes its own rows only (of rows that repeat a key the last by ``order``), and
    after ``compact_every`` batches the pending deltas are merged into the buckets that they touch. So a batch costs what it holds and
    not what the table holds. A batch that is replayed after a failure overwrites its delta, so the outcome is the same. A stream with
    a ``name`` goes on where its last run ended, whichever driver ran it. Null keys match each other; columns may have any name.
    """
    spark = stream.sparkSession
    root = upsert_root(spark, name or uuid.uuid4().hex)
    stored = stream.limit(0).select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("batch")).schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        if batch_id > max(_whole(own, root, "c"), default=-1):  # else a compaction holds it already
            rows = last_rows(batch, keys, order).select(F.struct("*").alias("row"), F.lit(batch_id).cast("long").alias("batch"))
            _bucketed(rows, keys, buckets).write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/d{batch_id}")
            if len(pending_deltas(own, root)) >= compact_every:
                _compact(own, root, keys, buckets, stored, batch_id)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start()
    q.awaitTermination()
    paths = _delta_paths(spark, root, pending_deltas(spark, root))
    bases = [f"{root}/c{k}/_bucket={b}" for b, k in bucket_bases(spark, root).items()]
    if not paths and not bases:
        return spark.createDataFrame([], stream.schema)
    rows = _read(spark, [*bases, *paths], stored)
    return (_newest(rows, keys) if paths else rows).select("row.*")
