"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Every stage takes rows with ``doc_id, text, source`` and any other columns, of any name, and passes these through but for the
last one. Null texts count as empty, so the first stage drops them; rows that repeat an id or have none are allowed
at each stage, as their operators say; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import bpe_codec, line_dedup, quality_rules, simhash, source_mixing
from plumbline.sources.storage import materialise, release, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: enough words, few repeated windows, no failing host. Null texts go."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with four or more others (the largest doc_id keeps them).

    All rows stay, also those whose text becomes empty; rows without an id keep their lines.
    """
    return line_dedup.dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates. Rows that repeat it and rows without an id stay."""
    return simhash.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources' blocks are due; files follow this order."""
    return source_mixing.mixed_stream(docs)


def placed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, place``: each row's place (from 0) in the order of the table's files, null where the table isn't one of Parquet files.

    A file's rows have their number in it; what lies before a file comes from the counts of the files, for which no column is read.
    """
    row = docs.select("doc_id", "text")
    try:
        at = docs.metadataColumn("_metadata")
        row = docs.select("doc_id", "text", at["file_name"].alias("file"), at["row_index"].alias("row"))
        files = docs.select(at["file_name"].alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    except AnalysisException:
        return row.withColumn("place", F.lit(None).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return row.join(F.broadcast(files.select("f", before.alias("before"))), F.col("file") == F.col("f")).select("doc_id", "text", (F.col("before") + F.col("row")).alias("place"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, one row for each row given, with its place in the mixed stream."""
    import public_tokenizers

    return bpe_codec.round_trip(placed(docs), public_tokenizers.path(bpe_codec.VOCABULARY), public_tokenizers.PATTERN, place_col="place")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: SimHash and the tokenizer have no SQL twin; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's tables go when its result is written, and its result goes when the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            kept = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(kept)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
