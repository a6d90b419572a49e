"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: The white space that contracts name, as a character class for Java's and DuckDB's patterns.
SPACE = r"\x20\x09-\x0D"
#: Bytes of a text that are split at once.
PIECE = 1 << 20
# Letters A-Z become a-z, all ASCII characters but letters and digits part terms; bytes beyond ASCII stay.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z lower-cased.

    ``bytes.split`` and ``bytes.lower`` know just these characters.
    """
    return text.encode("utf-8").lower().split() if text else []


def boxed(df: DataFrame, **keys: Column) -> DataFrame:
    """``df`` with each row in one struct ``row``, beside the given columns: names used inside can't clash with the user's."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def named(column: str) -> Column:
    """A top-level column of any name, also one with dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def _has_map(kind: DataType) -> bool:
    inner = kind.fields if isinstance(kind, StructType) else []
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType) or any(_has_map(f.dataType) for f in inner)


def hashable(c: Column, kind: DataType) -> Column:
    """``c`` with each map in it, at any depth, as its entries in the order of the keys: Spark hashes and orders no maps."""
    if not _has_map(kind):
        return c
    if isinstance(kind, MapType):
        return F.sort_array(F.transform(F.map_entries(c), lambda e: F.struct(hashable(e["key"], kind.keyType).alias("k"), hashable(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: hashable(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[hashable(c[f.name], f.dataType).alias(f"f{k}") for k, f in enumerate(kind.fields)]))


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, in lists of about a megabyte."""
    data = (text or "").encode("utf-8").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
