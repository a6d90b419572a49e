"""The book of registered queries: each module of this package adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.errors import rounded

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its own name, with its SQL twin if there is one."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def tidy(df: DataFrame, plain: str = "", longs: str = "", doubles: str = "", digits: int = 6) -> DataFrame:
    """Columns for a result: as they are, as bigint, and as doubles rounded alike in both engines."""
    cols = [F.col(c) for c in plain.split()] + [F.col(c).cast("long").alias(c) for c in longs.split()]
    return df.select(*cols, *[rounded(F.col(c).cast("double"), digits).alias(c) for c in doubles.split()])


def r(*names: str, digits: int = 6) -> str:
    """SQL for rounded columns of the same names."""
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in " ".join(names).split())


def n(*names: str) -> str:
    return ", ".join(f"cast({c} as bigint) as {c}" for c in " ".join(names).split())
