"""Gram matrices of wide feature arrays by blocks of columns, and what follows from them: correlations, collinear columns, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.storage import materialise

#: Columns of a block; a dense product of two blocks has the square of it.
BLOCK = 256
#: Elements of the products that a task holds at once; wider tables are read once for each strip of block pairs.
HELD = 16_000_000
_SCHEMA = "i int, j int, both array<double>, sums array<double>, squares array<double>, products array<double>"


def _stacked(arrays: pd.Series, width: int) -> np.ndarray:
    """Rows of an array column; missing values, null rows and the ends of short rows are NaN, and longer rows are an error."""
    out = np.full((len(arrays), width), np.nan)
    for k, x in enumerate(arrays):
        if x is not None:
            if len(x) > width:
                raise ValueError(f"a row has {len(x)} features, more than the {width} given")
            out[k, : len(x)] = np.asarray(x, float)
    return out


def gram_blocks(df: DataFrame, col: str, width: int, block: int = BLOCK) -> DataFrame:
    """``i, j, both, sums, squares, products`` for each pair of column blocks, each a matrix laid out by rows.

    For columns p of block i and q of block j over the rows that have both: their number, the sum and the square sum of p, and the sum of the
    products; ``sums`` and ``squares`` of the other side stand in the block of (q, p), which for i < j comes as a row (j, i) without numbers and products.
    A task adds dense products of its rows and sends one row for each block pair, so the shuffle grows with the tasks and not
    with the rows. Where all products need more than HELD elements, the table is read once for each strip of block pairs.
    """
    n = -(-width // block)
    pairs = [(i, j) for i in range(n) for j in range(n)]
    strip = max(1, HELD // (4 * block * block))
    out: DataFrame | None = None
    for a in range(0, len(pairs), strip):
        part = _products(df, col, width, block, pairs[a : a + strip])
        out = part if out is None else out.union(part)
    return out


def _products(df: DataFrame, col: str, width: int, block: int, pairs: list[tuple[int, int]]) -> DataFrame:
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for b in batches:
            x = _stacked(b[col], width)
            has = ~np.isnan(x)
            x = np.where(has, x, 0.0)
            ones = has.astype(float)
            cut = lambda m, k: m[:, k * block : (k + 1) * block]
            for i, j in pairs:
                p, q = cut(x, i), cut(x, j)
                own = [cut(ones, i).T @ cut(ones, j), p.T @ q] if i <= j else [np.zeros((0, 0))] * 2
                new = [own[0], p.T @ cut(ones, j), (p * p).T @ cut(ones, j), own[1]]
                held[i, j] = new if (i, j) not in held else [s + t for s, t in zip(held[i, j], new)]
        yield pd.DataFrame([(i, j, *[m.ravel() for m in ms]) for (i, j), ms in held.items()], columns=["i", "j", "both", "sums", "squares", "products"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [np.sum(np.stack(rows[c].tolist()), axis=0) for c in ("both", "sums", "squares", "products")]
        return pd.DataFrame([(rows["i"].iat[0], rows["j"].iat[0], *sums)], columns=["i", "j", "both", "sums", "squares", "products"])

    # Partial sums meet twice, so that a pair of blocks never brings the sums of all tasks to one task.
    part = df.select(col).mapInPandas(add, _SCHEMA).withColumn("_s", F.pmod(F.xxhash64("sums"), F.lit(16)))
    some = part.groupBy("i", "j", "_s").applyInPandas(lambda rows: total(rows), _SCHEMA)
    return some.groupBy("i", "j").applyInPandas(lambda rows: total(rows), _SCHEMA)


def correlation_pairs(blocks: DataFrame, width: int, least: float, least_n: int = 2, block: int = BLOCK) -> DataFrame:
    """``a, b, n, rho``: pairs of column numbers (a < b) at an absolute Pearson correlation of ``least`` or more, over rows that have both.

    Each block pair is judged in its task; pairs of which a side is constant, or with fewer than ``least_n`` rows in common, don't come out.
    """
    other = blocks.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sums").alias("sums_b"), F.col("squares").alias("squares_b"))
    both = blocks.where("i <= j").join(other, ["i", "j"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                p, q = (min(block, width - k * block) for k in (r.i, r.j))
                n, s, ss, xy = (np.asarray(m).reshape(p, q) for m in (r.both, r.sums, r.squares, r.products))
                t, tt = (np.asarray(m).reshape(q, p).T for m in (r.sums_b, r.squares_b))
                with np.errstate(invalid="ignore", divide="ignore"):
                    va, vb = ss - s * s / n, tt - t * t / n
                    flat = (va <= 1e-12 * np.maximum(ss, 1e-300)) | (vb <= 1e-12 * np.maximum(tt, 1e-300))
                    rho = np.where(flat | (n < least_n), np.nan, (xy - s * t / n) / np.sqrt(va * vb))
                    at = np.abs(rho) >= least
                a, c = np.nonzero(at & (np.arange(p)[:, None] + r.i * block < np.arange(q)[None, :] + r.j * block))
                yield pd.DataFrame({"a": a + r.i * block, "b": c + r.j * block, "n": n[a, c].astype(np.int64), "rho": rho[a, c]})

    return both.mapInPandas(judge, "a int, b int, n long, rho double")


def keep_earlier(pairs: DataFrame, width: int) -> list[int]:
    """Columns that stay if, in their order, each goes that is paired with an earlier one that stays.

    By rounds over the pairs: a column all of whose earlier partners are decided is decided. What comes to the driver is a flag for each column.
    """
    edges = materialise(pairs.select("a", "b"), "collinear")
    spark = edges.sparkSession
    gone, kept = set(), set(range(width)) - {r["b"] for r in edges.select("b").distinct().collect()}
    open_ = set(range(width)) - kept
    while open_:
        known = spark.createDataFrame([(c, c in kept) for c in kept | gone], "a int, stays boolean")
        left = spark.createDataFrame([(c,) for c in open_], "b int")
        seen = edges.join(left, "b").join(known, "a", "left").groupBy("b").agg(F.max(F.coalesce("stays", F.lit(False))).alias("hit"), F.count_if(F.col("stays").isNull()).alias("unknown")).collect()
        out = {r["b"] for r in seen if r["hit"]}
        stay = {r["b"] for r in seen if not r["hit"] and not r["unknown"]}
        gone, kept, open_ = gone | out, kept | stay, open_ - out - stay
    return sorted(kept)


def column_moments(df: DataFrame, col: str) -> DataFrame:
    """``feature, n, middle, mean, sd`` of each column: approximate median (sketches combine within tasks) and moments over the values that are there."""
    long = df.select(F.posexplode(col).alias("feature", "x")).where("x is not null and not isnan(x)")
    return long.groupBy("feature").agg(F.count("x").alias("n"), F.percentile_approx("x", 0.5, 10_000).alias("middle"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def _parts(batches: Iterator[pd.DataFrame], col: str, width: int, rows: int = 1024) -> Iterator[np.ndarray]:
    for b in batches:
        for k in range(0, len(b), rows):
            yield _stacked(b[col].iloc[k : k + rows], width)


def _counts(df: DataFrame, col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each column the number of values that are there and their sum: one row a task, two numbers a column."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(width), np.zeros(width)
        for x in _parts(batches, col, width):
            n += (~np.isnan(x)).sum(axis=0)
            total += np.nansum(x, axis=0)
        yield pd.DataFrame({"feature": np.arange(width), "n": n, "total": total})

    found = df.select(col).mapInPandas(add, "feature int, n double, total double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas().set_index("feature").reindex(range(width))
    return found["n"].fillna(0.0).to_numpy(), found["total"].fillna(0.0).to_numpy()


def _whole_products(df: DataFrame, col: str, width: int, shift: np.ndarray, middle: np.ndarray, block: int) -> DataFrame:
    """``i, j, n, sums, products`` of pairs of column blocks (i <= j) of rows about ``shift``, missing values at ``middle``.

    No value is missing then, so one product a pair is all: a quarter of what :func:`gram_blocks` makes, and for i <= j only.
    """
    shared = df.sparkSession.sparkContext.broadcast((shift, middle))
    pairs = [(i, j) for i in range(-(-width // block)) for j in range(i, -(-width // block))]
    strip = max(1, HELD // (block * block))
    schema = "i int, j int, n double, sums array<double>, products array<double>"

    def add_to(own: list[tuple[int, int]]):
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, n, sums = {}, 0, np.zeros(width)
            for x in _parts(batches, col, width):
                x = np.where(np.isnan(x), shared.value[1], x) - shared.value[0]
                n, sums = n + len(x), sums + x.sum(axis=0)
                for i, j in own:
                    new = x[:, i * block : (i + 1) * block].T @ x[:, j * block : (j + 1) * block]
                    held[i, j] = held[i, j] + new if (i, j) in held else new
            cut = lambda i: sums[i * block : (i + 1) * block]
            for i, j in held:
                yield pd.DataFrame([(i, j, float(n), cut(i), held[i, j].ravel())], columns=["i", "j", "n", "sums", "products"])

        return add

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [np.sum(np.stack(rows[c].tolist()), axis=0) for c in ("sums", "products")]
        return pd.DataFrame([(rows["i"].iat[0], rows["j"].iat[0], rows["n"].sum(), *sums)], columns=["i", "j", "n", "sums", "products"])

    part = None
    for a in range(0, len(pairs), strip):
        some = df.select(col).mapInPandas(add_to(pairs[a : a + strip]), schema)
        part = some if part is None else part.union(some)
    part = part.withColumn("_s", F.pmod(F.xxhash64("sums"), F.lit(16)))  # as in _products
    some = part.groupBy("i", "j", "_s").applyInPandas(lambda rows: total(rows), schema)
    return some.groupBy("i", "j").applyInPandas(lambda rows: total(rows), schema)


def components(df: DataFrame, col: str, width: int, block: int = BLOCK, shares: tuple[float, ...] = (0.9, 0.95, 0.99)) -> tuple[DataFrame, DataFrame]:
    """Explained variance ``component, share, cumulative``, and ``wanted, components`` needed for each of ``shares``.

    Missing values take the column's median (columns without any value go), columns are standardised (constant ones become zero), and the
    components are those of the Gram matrix of what results. The table is read for counts and means, where columns have missing values for
    the medians of these, and for the products; the matrix of ``width`` squared comes to the driver, which bounds ``width`` to about ten thousand.
    """
    if width > 10_000:
        raise ValueError("the matrix of so many columns doesn't fit the driver")
    spark = df.sparkSession
    df = materialise(df.select(col), "components-rows")  # read two or three times
    count, total = _counts(df, col, width)
    rows_n = df.count()
    there, n = count > 0, 0.0
    shift = np.where(there, total / np.maximum(count, 1), 0.0)  # for small sums
    middle = shift.copy()
    gaps = np.flatnonzero(there & (count < rows_n))
    if len(gaps):
        wanted = F.broadcast(spark.createDataFrame([(int(k),) for k in gaps], "feature int"))  # column numbers
        long = df.select(F.posexplode(col).alias("feature", "x")).join(wanted, "feature").where("x is not null and not isnan(x)")
        for r in long.groupBy("feature").agg(F.percentile_approx("x", 0.5, 10_000).alias("middle")).collect():
            middle[r["feature"]] = r["middle"]
    gram, sums = np.zeros((width, width)), np.zeros(width)
    for r in _whole_products(df, col, width, shift, middle, block).toLocalIterator():
        p, q = (slice(k * block, min(width, (k + 1) * block)) for k in (r["i"], r["j"]))
        gram[p, q] = np.reshape(r["products"], (p.stop - p.start, q.stop - q.start))
        gram[q, p] = gram[p, q].T
        n, sums[p] = r["n"], r["sums"]
    if not n:
        return spark.createDataFrame([], "component int, share double, cumulative double"), spark.createDataFrame([], "wanted double, components int")
    cov = gram / n - np.outer(sums / n, sums / n)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = there & (sd > 1e-12 * (1 + np.abs(middle)))
    scale = np.where(live, 1 / np.where(live, sd, 1.0), 0.0)
    values = np.maximum(np.linalg.eigvalsh(cov * np.outer(scale, scale))[::-1], 0.0)[: min(int(n), int(there.sum()))]
    share = values / max(values.sum(), 1e-300)
    upto = np.cumsum(share)
    curve = spark.createDataFrame([(k + 1, float(s), float(c)) for k, (s, c) in enumerate(zip(share, upto))], "component int, share double, cumulative double")
    need = spark.createDataFrame([(float(t), int(np.searchsorted(upto, t - 1e-12) + 1)) for t in shares] if len(share) else [], "wanted double, components int")
    return curve, need
