"""Kendall's tau of groups of any size: inversions within ranges by bits, between ranges from a grid of counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.storage import materialise, release

#: Rows of a group that one task may hold.
LIMIT = 200_000
#: Ranges that a larger group is cut into, of either column.
RANGES = 64


def inversions(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with a smaller x and a larger y, in O(n log n) array passes.

    In the order of x (ties by y) the ranks of y are sorted bit by bit from the top; at each bit, a pair whose higher bits
    agree is an inversion where the one comes before the zero.
    """
    rank = np.unique(y[np.lexsort((y, x))], return_inverse=True)[1]
    found = 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = rank >> bit & 1
        before = np.cumsum(one) - one
        high = rank >> bit + 1
        start = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        before -= np.repeat(before[start], np.diff(np.append(start, len(rank))))
        found += int(before[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return found


def grid_discordant(row: np.ndarray, col: np.ndarray, n: np.ndarray) -> int:
    """Pairs of members of different rows and columns of a grid of counts, the one with the smaller row having the larger column."""
    rows, r = np.unique(row, return_inverse=True)
    cols, c = np.unique(col, return_inverse=True)
    grid = np.zeros((len(rows), len(cols)), object)
    grid[r, c] = n.tolist()
    above = np.cumsum(grid, axis=0) - grid  # rows before
    right = np.cumsum(above[:, ::-1], axis=1)[:, ::-1] - above  # of these, columns after
    return int((grid * right).sum())


def _range(value: str, cuts: str) -> Column:
    """Number of a value's range: odd for a cut itself, even between two cuts. A frequent value is a cut, and so alone."""
    return (2 * F.size(F.filter(cuts, lambda x: x < F.col(value))) + F.array_contains(cuts, F.col(value)).cast("int")).cast("double")


def _within(parts: DataFrame) -> DataFrame:
    """``g, d``: inversions of parts that fit a task."""
    kind = dict(parts.dtypes)["g"]

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": rows["g"].iloc[:1], "d": [inversions(rows["a"].to_numpy(), rows["b"].to_numpy())]})

    return parts.groupBy("g", "part").applyInPandas(count, f"g {kind}, d bigint")


def discordant(rows: DataFrame, limit: int = LIMIT, ranges: int = RANGES) -> DataFrame:
    """``g, d``: the number of discordant pairs of each group, from ``g, a, b`` (doubles without nulls). A group may have several rows; their sum counts.

    A group of more than ``limit`` rows is cut at approximate quantiles into ranges of a and of b. Pairs of different ranges in
    both come from the grid of counts; pairs of one range of a are inversions within that range; pairs of one range of b and
    different ranges of a are inversions of (range of a, b) within that range. Ranges that are still too long go through the
    same again. Values that fill a range alone tie and need no task, so a value with a third of all rows is no hot spot.
    """
    todo, out = rows.select("g", F.lit("").alias("part"), "a", "b"), []
    own: DataFrame | None = None
    while True:
        large = todo.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("g", "part")
        large = materialise(large, "kendall-large")
        if large.isEmpty():
            out.append(_within(todo))
            break
        out.append(_within(todo.join(large, ["g", "part"], "left_anti")))
        big = todo.join(large, ["g", "part"], "left_semi")
        shares = F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)])
        cut = lambda c: F.array_distinct(F.percentile_approx(c, shares, 32 * ranges))
        cuts = big.groupBy("g", "part").agg(cut("a").alias("ca"), cut("b").alias("cb"))
        ranged = materialise(big.join(cuts, ["g", "part"]).select("g", "part", "a", "b", _range("a", "ca").alias("ra"), _range("b", "cb").alias("rb")), "kendall-ranges")
        out.append(_between(ranged))
        of_a = ranged.where("ra % 2 = 0").select("g", F.concat("part", F.lit("a"), F.col("ra").cast("int").cast("string")).alias("part"), "a", "b")
        of_b = ranged.where("rb % 2 = 0").select("g", F.concat("part", F.lit("b"), F.col("rb").cast("int").cast("string")).alias("part"), F.col("ra").alias("a"), "b")
        todo = materialise(of_a.union(of_b), "kendall-parts")
        own = todo
    del own
    d = out[0]
    for more in out[1:]:
        d = d.union(more)
    return d.groupBy("g").agg(F.sum("d").alias("d"))


def _between(ranged: DataFrame) -> DataFrame:
    """``g, d`` of the pairs that differ in both ranges: at most (2 ranges)^2 counts of a group meet, whatever its size."""
    kind = dict(ranged.dtypes)["g"]

    def count(cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": cells["g"].iloc[:1], "d": [grid_discordant(cells["ra"].to_numpy(), cells["rb"].to_numpy(), cells["n"].to_numpy())]})

    cells = ranged.groupBy("g", "part", "ra", "rb").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("g", "part").applyInPandas(count, f"g {kind}, d bigint")


def kendall_any(df: DataFrame, keys: list[str], a: str, b: str, out: str = "kendall", limit: int = LIMIT, ranges: int = RANGES) -> DataFrame:
    """``keys, n, out``: Kendall's tau-b of groups of any size (also one group of all rows, with ``keys`` empty).

    Rows that lack a value don't count; values are compared as doubles; null keys are a group. A group in which a side has one value only has
    a null tau. Counts are exact up to four thousand million rows a group. An empty table gives an empty result.
    """
    g = F.struct(F.lit(True).alias("_"), *keys)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(g.alias("g"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rows = materialise(rows, "kendall-rows")
    pairs = F.sum(F.expr("(n * (n - 1)) div 2"))
    tied = lambda *c: rows.groupBy("g", *c).agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(pairs.alias("t"))
    t = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    for name, cols in (("ta", ["a"]), ("tb", ["b"]), ("tab", ["a", "b"])):
        t = t.join(tied(*cols).withColumnRenamed("t", name), "g")
    d = materialise(discordant(rows, limit, ranges), "kendall-pairs")
    total = F.expr("(n * (n - 1)) div 2")
    j = t.join(d, "g").withColumn("t", total)
    free = (F.col("t") - F.col("ta")).cast("double") * (F.col("t") - F.col("tb")).cast("double")
    top = F.col("t") - F.col("ta") - F.col("tb") + F.col("tab") - 2 * F.col("d")
    return j.select(*[F.col(f"g.{k}").alias(k) for k in keys], "n", F.when(free > 0, top / F.sqrt(free)).alias(out))
