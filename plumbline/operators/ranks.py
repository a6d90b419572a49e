"""Average ranks, rank correlations and quantile bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.storage import materialise

#: Ranges, at least, into which a group is cut that is ranked by ranges.
RANGES = 64
#: Accuracy of the approximate quantiles between which exact ones are looked for.
NEAR = 10_000


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, buckets: int = 1) -> DataFrame:
    """``df`` with the average rank of ``value`` within ``keys`` (ties share their mean rank; nulls get none).

    With ``buckets`` above one, each group is cut at approximate quantiles into ranges that are ranked by
    themselves and shifted by the counts of the ranges below: a group of any size is dealt over many tasks, and the
    ranks stay exact, since equal values fall into one range.
    """
    peers = F.count(F.lit(1))
    if buckets <= 1:
        w = Window.partitionBy(*keys).orderBy(value)
        tied = Window.partitionBy(*keys, value)
        return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(w) - F.count(F.when(F.col(value).isNull(), 1)).over(Window.partitionBy(*keys)) + (peers.over(tied) - 1) / 2.0))
    return average_ranks(df, keys, {value: out}, buckets)


def average_ranks(df: DataFrame, keys: list[str], outs: dict[str, str], buckets: int = RANGES) -> DataFrame:
    """``df`` with the average rank of each column that ``outs`` names, under the name that it gives; see :func:`average_rank` with ``buckets``.

    The cuts of all columns come from one pass; the rows are written once with the numbers of their ranges. What counts a range and what ranks
    it then reads the same numbers: approximate quantiles that are computed twice need not be equal, nor are sums of doubles.
    """
    buckets = max(buckets, RANGES)
    shares = F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)])
    cuts = df.groupBy(*keys).agg(*[F.percentile_approx(v, shares, 32 * buckets).alias(f"_cuts_{o}") for v, o in outs.items()])
    cuts = materialise(cuts, "rank-cuts")  # a row for each group: as a written table its size is known, and the rows needn't be dealt by group
    j = df.join(cuts, keys) if keys else df.crossJoin(cuts)
    ranges = [F.when(F.col(v).isNotNull(), F.size(F.filter(f"_cuts_{o}", lambda x: x < F.col(v)))).alias(f"_b_{o}") for v, o in outs.items()]
    j = materialise(j.select(*df.columns, *ranges), "rank-ranges")
    ranked = j
    for v, o in outs.items():
        b = f"_b_{o}"
        sizes = j.where(F.col(b).isNotNull()).groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
        below = sizes.withColumn("_below", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        w = Window.partitionBy(*keys, b).orderBy(v)
        ranked = ranked.withColumn("_r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, b, v)) - 1) / 2.0)
        ranked = ranked.join(below, [*keys, b], "left").withColumn(o, F.col("_r") + F.col("_below")).drop("_r", b, "_below")
    return ranked.select(*df.columns, *outs.values())


def hash_number(df: DataFrame, keys: list[str], digest: Column, tie: str, out: str, total: str, digits: int = 3) -> DataFrame:
    """``df`` with each row's number (from 1) within ``keys`` in the order of a hex digest, equal ones by ``tie``, and the group's size.

    Digests fall evenly into the ranges of their first ``digits``: each range is numbered by itself and shifted by the counts of
    the ranges below, so one group of all rows is spread over all tasks. The numbers are those of one window over the group. Keys
    that are null form a group.
    """
    j = df.withColumn("_h", digest).withColumn("_p", F.substring("_h", 1, digits)).withColumn("_g", F.struct(F.lit(True), *keys))
    sizes = j.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy("_g")).alias(total))
    w = Window.partitionBy("_g", "_p").orderBy("_h", tie)
    numbered = j.withColumn("_r", F.row_number().over(w)).join(below.hint("merge"), ["_g", "_p"])  # rows of a small file that were multiplied look small enough to broadcast
    return numbered.withColumn(out, F.col("_r") + F.col("_below")).drop("_h", "_p", "_g", "_r", "_below")


def order_number(df: DataFrame, keys: list[str], by: str, out: str) -> DataFrame:
    """``df`` with each row's number (from 1) within ``keys`` in the order of ``by``, which may have any type that sorts.

    The rows are cut into ranges of (keys, by) and written with their range's number: each range is numbered by itself and shifted by the
    counts of the group's ranges below, so a group of any size is spread. Equal rows of a group are numbered in any order; null keys form a group.
    """
    cut = materialise(df.repartitionByRange(*keys, by).withColumn("_p", F.spark_partition_id()).withColumn("_g", F.struct(F.lit(True), *keys)), "ranges")
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    below = cut.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n")).select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    numbered = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_p").orderBy(by))).join(below, ["_g", "_p"])
    return numbered.withColumn(out, F.col("_r") + F.col("_below")).drop("_p", "_g", "_r", "_below")


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation, null where a side is constant (to rounding)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    flat = (F.max(a) - F.min(a) <= 1e-12) | (F.max(b) - F.min(b) <= 1e-12)
    return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(df: DataFrame, keys: list[str], a: str, b: str, out: str = "spearman", buckets: int = 1) -> DataFrame:
    """``keys, n, out``: Spearman's correlation of two columns in each group over rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = average_ranks(both, keys, {a: "_ra", b: "_rb"}, buckets) if buckets > 1 else average_rank(average_rank(both, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr("_ra", "_rb").alias(out))


def percentiles(df: DataFrame, keys: list[str], value: str | Column, shares: list[float], out: str) -> DataFrame:
    """``keys, out``: an array of the exact quantiles at ``shares`` with linear interpolation; nulls don't count, null keys are a group.

    Approximate quantiles bracket each share. One pass then counts what lies between the brackets and keeps the distinct values within them
    with their counts, a few thousandths of all; running counts over these find the wanted places. No task holds the values of a
    group. A group of which a bracket missed its place (the sketch gives no guarantee for that) is done by Spark's own aggregate.
    """
    g = F.struct(F.lit(True).alias("_"), *keys)
    rows = df.select(g.alias("_g"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v"))
    rows = materialise(rows, "quantile-values")  # read twice; sums of doubles may differ when they are computed again
    ends = [min(max(s + e / NEAR, 0.0), 1.0) for s in shares for e in (-2, 2)]
    marks = rows.groupBy("_g").agg(F.percentile_approx("_v", F.array(*map(F.lit, ends)), NEAR).alias("_m"), F.count("_v").alias("_n"))
    marks = materialise(marks.select("_g", "_m", "_n", F.array_sort(F.array_distinct("_m")).alias("_d")), "quantile-marks")
    v, m = F.col("_v"), F.col("_m")
    within = F.lit(False)
    for k in range(len(shares)):
        within |= (v >= m[2 * k]) & (v <= m[2 * k + 1])
    placed = rows.join(marks, "_g").select("_g", "_v", F.size(F.filter("_d", lambda x: x < v)).alias("_s"), F.when(within, v).alias("_x"))
    counted = placed.groupBy("_g", "_s", "_x").agg(F.count("_v").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_s", F.col("_x").asc_nulls_first()))  # what lies outside comes first: a bracket's lower end closes its part
    places = counted.withColumn("_to", upto).join(marks.select("_g", "_n"), "_g")
    n, to, picks = F.col("_n") - 1, F.col("_to"), []
    at = lambda p: (to - F.col("_c") <= p) & (p < to)
    for k, s in enumerate(shares):
        picks += [F.max(F.when(at(F.floor(n * s)), F.col("_x"))).alias(f"_l{k}"), F.max(F.when(at(F.ceil(n * s)), F.col("_x"))).alias(f"_h{k}")]
    found = places.groupBy("_g").agg(F.max("_n").alias("_n"), *picks)
    one = lambda k, s: F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * (n * s - F.floor(n * s))
    found = materialise(found.select("_g", F.when(F.col("_n") > 0, F.array(*[one(k, s) for k, s in enumerate(shares)])).alias(out)), "quantiles")
    missed = found.where(F.exists(out, lambda x: x.isNull())).select("_g")
    if not missed.isEmpty():
        plain = rows.join(missed, "_g", "left_semi").groupBy("_g").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias(out))
        found = found.join(missed, "_g", "left_anti").union(plain)
    return found.select(*[F.col(f"_g.{k}").alias(k) for k in keys], out)


def medians(df: DataFrame, keys: list[str], value: str | Column, out: str) -> DataFrame:
    """``keys, out``: the exact median of each group."""
    return percentiles(df, keys, value, [0.5], out).withColumn(out, F.col(out)[0])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``keys, share, q``: exact quantiles with linear interpolation."""
    wide = percentiles(df, keys, value, shares, "_q")
    return wide.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("_q").alias("q"))).alias("_z")).select(*keys, F.col("_z.share").alias("share"), F.col("_z.q").alias("q"))


def quantile_bin(df: DataFrame, keys: list[str], value: str, bins: int, out: str = "bin") -> DataFrame:
    """``df`` with the quantile bin (0 up) of ``value`` within ``keys``; equal edges are one, the lowest value is in bin 0.

    The edges are one small row for each group, so they join by AQE's choice, and rows are never ranked.
    """
    shares = [k / bins for k in range(bins + 1)]
    edges = percentiles(df, keys, value, shares, "_edges").withColumn("_edges", F.array_distinct("_edges"))
    j = df.join(edges, keys) if keys else df.crossJoin(edges)
    below = F.size(F.filter(F.slice("_edges", 1, F.size("_edges") - 1), lambda e: e < F.col(value)))
    return j.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("_edges")
