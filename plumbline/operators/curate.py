"""Curation of keyed measurements: duplicates, overlaps, replicates, censoring, child tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys that stand for more than one id. Ids combine before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(id_col).alias("n_ids"), F.min(id_col).alias("first_id")).where("n_ids > 1")


def leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys of the test side that the training side holds."""
    return test.select(key).distinct().join(train.select(key).distinct(), key, "left_semi")


def overlap_partition(source: DataFrame, scored: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Each source key once, with ``part``: scored, known or new."""
    j = source.select(*key).distinct().join(scored.select(*key).distinct().withColumn("_s", F.lit(1)), key, "left")
    j = j.join(known.select(*key).distinct().withColumn("_k", F.lit(1)), key, "left")
    return j.select(*key, F.when(F.col("_s").isNotNull(), "scored").when(F.col("_k").isNotNull(), "known").otherwise("new").alias("part"))


def key_set_counts(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Sizes of the three key sets' parts: only in a, only in b, and in a but neither b nor c."""
    flags = reduce(DataFrame.unionByName, [d.select(key).distinct().select(key, *[F.lit(k == s).cast("int").alias(s) for s in "abc"]) for k, d in (("a", a), ("b", b), ("c", c))])
    g = flags.groupBy(key).agg(*[F.max(s).alias(s) for s in "abc"])
    return g.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("a_not_b"), F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("b_not_a"), F.count_if((F.col("a") == 1) & (F.col("b") == 0) & (F.col("c") == 0)).alias("a_alone"))


def exclude_overlap(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def map_category(df: DataFrame, col: str, mapping: dict[str, str], out: str) -> DataFrame:
    """Named categories under a new name; other rows go."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(pairs, F.col(col))).where(F.col(out).isNotNull())


def augment(own: DataFrame, extra: DataFrame, splits: DataFrame, key: list[str]) -> DataFrame:
    """Own rows with their split and extra rows, which only ever train; an extra that own holds goes."""
    extras = extra.join(own.select(*key).distinct(), key, "left_anti").withColumn("is_extra", F.lit(True))
    rows = own.withColumn("is_extra", F.lit(False)).unionByName(extras, allowMissingColumns=True)
    return rows.join(splits, key, "left").withColumn("split", F.when(F.col("is_extra"), "train").otherwise(F.coalesce("split", F.lit("train"))))


def label_matrix(df: DataFrame, unit: str, endpoint: str, value: str, endpoints: list[str]) -> DataFrame:
    return df.groupBy(unit).pivot(endpoint, endpoints).agg(F.avg(value))


def recombine(pred: DataFrame, choice: DataFrame, keys: list[str]) -> DataFrame:
    """For each endpoint the predictions of the arm that ``choice (endpoint, arm)`` names."""
    return pred.join(choice, ["endpoint", "arm"]).select(*keys, "endpoint", "arm", "y_pred")


def top_level(levels: dict[str, float]) -> Column:
    """The highest level whose column is not null."""
    return F.greatest(*[F.when(F.col(c).isNotNull(), F.lit(v)) for c, v in levels.items()])


def censor_floor(levels: dict[str, float]) -> Column:
    return -F.log10(top_level(levels))


def replicate_mean(df: DataFrame, keys: list[str], value: str, censored: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.bool_or(censored).alias("any_censored"), F.min_by(value, order).alias("first"))


def reconcile_censored(df: DataFrame, keys: list[str], value: str, censored: str, floor: str) -> DataFrame:
    """The mean of exact readings where there is one, else the lowest floor, flagged."""
    exact = F.avg(F.when(~F.col(censored), F.col(value)))
    return df.groupBy(*keys).agg(F.coalesce(exact, F.min(F.when(F.col(censored), F.col(floor)))).alias("value"), (F.count_if(~F.col(censored)) == 0).alias("is_censored"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd"))


def censored_normal(df: DataFrame, keys: list[str], value: str, censored: str, floor: str) -> DataFrame:
    """``keys, mu, sigma, n_exact, n_censored, spread``: censored-normal fit (values at or below their floor) for each group.

    Spark reduces a group to counts, sums and squares of its exact values and a count for each distinct floor; the fit runs on
    that small table from several starts, and ``spread`` is how far their optima differ.
    """
    stats = df.groupBy(*keys, F.when(F.col(censored), F.col(floor)).alias("_floor")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"))
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        from plumbline.functions.stats_math import censored_normal_fit

        exact = g[g["_floor"].isna()]
        cens = g[g["_floor"].notna()]
        n, s, q = (float(exact[c].sum()) for c in ("n", "s", "q"))
        fits = [censored_normal_fit(n, s, q, cens["_floor"].to_numpy(float), cens["n"].to_numpy(float), shift) for shift in (-1.0, 0.0, 1.0)]
        best = min(fits, key=lambda f: f[2])
        spread = max(abs(f[0] - best[0]) for f in fits)
        return pd.DataFrame([[*g[keys].iloc[0], best[0], best[1], int(n), int(cens["n"].sum()), spread]], columns=[*keys, "mu", "sigma", "n_exact", "n_censored", "spread"])

    return stats.groupBy(*keys).applyInPandas(fit, f"{schema}, mu double, sigma double, n_exact long, n_censored long, spread double")


def child_aggregates(df: DataFrame, parent: str, values: list[str]) -> DataFrame:
    aggs = []
    for v in values:
        aggs += [F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), (F.max(v) - F.min(v)).alias(f"{v}_range"), F.stddev_pop(v).alias(f"{v}_std"), F.avg(F.abs(v)).alias(f"{v}_mean_abs")]
    return df.groupBy(parent).agg(F.count(F.lit(1)).alias("n_children"), *aggs)


def conditioned(df: DataFrame, parent: str, category: str, values: list[str], value: str) -> DataFrame:
    """Per parent the lowest, highest and mean value of each category; NULL where the parent lacks it."""
    aggs = []
    for x in values:
        v = F.when(F.col(category) == x, F.col(value))
        aggs += [F.min(v).alias(f"{x}_min"), F.max(v).alias(f"{x}_max"), F.avg(v).alias(f"{x}_mean")]
    return df.groupBy(parent).agg(*aggs)


def pair_means(df: DataFrame, a: str, b: str, value: str, keep: Column) -> DataFrame:
    """Means by unordered pair of categories over the rows that ``keep`` flags."""
    pair = F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    return df.where(keep).groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def moment_tensor(df: DataFrame, parent: str, mass: str, axes: tuple[str, str, str]) -> DataFrame:
    """Centre, radius of gyration, trace and sorted eigenvalues of the weighted inertia tensor of each parent's children.

    One aggregation of sums; the eigenvalues of the symmetric tensor follow in closed form (trigonometric) as columns.
    """
    m = F.col(mass)
    s1 = {a: F.sum(m * F.col(a)).alias(f"s_{a}") for a in axes}
    pairs = [(axes[i], axes[j]) for i in range(3) for j in range(i, 3)]
    s2 = [F.sum(m * F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in pairs]
    g = df.groupBy(parent).agg(F.count(F.lit(1)).alias("n_children"), F.sum(m).alias("w"), *s1.values(), *s2)
    c = {(a, b): F.col(f"q_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("w") for a, b in pairs}
    x, y, z = axes
    total = c[x, x] + c[y, y] + c[z, z]
    g = g.select(parent, "n_children", "w", *[(F.col(f"s_{a}") / F.col("w")).alias(f"centre_{k}") for k, a in enumerate(axes)],
                 (total - c[x, x]).alias("xx"), (total - c[y, y]).alias("yy"), (total - c[z, z]).alias("zz"), (-c[x, y]).alias("xy"), (-c[x, z]).alias("xz"), (-c[y, z]).alias("yz"), F.sqrt(F.greatest(total / F.col("w"), F.lit(0.0))).alias("gyration"))
    e = {k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    q = (e["xx"] + e["yy"] + e["zz"]) / 3
    p2 = (e["xx"] - q) ** 2 + (e["yy"] - q) ** 2 + (e["zz"] - q) ** 2 + 2 * (e["xy"] ** 2 + e["xz"] ** 2 + e["yz"] ** 2)
    g = g.withColumn("q", q).withColumn("p", F.sqrt(p2 / 6))
    b = {k: (F.col(k) - F.col("q") if k[0] == k[1] else F.col(k)) for k in e}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] ** 2) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    r = F.least(F.greatest(F.coalesce(F.try_divide(det, 2 * F.col("p") ** 3), F.lit(1.0)), F.lit(-1.0)), F.lit(1.0))
    g = g.withColumn("phi", F.acos(r) / 3)
    high = F.col("q") + 2 * F.col("p") * F.cos("phi")
    low = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + F.lit(2 * np.pi / 3))
    return g.select(parent, "n_children", "centre_0", "centre_1", "centre_2", "gyration", (3 * F.col("q")).alias("trace"), low.alias("low"), (3 * F.col("q") - low - high).alias("middle"), high.alias("high"))


def auc(df: DataFrame, keys: list[str], value: str, outcome: str) -> DataFrame:
    """``keys, n, positives, auc`` of a 0/1 outcome from counts of distinct values (ties count half)."""
    from pyspark.sql.window import Window

    v = df.where(F.col(value).isNotNull() & F.col(outcome).isNotNull()).groupBy(*keys, value).agg(F.sum(outcome).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    v = v.withColumn("wins", F.col("p") * (below + (F.col("n") - F.col("p")) / 2))
    g = v.groupBy(*keys) if keys else v.groupBy()
    return g.agg(F.sum("n").cast("long").alias("n"), F.sum("p").cast("long").alias("positives"), F.try_divide(F.sum("wins"), F.sum("p") * (F.sum("n") - F.sum("p"))).alias("auc"))


def best_threshold(df: DataFrame, value: str, outcome: str, grid: list[float]) -> DataFrame:
    """Threshold of the grid with the highest accuracy of ``value >= threshold``; ties go to the larger. One aggregation."""
    aggs = [F.avg(((F.col(value) >= t) == (F.col(outcome) == 1)).cast("double")).alias(f"a{k}") for k, t in enumerate(grid)]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("base_rate"), *aggs)
    best = F.array_max(F.array(*[F.struct(F.col(f"a{k}").alias("accuracy"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(grid)]))
    return one.select("n", "base_rate", best.alias("b")).select("n", "base_rate", "b.accuracy", "b.threshold")
