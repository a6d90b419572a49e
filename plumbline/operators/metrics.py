"""Row and group metrics of predictions against labels with intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.errors import soft_error
from plumbline.operators.ranks import average_rank, safe_corr, spearman
from plumbline.sources.storage import materialise


def score(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, st_rae, mae, rmse, bias, r2, pearson`` of ``y_pred`` against ``y_true, conf_low, conf_high``.

    ST-RAE is the sum of soft errors over that of a constant predictor at the group's own mean, null where this is zero.
    The means are a first aggregation that is written (a row for each group) and joins back, so that both passes combine before
    they shuffle: Spark knows the written table's size and need not deal all rows by group to join it. Rows without a label or
    prediction don't count; they are left out by the sums, as a filter would compute the prediction a second time.
    """
    there = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    means = materialise(df.where(there).groupBy(*keys).agg(F.avg("y_true").alias("_m")), "means")
    err, n = F.when(there, F.col("y_pred") - F.col("y_true")), F.count(F.when(there, 1))
    soft = lambda c: F.sum(F.when(there, soft_error(c, "conf_low", "conf_high")))
    return (
        df.join(means, keys)
        .groupBy(*keys)
        .agg(
            n.alias("n"),
            F.try_divide(soft("y_pred"), soft("_m")).alias("st_rae"),
            F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(err).alias("bias"),
            (1 - F.try_divide(F.sum(err * err), n * F.var_pop(F.when(there, F.col("y_true"))))).alias("r2"),
            safe_corr("y_true", "y_pred").alias("pearson"),
        )
    )


def macro(scores: DataFrame, keys: list[str], value: str, members: int, out: str = "macro") -> DataFrame:
    """``keys, out``: the plain mean over the endpoints; the plan raises an error where one is missing."""
    n = F.count(value)
    return scores.groupBy(*keys).agg(F.when(n == members, F.avg(value)).otherwise(F.raise_error(F.lit("a macro score lacks an endpoint")).cast("double")).alias(out))


def macro_scores(df: DataFrame, keys: list[str], endpoint: str = "endpoint", members: int = 3) -> DataFrame:
    return macro(score(df, [*keys, endpoint]), keys, "st_rae", members, "value")


def _kendall(x: np.ndarray, y: np.ndarray) -> float | None:
    """Tau-b by counting inversions with a merge over powers of two."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    ties = lambda v: int((c := np.unique(v, return_counts=True, axis=0)[1]) @ (c - 1) // 2)
    tx, ty, txy = ties(x), ties(y), ties(np.column_stack([np.unique(x, return_inverse=True)[1], y]))
    swaps, width = 0, 1
    while width < n:
        for lo in range(0, n - width, 2 * width):
            a, b = y[lo : lo + width], y[lo + width : lo + 2 * width]
            swaps += int((len(a) - np.searchsorted(a, b, side="right")).sum())
            y[lo : lo + 2 * width] = np.sort(y[lo : lo + 2 * width], kind="stable")
        width *= 2
    total = n * (n - 1) // 2
    if total == tx or total == ty:
        return None
    return (total - tx - ty + txy - 2 * swaps) / np.sqrt(float(total - tx) * float(total - ty))


def kendall(df: DataFrame, keys: list[str], a: str, b: str, out: str = "kendall") -> DataFrame:
    """``keys, n, out``: Kendall's tau-b in groups of the size of a fold (each fits one task), in O(n log n)."""
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tau = _kendall(g[a].to_numpy(), g[b].to_numpy())
        return pd.DataFrame([[*g[keys].iloc[0], len(g), tau]], columns=[*keys, "n", out])

    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b).groupBy(*keys).applyInPandas(run, f"{schema}, n long, {out} double")


def partial_spearman(df: DataFrame, keys: list[str], a: str, b: str, control: str) -> DataFrame:
    """Spearman's correlation of a and b with the control's share taken out, from the three plain ones."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(control).isNotNull())
    for c in (a, b, control):
        rows = average_rank(rows, keys, c, f"_r_{c}")
    pair = lambda x, y: safe_corr(f"_r_{x}", f"_r_{y}")
    r = rows.groupBy(*keys).agg(pair(a, b).alias("r_ab"), pair(a, control).alias("r_ac"), pair(b, control).alias("r_bc"))
    top = F.col("r_ab") - F.col("r_ac") * F.col("r_bc")
    return r.withColumn("partial", F.try_divide(top, F.sqrt((1 - F.col("r_ac") ** 2) * (1 - F.col("r_bc") ** 2))))


def repeat_average(df: DataFrame, keys: list[str], value: str = "y_pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_repeats"))


def unit_difficulty(df: DataFrame) -> DataFrame:
    """Per unit and endpoint: mean over the arms of the absolute repeat-mean error, its spread, the mean soft error."""
    err = F.col("y_pred") - F.col("y_true")
    by_arm = df.groupBy("unit_id", "endpoint", "arm").agg(F.avg(err).alias("err"), F.stddev_samp(err).alias("sd"), F.avg(soft_error("y_pred", "conf_low", "conf_high")).alias("soft"))
    return by_arm.groupBy("unit_id", "endpoint").agg(
        F.avg(F.abs("err")).alias("abs_error"), F.stddev_samp("err").alias("arm_sd"), F.avg("sd").alias("repeat_sd"), F.avg("soft").alias("soft")
    )


def hard_easy(difficulty: DataFrame, share: float = 0.1) -> DataFrame:
    """Flags per endpoint: hard and easy by absolute and by soft error (outer deciles), disagreement by the arms' spread."""
    q = lambda c, s: F.percentile(c, F.lit(s))
    edges = difficulty.groupBy("endpoint").agg(
        q("abs_error", 1 - share).alias("hi_abs"), q("abs_error", share).alias("lo_abs"), q("soft", 1 - share).alias("hi_soft"), q("arm_sd", 1 - share).alias("hi_sd")
    )
    j = difficulty.join(edges, "endpoint")
    return j.select(
        "unit_id", "endpoint",
        (F.col("abs_error") >= F.col("hi_abs")).alias("hard"),
        (F.col("abs_error") <= F.col("lo_abs")).alias("easy"),
        (F.col("soft") >= F.col("hi_soft")).alias("hard_soft"),
        (F.col("arm_sd") >= F.col("hi_sd")).alias("disputed"),
    )


def running_best(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the lowest value so far; the series of one key is short, or is pre-aggregated by the caller."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.min(value).over(w))


__all__ = ["score", "macro", "macro_scores", "kendall", "spearman", "partial_spearman", "repeat_average", "unit_difficulty", "hard_easy", "running_best"]
