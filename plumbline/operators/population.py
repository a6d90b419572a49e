"""The label population behind a published score: spread and mean of labels that nobody shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.calibrate import folded_mae


def _mae(k: Column, rho: Column, r2: Column, sd: Column) -> Column:
    """Mean absolute error at a spread ratio ``k``, if errors are normal; the bias follows from R2 but for its sign, which doesn't matter here."""
    label_sd = sd / k
    bias = F.sqrt(F.greatest(2 * rho * k - k**2 - r2, F.lit(0.0))) * label_sd
    return folded_mae(bias, F.greatest(label_sd * F.sqrt(F.greatest(1 - 2 * rho * k + k**2, F.lit(0.0))), F.lit(1e-12)))


def solve_population(boards: DataFrame, known: DataFrame, on: list[str], points: int = 4000, ambiguous: float = 1.5) -> DataFrame:
    """Mean and sd of the labels that give a submission its published R2 and MAE, with the other solution and a verdict.

    ``boards`` has a row for each submission: any keys, ``mean, sd`` of its predictions, ``rho, r2, mae``. ``known`` has
    ``mean, sd`` of labels that are at hand, for each value of ``on``. The ratio k of the predictions' to the labels' sd lies
    where R2 leaves the bias real; a grid of ``points`` brackets the lowest root of the MAE there and a secant step refines
    it. Grid and search are array functions within the row, so nothing is copied or shuffled but the join with ``known``.

    Added columns: ``k, bias`` (in labels' sd), ``label_sd, label_mean, mirror_mean`` (the sign of the bias can't be told; the
    mean nearer the known one comes first), ``ratio`` of their distances, ``roots`` found and ``status``: ``INFEASIBLE`` (no
    root, or a figure is missing or no number), ``IMPLAUSIBLE`` (sd over three times or under a fifth of the known one, or
    a mean over three known sd away), ``AMBIGUOUS`` (the mirrored mean is less than ``ambiguous`` times as far) or ``OK``.
    """
    names = [c for c in boards.columns if c not in on]
    d = boards.join(known.select(*on, F.col("mean").alias("_mean"), F.col("sd").alias("_sd")), on, "left")
    rho, r2, sd = F.col("rho"), F.col("r2"), F.col("sd")
    half = F.sqrt(rho**2 - r2)
    usable = (rho**2 >= r2) & (sd > 0) & ~F.isnan("mae") & ~F.isnan("mean") & ~F.isnan(sd) & ~F.isnan(rho)
    d = d.withColumn("_low", F.when(usable, F.greatest(rho - half, F.lit(1e-6)))).withColumn("_step", (rho + half - F.col("_low")) / (points - 1))
    d = d.withColumn("_low", F.when(F.col("_step") > 0, F.col("_low")))
    gap = lambda k: _mae(k, rho, r2, sd) - F.col("mae")
    d = d.withColumn("_gaps", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: gap(F.col("_low") + i * F.col("_step"))))
    crossed = F.zip_with(F.slice("_gaps", 1, points - 1), F.slice("_gaps", 2, points - 1), lambda x, y: F.coalesce((x == 0) | (x * y < 0), F.lit(False)))
    d = d.withColumn("_crossed", crossed).withColumn("_at", F.nullif(F.array_position("_crossed", F.lit(True)), F.lit(0)).cast("int"))
    d = d.withColumn("roots", F.size(F.filter("_crossed", lambda x: x))).withColumn("_y0", F.get("_gaps", F.col("_at") - 1)).withColumn("_y1", F.get("_gaps", F.col("_at")))
    d = d.withColumn("k", F.col("_low") + (F.col("_at") - 1 + F.col("_y0") / (F.col("_y0") - F.col("_y1"))) * F.col("_step"))
    d = d.withColumn("bias", F.sqrt(F.greatest(2 * rho * F.col("k") - F.col("k") ** 2 - r2, F.lit(0.0)))).withColumn("bias", F.when(F.col("k").isNotNull(), F.col("bias")))
    d = d.withColumn("label_sd", sd / F.col("k")).withColumn("_above", F.col("mean") + F.col("bias") * F.col("label_sd")).withColumn("_below", F.col("mean") - F.col("bias") * F.col("label_sd"))
    above, below = F.abs(F.col("_above") - F.col("_mean")), F.abs(F.col("_below") - F.col("_mean"))
    d = d.withColumn("label_mean", F.when(above <= below, F.col("_above")).otherwise(F.col("_below"))).withColumn("mirror_mean", F.when(above <= below, F.col("_below")).otherwise(F.col("_above")))
    near, far = F.abs(F.col("label_mean") - F.col("_mean")), F.abs(F.col("mirror_mean") - F.col("_mean"))
    d = d.withColumn("ratio", far / F.greatest(near, F.lit(1e-9)))
    odd = (F.col("label_sd") > 3 * F.col("_sd")) | (F.col("label_sd") < 0.2 * F.col("_sd")) | (near > 3 * F.col("_sd"))
    status = F.when(F.col("k").isNull() | F.col("_mean").isNull() | F.col("_sd").isNull(), "INFEASIBLE").when(odd, "IMPLAUSIBLE").when(F.col("ratio") < ambiguous, "AMBIGUOUS").otherwise("OK")
    return d.select(*on, *names, "k", "bias", "label_sd", "label_mean", "mirror_mean", "ratio", "roots", status.alias("status"))
