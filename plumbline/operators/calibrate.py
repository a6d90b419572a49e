"""Recalibration, placement sweeps and spread corrections from moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.errors import soft_error
from plumbline.operators.ranks import safe_corr
from plumbline.sources.storage import materialise


def r2_decomposition(df: DataFrame, keys: list[str]) -> DataFrame:
    """R2 = 2 rho k - k2 - b2 with k the spread ratio and b the scaled bias, and the gap to rho2 in parts."""
    sy = F.stddev_pop("y_true")
    g = df.groupBy(*keys).agg(safe_corr("y_true", "y_pred").alias("rho_"), F.try_divide(F.stddev_pop("y_pred"), sy).alias("k"), F.try_divide(F.avg(F.col("y_pred") - F.col("y_true")), sy).alias("b"))
    rho = F.coalesce("rho_", F.lit(0.0))
    g = g.withColumn("rho", rho).withColumn("r2", 2 * rho * F.col("k") - F.col("k") ** 2 - F.col("b") ** 2)
    return g.select(*keys, "rho", "k", "b", "r2", ((F.col("k") - F.col("rho")) ** 2).alias("scale_loss"), (F.col("b") ** 2).alias("bias_loss"))


def ols_recalibration(df: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """``keys, fold, slope, intercept`` learnt from the other folds: sums of each fold, taken from the total."""
    x, y = F.col("y_pred"), F.col("y_true")
    sums = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
    per = df.groupBy(*keys, fold).agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    tot = per.groupBy(*keys).agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    j = per.join(tot, keys).select(*keys, fold, *[(F.col(f"t_{k}") - F.col(k)).alias(k) for k in sums])
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") ** 2)
    return j.withColumn("slope", slope).select(*keys, fold, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))


def moment_calibration(df: DataFrame, keys: list[str], target: DataFrame) -> DataFrame:
    """``keys, slope, intercept`` that place predictions on a target population (``keys' endpoint, mean, sd``)."""
    g = df.groupBy(*keys).agg(safe_corr("y_true", "y_pred").alias("rho"), F.stddev_pop("y_pred").alias("sp"), F.avg("y_pred").alias("mp"))
    j = g.join(target, "endpoint").withColumn("slope", F.try_divide(F.col("rho") * F.col("sd"), F.col("sp")))
    return j.select(*keys, "rho", "slope", (F.col("mean") - F.col("slope") * F.col("mp")).alias("intercept"))


def sweep(df: DataFrame, keys: list[str], grid: list[tuple[float, float]]) -> DataFrame:
    """``keys, offset, scale, st_rae, r2`` of predictions moved by each offset and spread by each scale about their mean.

    R2 needs moments only. Soft errors are a column of one aggregation for each grid point, so the rows are read once and never
    exploded; the denominator's mean comes from a first small aggregation, which is written so that the rows need not be dealt by group to join it.
    """
    m = materialise(df.groupBy(*keys).agg(F.avg("y_true").alias("_my"), F.avg("y_pred").alias("_mp")), "means")
    j = df.join(m, keys)
    aggs = [F.sum(soft_error(F.col("_mp") + s * (F.col("y_pred") - F.col("_mp")) + o, "conf_low", "conf_high")).alias(f"e{i}") for i, (o, s) in enumerate(grid)]
    g = j.groupBy(*keys).agg(
        F.sum(soft_error("_my", "conf_low", "conf_high")).alias("base"), F.var_pop("y_true").alias("vy"), F.var_pop("y_pred").alias("vp"),
        F.covar_pop("y_true", "y_pred").alias("c"), F.avg(F.col("y_pred") - F.col("y_true")).alias("bias"), *aggs)

    def r2(o: float, s: float) -> Column:
        return 1 - F.try_divide(F.col("vy") + s * s * F.col("vp") - 2 * s * F.col("c") + (F.col("bias") + o) ** 2, F.col("vy"))

    cells = F.array(*[F.struct(F.lit(float(o)).alias("offset"), F.lit(float(s)).alias("scale"), F.try_divide(F.col(f"e{i}"), F.col("base")).alias("st_rae"), r2(o, s).alias("r2")) for i, (o, s) in enumerate(grid)])
    return g.select(*keys, F.explode(cells).alias("z")).select(*keys, "z.*")


def widen(df: DataFrame, keys: list[str], targets: DataFrame, bar: float) -> DataFrame:
    """Predictions spread about their mean to a target sd ratio (``endpoint, ratio``) where the relative gap is ``bar`` or more."""
    g = df.groupBy(*keys).agg(F.avg("y_pred").alias("_m"), F.try_divide(F.stddev_samp("y_pred"), F.stddev_samp("y_true")).alias("_r")).join(targets, "endpoint")
    factor = F.when(F.abs(F.col("ratio") - F.col("_r")) / F.col("ratio") >= bar, F.try_divide("ratio", "_r")).otherwise(F.lit(1.0))
    return df.join(materialise(g.select(*keys, "_m", factor.alias("factor")), "factors"), keys).withColumn("y_wide", F.col("_m") + F.coalesce("factor", F.lit(1.0)) * (F.col("y_pred") - F.col("_m"))).drop("_m")


def partial_correction(decomposed: DataFrame, strengths: list[float]) -> DataFrame:
    """Bias and spread after part of the way to none and to rho, and the R2 that this predicts."""
    s = F.explode(F.array(*map(F.lit, strengths))).alias("s")
    d = decomposed.select("*", s).withColumn("bs", (1 - F.col("s")) * F.col("b")).withColumn("ks", F.col("k") + F.col("s") * (F.col("rho") - F.col("k")))
    return d.withColumn("r2_s", 2 * F.col("rho") * F.col("ks") - F.col("ks") ** 2 - F.col("bs") ** 2)


def erf(x: Column) -> Column:
    """Error function by a rational approximation (Abramowitz and Stegun 7.1.26, fixed values), accurate to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def folded_mae(bias: Column, sd: Column) -> Column:
    """Mean absolute value of a normal error."""
    return sd * F.sqrt(F.lit(2 / 3.141592653589793)) * F.exp(-(bias**2) / (2 * sd**2)) + bias * erf(bias / (sd * F.sqrt(F.lit(2.0))))


def root_scan(targets: DataFrame, points: int = 4000) -> DataFrame:
    """``endpoint, bias``: biases at which a normal error of the given sd has the given mean absolute value.

    Each group meets a grid of a fixed number of points; sign changes of the difference bracket the roots, which one secant
    step refines. The mirrored root comes out as well.
    """
    from pyspark.sql.window import Window

    g = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i"))
    g = g.withColumn("x", (F.col("i") - points / 2) * (8.0 / points) * F.col("sd")).withColumn("y", folded_mae(F.col("x"), F.col("sd")) - F.col("mae"))
    w = Window.partitionBy("endpoint").orderBy("i")
    g = g.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w)).where("y0 is not null and signum(y0) <> signum(y)")
    return g.select("endpoint", (F.col("x0") - F.col("y0") * (F.col("x") - F.col("x0")) / (F.col("y") - F.col("y0"))).alias("bias"))


def population_fit(boards: DataFrame, points: int = 40, rounds: int = 6) -> DataFrame:
    """``endpoint, mean, sd, loss``: the label population that explains several submissions' (mean, sd, rho, r2) best.

    A grid over mean and sd is scored for all endpoints at once and zoomed around its best cell; each round is one plan over
    (endpoints x grid) rows.
    """
    span = boards.groupBy("endpoint").agg((F.min(F.col("mean") - 3 * F.col("sd"))).alias("m0"), (F.max(F.col("mean") + 3 * F.col("sd"))).alias("m1"), (F.min("sd") * 0.3).alias("s0"), (F.max("sd") * 4).alias("s1"))
    best = None
    for _ in range(rounds):
        cells = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("j"))
        cells = cells.withColumn("mu", F.col("m0") + F.col("i") * (F.col("m1") - F.col("m0")) / points).withColumn("sg", F.col("s0") + F.col("j") * (F.col("s1") - F.col("s0")) / points)
        k, b = F.col("sd") / F.col("sg"), (F.col("mean") - F.col("mu")) / F.col("sg")
        scored = cells.join(boards, "endpoint").groupBy("endpoint", "m0", "m1", "s0", "s1", "mu", "sg").agg(F.sum((2 * F.col("rho") * k - k**2 - b**2 - F.col("r2")) ** 2).alias("loss"))
        best = scored.groupBy("endpoint", "m0", "m1", "s0", "s1").agg(F.min(F.struct("loss", "mu", "sg")).alias("z"))
        wm, ws = 2 * (F.col("m1") - F.col("m0")) / points, 2 * (F.col("s1") - F.col("s0")) / points
        span = best.select("endpoint", (F.col("z.mu") - wm).alias("m0"), (F.col("z.mu") + wm).alias("m1"), F.greatest(F.col("z.sg") - ws, F.lit(1e-9)).alias("s0"), (F.col("z.sg") + ws).alias("s1"))
        span = span.sparkSession.createDataFrame(span.collect(), span.schema)  # one row for each endpoint
    return best.select("endpoint", F.col("z.mu").alias("mean"), F.col("z.sg").alias("sd"), F.col("z.loss").alias("loss"))
