"""Feature blocks, screens of their columns, and baseline regressors over folds."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ranks import average_rank, safe_corr
from plumbline.sources.storage import materialise


def assemble_block(keys: DataFrame, blocks: list[DataFrame], key: str) -> DataFrame:
    """Feature blocks joined 1:1 onto a key list; the plan raises an error where a block lacks a key."""
    out = keys
    for i, b in enumerate(blocks):
        out = out.join(b.withColumn(f"_has{i}", F.lit(1)), key, "left")
    ok = F.when(F.greatest(*[F.col(f"_has{i}").isNull() for i in range(len(blocks))]), F.raise_error(F.lit("a block lacks a key")).cast("boolean")).otherwise(True)
    return out.withColumn("_ok", ok).where("_ok").drop("_ok", *[f"_has{i}" for i in range(len(blocks))])


def long_features(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "feature", "x")


def constant_columns(df: DataFrame, cols: list[str], keys: list[str] = []) -> DataFrame:
    """``keys, feature, constant`` from the lowest and highest value of each column in one pass."""
    g = df.groupBy(*keys).agg(*[(F.coalesce(F.min(c) == F.max(c), F.lit(True))).alias(c) for c in cols])
    return g.unpivot(keys, cols, "feature", "constant") if keys else g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("constant")) for c in cols])).alias("z")).select("z.*")


def correlations(df: DataFrame, key: str, cols: list[str], least_n: int = 50, buckets: int = 4) -> DataFrame:
    """``a, b, n, rho``: Spearman's correlation of every pair of columns (a before b) over rows that have both.

    All columns are ranked at once in long form (the column's name is the group), then one pass makes the pairs' sums.
    """
    ranked = average_rank(long_features(df, key, cols), ["feature"], "x", "rk", buckets)
    wide = ranked.groupBy(key).pivot("feature", cols).agg(F.max("rk"))
    pairs = list(combinations(cols, 2))
    both = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = wide.agg(*[F.struct(both(a, b).alias("n"), safe_corr(a, b).alias("rho")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    z = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}.n").alias("n"), F.col(f"p{i}.rho").alias("rho")) for i, (a, b) in enumerate(pairs)])).alias("z")
    return g.select(z).select("z.*").where(F.col("n") >= least_n)


def drop_collinear(corr: DataFrame, cols: list[str], bar: float) -> list[str]:
    """Columns that stay if, in their order, each goes that is at ``bar`` or more with one that stays."""
    near = {(r["a"], r["b"]) for r in corr.where(F.abs("rho") >= bar).collect()}  # a row for each pair of columns
    kept: list[str] = []
    for c in cols:
        if not any((k, c) in near for k in kept):
            kept.append(c)
    return kept


def rank_z(df: DataFrame, keys: list[str], col: str, out: str = "z", buckets: int = 1) -> DataFrame:
    """Average rank over n, standardised within the group (zero where all are alike)."""
    rk = average_rank(df, keys, col, "_rk", buckets)
    n = rk.groupBy(*keys).agg(F.count(col).alias("_n"), F.avg("_rk").alias("_m"), F.stddev_pop("_rk").alias("_s"))
    j = rk.join(n, keys) if keys else rk.crossJoin(n)
    return j.withColumn(out, F.coalesce(F.try_divide(F.col("_rk") - F.col("_m"), F.col("_s")), F.lit(0.0))).withColumn("rank_share", F.col("_rk") / F.col("_n")).drop("_rk", "_n", "_m", "_s")


def impute_scale(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Missing values by the column's median, then mean zero and sd one (ddof 1).

    The rows are written once; only columns that have gaps need a median, whose values one task sorts.
    """
    df = materialise(df.select(key, *cols), "impute-rows")  # read for the medians, the scales and by each pass over the result
    gaps = df.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in cols]).first()
    lack = [c for c in cols if gaps[c]]
    whole = df.crossJoin(materialise(df.agg(*[F.median(c).alias(f"_{c}") for c in lack]), "medians")) if lack else df
    filled = whole.select(key, *[(F.coalesce(F.col(c), F.col(f"_{c}")) if c in lack else F.col(c)).cast("double").alias(c) for c in cols])
    st = materialise(filled.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]), "scales")
    return filled.crossJoin(st).select(key, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in cols])


def explained_variance(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """``component, share, cumulative`` of MLlib's principal components."""
    from pyspark.ml.feature import PCA, VectorAssembler

    v = VectorAssembler(inputCols=cols, outputCol="v").transform(scaled)
    shares = PCA(k=len(cols), inputCol="v", outputCol="pc").fit(v).explainedVariance.toArray().tolist()
    rows = scaled.sparkSession.createDataFrame([(i + 1, float(s)) for i, s in enumerate(shares)], "component int, share double")
    return rows.withColumn("cumulative", F.sum("share").over(Window.orderBy("component")))


def naive_baseline(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, fold, mean, median`` of the labels of the other folds."""
    held = df.select(*keys, F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))).alias("fold"), value)
    return held.groupBy(*keys, "fold").agg(F.avg(value).alias("mean"), F.median(value).alias("median"))


def fold_regressor(df: DataFrame, cols: list[str], target: str, folds: int, kind: str, **params) -> DataFrame:
    """The rows with ``prediction`` by an MLlib model that was fit on the other folds: ridge, forest or gbt."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    v = VectorAssembler(inputCols=cols, outputCol="v", handleInvalid="skip").transform(df)
    make = {"ridge": lambda: LinearRegression(featuresCol="v", labelCol=target, regParam=params.get("reg", 0.1), elasticNetParam=params.get("mix", 0.0)),
            "forest": lambda: RandomForestRegressor(featuresCol="v", labelCol=target, numTrees=params.get("trees", 10), maxDepth=params.get("depth", 4), seed=7),
            "gbt": lambda: GBTRegressor(featuresCol="v", labelCol=target, maxIter=params.get("trees", 5), maxDepth=params.get("depth", 3), seed=7, **({"validationIndicatorCol": params["inner"]} if "inner" in params else {}))}[kind]
    out = None
    for k in range(folds):
        p = make().fit(v.where(F.col("fold") != k)).transform(v.where(F.col("fold") == k)).drop("v")
        out = p if out is None else out.unionByName(p)
    return out


def recoverability(df: DataFrame, cols: list[str], target: str, folds: int, least: int = 100) -> DataFrame:
    """``target, n, n_pred, linear, trees, r2``: cross-validated R2 of one column from others by a linear model on their ranks' z and by trees, and the larger of the two.

    Only rows that have the target count, and of the columns those that vary on these rows. Under ``least`` rows, or without
    such a column, the scores are null and no column counts. Rows that lack a predictor stand at its mean in the linear model and are left out by the trees.
    """
    df = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    df = materialise(df, "recoverability-rows")  # read for the ranks and by each model and tree
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(f"v_{c}") for c in cols]).first()
    cols = [c for c in cols if seen[f"v_{c}"]]
    if seen["n"] < least or not cols:
        return df.sparkSession.createDataFrame([(target, seen["n"], 0, None, None, None)], "target string, n long, n_pred int, linear double, trees double, r2 double")
    ranked = df
    for c in cols:
        ranked = rank_z(ranked, [], c, f"z_{c}", 8).drop("rank_share")
    ranked = materialise(ranked, "recoverability-ranks")
    r2 = lambda d: d.agg((1 - F.sum((F.col("prediction") - F.col(target)) ** 2) / (F.count(F.lit(1)) * F.var_pop(target))).alias("r2"))
    both = r2(fold_regressor(ranked, [f"z_{c}" for c in cols], target, folds, "ridge", reg=0.0)).select(F.col("r2").alias("linear")).crossJoin(r2(fold_regressor(df, cols, target, folds, "gbt")).select(F.col("r2").alias("trees")))
    counts = [F.lit(target).alias("target"), F.lit(seen["n"]).cast("long").alias("n"), F.lit(len(cols)).alias("n_pred")]
    return both.select(*counts, "linear", "trees", F.greatest("linear", "trees").alias("r2"))


def fold_moments(df: DataFrame, cols: list[str], fold: str = "fold") -> DataFrame:
    """``fold, n``, each column's mean (``m_i``) and the covariances of each pair (``c_i_j``, i <= j) over rows that have all of ``cols``: one pass."""
    names = {c: F.col(c).cast("double") for c in cols}
    whole = df.where(F.greatest(*[(x.isNull() | F.isnan(x)).cast("int") for x in names.values()], F.lit(0)) == 0)
    pairs = [F.covar_pop(names[cols[i]], names[cols[j]]).alias(f"c_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return whole.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(names.values())], *pairs)


def _ridge(parts: list[tuple[float, np.ndarray, np.ndarray]], reg: float) -> list[float]:
    """Coefficients and intercept of a ridge on standardised columns (the last one is the target) from moments of disjoint parts.

    The penalty is ``reg`` over the target's sd, as MLlib's ridge has it; a column that doesn't vary gets zero.
    """
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    cov = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    sd = np.sqrt(np.diag(cov))
    live = np.flatnonzero(sd[:-1] > 1e-12 * np.maximum(np.abs(mean[:-1]), 1e-300))
    w = np.zeros(len(mean) - 1)
    if len(live) and sd[-1] > 0:
        z = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live]) + reg / sd[-1] * np.eye(len(live))
        w[live] = np.linalg.lstsq(z, cov[live, -1] / (sd[live] * sd[-1]), rcond=None)[0] * sd[-1] / sd[live]
    return [*w.tolist(), float(mean[-1] - w @ mean[:-1])]


def grid_landscape(df: DataFrame, cols: list[str], target: str, folds: int, regs: list[float]) -> DataFrame:
    """``reg, fold, inner_mae, mae, winner`` of a ridge over a grid of penalties.

    The winner of a fold has the lowest error on an inner validation part (the next fold) of a model fit on the rest of the training
    side; the held-out fold takes no part in the choice. ``mae`` is the held-out error of the model fit on the whole training side.

    Two passes for any grid: means and covariances of each fold, from which all models follow (folds x penalties rows of coefficients),
    and one aggregation of all errors. Rows that lack a predictor or the target are left out. A model needs rows in another fold than the
    held-out and the validation one, so at least three folds have rows; else ValueError.
    """
    p = len(cols) + 1
    at = lambda r, i, j: r[f"c_{min(i, j)}_{max(i, j)}"]
    part = {r["fold"]: (r["n"], np.array([r[f"m_{i}"] for i in range(p)]), np.array([[at(r, i, j) for j in range(p)] for i in range(p)])) for r in fold_moments(df, [*cols, target]).collect() if r["fold"] in range(folds)}  # a row for each fold
    if len(part) < 3:
        raise ValueError("at least three folds need rows")
    fit = lambda out: [_ridge([m for f, m in part.items() if f not in out], reg) for reg in regs]
    models = [(k, fit({k}), fit({(k - 1) % folds, k})) for k in range(folds)]  # of rows in fold k: held out, and validation for the fold before
    models = df.sparkSession.createDataFrame(models, "fold int, outer array<array<double>>, inner array<array<double>>")
    y, x = F.col(target).cast("double"), [F.col(c).cast("double") for c in cols]
    whole = df.where(F.greatest(*[(c.isNull() | F.isnan(c)).cast("int") for c in [*x, y]], F.lit(0)) == 0)
    j = whole.join(F.broadcast(models), "fold")  # folds x penalties x columns numbers
    error = lambda side, g: F.avg(F.abs(sum((x[i] * F.col(side)[g][i] for i in range(len(cols))), F.col(side)[g][len(cols)]) - y))
    g = j.groupBy("fold").agg(*[error(side, i).alias(f"{side}{i}") for side in ("outer", "inner") for i in range(len(regs))])
    long = g.select("fold", F.explode(F.array(*[F.struct(F.lit(float(reg)).alias("reg"), F.col(f"outer{i}").alias("mae"), F.col(f"inner{i}").alias("inner_mae")) for i, reg in enumerate(regs)])).alias("z")).select("fold", "z.*")
    inner = long.select(((F.col("fold") + folds - 1) % folds).cast("int").alias("fold"), "reg", "inner_mae")
    out = long.select("fold", "reg", "mae").join(inner, ["fold", "reg"]).select("reg", "fold", "inner_mae", "mae")
    best = out.groupBy("fold").agg(F.min_by("reg", F.struct("inner_mae", "reg")).alias("best"))
    return out.join(best, "fold").select("reg", "fold", "inner_mae", "mae", (F.col("reg") == F.col("best")).alias("winner"))
