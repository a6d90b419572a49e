"""Statistics that compare methods over shared folds.

Sums, ranks and pairs are DataFrame work; only p-values of the few resulting rows come from a Pandas UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import stats_math as S
from plumbline.operators.ranks import average_rank


def _vector(fn, *cols: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*series)], dtype="float64")

    return run(*[F.col(c) if isinstance(c, str) else c for c in cols])


def p_f(f, d1, d2) -> Column:
    return _vector(S.f_sf, f, d1, d2)


def p_t(t, df) -> Column:
    return _vector(S.t_sf2, t, df)


def p_chi2(x, df) -> Column:
    return _vector(S.chi2_sf, x, df)


def p_range(q, k, df) -> Column:
    return _vector(lambda a, b, c: S.studentized_range_sf(a, int(b), c), q, k, df)


def long_format(scores: DataFrame, arm: str, subject: list[str], value: str) -> DataFrame:
    """``arm, subject, value``; the plan raises an error where an arm lacks a subject."""
    rows = scores.select(F.col(arm).alias("arm"), F.concat_ws("_", *subject).alias("subject"), F.col(value).alias("value"))
    n = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    ok = F.when(F.col("hi") == F.col("lo"), True).otherwise(F.raise_error(F.lit("arms have different subjects")).cast("boolean"))
    return rows.crossJoin(n.select(ok.alias("ok"))).where("ok").drop("ok")


def levene(rows: DataFrame) -> DataFrame:
    """Brown-Forsythe statistic, p, the ratio of the extreme variances, and whether a variance is zero."""
    med = rows.groupBy("arm").agg(F.median("value").alias("m"))
    z = rows.join(med, "arm").withColumn("z", F.abs(F.col("value") - F.col("m")))
    g = z.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zm"), F.var_pop("z").alias("zv"), F.var_samp("value").alias("v"))
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("zm")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("zv")).alias("within"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    between = g.crossJoin(t.select("grand")).agg(F.sum(F.col("n") * (F.col("zm") - F.col("grand")) ** 2).alias("between"))
    f = F.try_divide((F.col("nn") - F.col("k")) * F.col("between"), (F.col("k") - 1) * F.col("within"))
    out = t.crossJoin(between).select(f.alias("statistic"), (F.col("k") - 1).alias("df1"), (F.col("nn") - F.col("k")).alias("df2"), F.try_divide("hi", "lo").alias("ratio"), (F.col("lo") < 1e-12).alias("zero_variance"))
    return out.withColumn("p", p_f("statistic", "df1", "df2")).withColumn("homogeneous", (F.col("p") > 0.05) & (F.col("ratio") <= 9))


def rm_anova(rows: DataFrame) -> DataFrame:
    """F, p, error mean square and degrees of freedom of a repeated-measures analysis of variance."""
    by = lambda c: rows.groupBy(c).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    grand = rows.agg(F.avg("value").alias("g"), F.sum(F.col("value") ** 2).alias("q"), F.count(F.lit(1)).alias("nn"))
    ss = lambda c: by(c).crossJoin(grand.select("g")).agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias(f"ss_{c}"), F.count(F.lit(1)).alias(f"n_{c}"))
    t = grand.crossJoin(ss("arm")).crossJoin(ss("subject"))
    total = F.col("q") - F.col("nn") * F.col("g") ** 2
    t = t.select((F.col("n_arm") - 1).alias("df_arm"), ((F.col("n_arm") - 1) * (F.col("n_subject") - 1)).alias("df_error"), (F.col("ss_arm") / (F.col("n_arm") - 1)).alias("ms_arm"), (total - F.col("ss_arm") - F.col("ss_subject")).alias("ss_error"), "n_subject", "n_arm")
    t = t.withColumn("ms_error", F.col("ss_error") / F.col("df_error")).withColumn("f", F.try_divide("ms_arm", "ms_error"))
    return t.select("f", "df_arm", "df_error", "ms_error", "n_arm", "n_subject").withColumn("p", p_f("f", "df_arm", "df_error"))


def arm_pairs(means: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs of arms (a few), each once, with both sides' columns."""
    side = lambda s: means.select(F.col("arm").alias(f"arm_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side("a").join(side("b"), F.col("arm_a") < F.col("arm_b"))


def tukey(rows: DataFrame) -> DataFrame:
    """Tukey's HSD for all pairs on the repeated-measures error."""
    err = rm_anova(rows).select("ms_error", "df_error", "n_arm", "n_subject")
    pairs = arm_pairs(rows.groupBy("arm").agg(F.avg("value").alias("mean")), ["mean"]).crossJoin(err)
    diff = F.col("mean_a") - F.col("mean_b")
    pairs = pairs.withColumn("diff", diff).withColumn("q", F.try_divide(F.abs("diff"), F.sqrt(F.col("ms_error") / F.col("n_subject"))))
    return pairs.withColumn("p", p_range("q", "n_arm", "df_error")).select("arm_a", "arm_b", "mean_a", "mean_b", "diff", "q", "p")


def _subject_ranks(rows: DataFrame) -> DataFrame:
    return average_rank(rows, ["subject"], "value", "rank")


def friedman(rows: DataFrame) -> DataFrame:
    """Friedman's chi-squared with tie correction, and p."""
    rk = _subject_ranks(rows)
    sums = rk.groupBy("arm").agg(F.sum("rank").alias("r")).agg(F.sum(F.col("r") ** 2).alias("r2"), F.count(F.lit(1)).alias("k"))
    n = rows.agg(F.countDistinct("subject").alias("n"))
    ties = rk.groupBy("subject", "rank").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    t = sums.crossJoin(n).crossJoin(ties)
    k, nn = F.col("k"), F.col("n")
    plain = 12 * F.col("r2") / (nn * k * (k + 1)) - 3 * nn * (k + 1)
    t = t.select(F.try_divide(plain, 1 - F.col("ties") / (nn * (k**3 - k))).alias("statistic"), (k - 1).alias("df"), nn.alias("n_subjects"))
    return t.withColumn("p", p_chi2("statistic", "df"))


def conover(rows: DataFrame) -> DataFrame:
    """Conover's t after Friedman for all pairs, with raw p."""
    rk = _subject_ranks(rows)
    sums = rk.groupBy("arm").agg(F.sum("rank").alias("r"))
    n = rows.agg(F.countDistinct("subject").cast("double").alias("n"), F.countDistinct("arm").cast("double").alias("k"))
    a1 = rk.agg(F.sum(F.col("rank") ** 2).alias("a1"))
    r2 = sums.agg(F.sum(F.col("r") ** 2).alias("r2"))
    t = arm_pairs(sums, ["r"]).crossJoin(n).crossJoin(a1).crossJoin(r2)
    df = (F.col("n") - 1) * (F.col("k") - 1)
    den = F.sqrt(2 * (F.col("n") * F.col("a1") - F.col("r2")) / df)
    t = t.select("arm_a", "arm_b", F.try_divide(F.abs(F.col("r_a") - F.col("r_b")), den).alias("t"), df.alias("df"))
    return t.withColumn("p", p_t("t", "df"))


def _ranges(df: DataFrame, p: str, keys: list[str], buckets: int) -> DataFrame:
    """``df`` with the range ``_b`` of its p within ``keys``, cut at approximate quantiles, the group's ``_m`` and the rank ``_r``."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(p, F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)]), 1000).alias("_cuts"), F.count(p).alias("_m"))
    j = _attach(df, cuts, keys).withColumn("_b", F.when(F.col(p).isNotNull(), F.size(F.filter("_cuts", lambda x: x < F.col(p)))))
    sizes = j.groupBy(*keys, "_b").agg(F.count(p).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    j = _attach(j.drop("_cuts"), sizes.withColumn("_below", F.coalesce(below, F.lit(0))).drop("_n"), [*keys, "_b"])
    return j.withColumn("_r", F.col("_below") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(p))).drop("_below")


def _attach(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of one row for each of ``keys``, which may be null."""
    few = few.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [df[k].eqNullSafe(few[f"_key_{k}"]) for k in keys]
    return (df.join(few, on, "left") if keys else df.crossJoin(few)).drop(*[f"_key_{k}" for k in keys])


def _running(j: DataFrame, keys: list[str], p: str, extreme, up: bool) -> DataFrame:
    """``j`` with ``_e``: the extreme of ``_s`` over all rows of the group up to (or from) a p, peers included."""
    order = lambda c: F.col(c).asc() if up else F.col(c).desc()
    ends = j.where("_b is not null").groupBy(*keys, "_b").agg(extreme("_s").alias("_x"))
    ends = ends.withColumn("_before", extreme("_x").over(Window.partitionBy(*keys).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1))).drop("_x")
    here = extreme("_s").over(Window.partitionBy(*keys, "_b").orderBy(order(p)))
    pick = F.greatest if up else F.least
    return _attach(j.withColumn("_here", here), ends, [*keys, "_b"]).withColumn("_e", pick("_here", "_before")).drop("_here", "_before")


def holm(df: DataFrame, p: str, out: str = "p_holm", keys: list[str] = [], buckets: int = 1) -> DataFrame:
    """Holm's step-down adjustment within ``keys``; null p stay null.

    With ``buckets`` above one, a group is ranked in that many ranges, so that one of any size is dealt over many tasks.
    """
    if buckets > 1:
        j = _ranges(df, p, keys, buckets).withColumn("_s", F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p)))
        return _running(j, keys, p, F.max, True).withColumn(out, F.when(F.col(p).isNotNull(), F.col("_e"))).drop("_b", "_m", "_r", "_s", "_e")
    w = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*keys))
    return df.withColumn("_s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))).withColumn(out, F.when(F.col(p).isNotNull(), F.max("_s").over(w))).drop("_s")


def benjamini_hochberg(df: DataFrame, p: str, out: str = "p_bh", keys: list[str] = [], buckets: int = 1) -> DataFrame:
    """Benjamini-Hochberg's step-up adjustment within ``keys``; null p stay null and don't count (``buckets`` as in :func:`holm`)."""
    if buckets > 1:
        j = _ranges(df, p, keys, buckets).withColumn("_s", F.col("_m") * F.col(p) / F.col("_r"))
        return _running(j, keys, p, F.min, False).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_e")))).drop("_b", "_m", "_r", "_s", "_e")
    w = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last())
    back = Window.partitionBy(*keys).orderBy(F.col(p).desc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*keys))
    return df.withColumn("_s", m * F.col(p) / F.row_number().over(w)).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_s").over(back)))).drop("_s")


def paired(rows: DataFrame, keys: list[str] = []) -> DataFrame:
    """All pairs of arms over shared subjects: n, mean difference, its standard error, t, effect size, improvements."""
    b = rows.select(*keys, F.col("arm").alias("arm_b"), "subject", F.col("value").alias("v_b"))
    j = rows.select(*keys, F.col("arm").alias("arm_a"), "subject", F.col("value").alias("v_a")).join(b, [*keys, "subject"]).where("arm_a < arm_b")
    d = F.col("v_a") - F.col("v_b")
    g = j.groupBy(*keys, "arm_a", "arm_b").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("sd"), F.count_if(d < 0).alias("n_better"))
    g = g.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("t", F.try_divide("diff", "se")).withColumn("dz", F.try_divide("diff", "sd"))
    return g.withColumn("p", F.when(F.col("n") >= 3, p_t("t", F.col("n") - 1)))


def signed_rank(rows: DataFrame) -> DataFrame:
    """Wilcoxon's W and p of all pairs of arms; one small group for each pair."""
    b = rows.select(F.col("arm").alias("arm_b"), "subject", F.col("value").alias("v_b"))
    j = rows.select(F.col("arm").alias("arm_a"), "subject", F.col("value").alias("v_a")).join(b, "subject").where("arm_a < arm_b")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = (g["v_a"] - g["v_b"]).to_numpy()
        w, p = S.wilcoxon(d)
        sw = S.shapiro_wilk(d) if len(d) >= 4 and d.std() > 0 else (None, None)
        return pd.DataFrame([[g["arm_a"].iloc[0], g["arm_b"].iloc[0], len(d), w, p, *sw]], columns=["arm_a", "arm_b", "n", "w", "p", "shapiro_w", "shapiro_p"])

    return j.groupBy("arm_a", "arm_b").applyInPandas(run, "arm_a string, arm_b string, n long, w double, p double, shapiro_w double, shapiro_p double")


def letters(means: DataFrame, pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``arm, mean, letters``: compact letter display; arms that share a letter don't differ significantly.

    Arms in the order of their means; each longest run without a significant pair gets a letter. Runs come from the nearest
    significant partner of each arm as a window over that order.
    """
    w = Window.orderBy("mean", "arm")
    ranked = means.select("arm", "mean", F.row_number().over(w).alias("i"))
    sig = pairs.where(F.col("p") < alpha).select("arm_a", "arm_b")
    both = sig.union(sig.select("arm_b", "arm_a"))
    place = both.join(ranked.select(F.col("arm").alias("arm_a"), F.col("i").alias("ia")), "arm_a").join(ranked.select(F.col("arm").alias("arm_b"), F.col("i").alias("ib")), "arm_b").where("ib > ia")
    first = place.groupBy("ia").agg(F.min("ib").alias("stop"))
    size = ranked.agg(F.max("i").alias("k"))
    runs = ranked.join(first, ranked["i"] == first["ia"], "left").crossJoin(size).select("i", F.coalesce(F.col("stop") - 1, F.col("k")).alias("own_end"))
    up = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("end", F.min("own_end").over(up))
    new = runs.withColumn("before", F.lag("end").over(Window.orderBy("i"))).where("before is null or end > before")
    named = new.withColumn("letter", F.chr(F.lit(96) + F.row_number().over(Window.orderBy("i"))))
    j = ranked.join(named.select(F.col("i").alias("s"), "end", "letter"), (ranked["i"] >= F.col("s")) & (ranked["i"] <= F.col("end")))
    return j.groupBy("arm", "mean").agg(F.array_join(F.sort_array(F.collect_list("letter")), "").alias("letters"))


def two_by_two(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Counts, odds ratio, phi and Fisher's p of two flags."""
    g = df.groupBy(*keys).agg(*[F.count_if((F.col(a) == F.lit(x)) & (F.col(b) == F.lit(y))).alias(f"n{int(x)}{int(y)}") for x in (True, False) for y in (True, False)])
    c = {k: F.col(k).cast("double") for k in ("n11", "n10", "n01", "n00")}
    phi = F.try_divide(c["n11"] * c["n00"] - c["n10"] * c["n01"], F.sqrt((c["n11"] + c["n10"]) * (c["n01"] + c["n00"]) * (c["n11"] + c["n01"]) * (c["n10"] + c["n00"])))
    return g.withColumn("odds_ratio", F.try_divide(c["n11"] * c["n00"], c["n10"] * c["n01"])).withColumn("phi", phi).withColumn("p", _vector(lambda *v: S.fisher_exact(*map(int, v)), "n11", "n10", "n01", "n00"))


def mann_whitney(df: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    """U of the flagged side, rank-biserial correlation and a normal p, from average ranks."""
    rk = average_rank(df, keys, value, "_r")
    g = rk.groupBy(*keys).agg(F.sum(F.when(F.col(flag), F.col("_r"))).alias("rs"), F.count_if(flag).cast("double").alias("n1"), F.count_if(~F.col(flag)).cast("double").alias("n2"))
    g = g.withColumn("u", F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2)
    g = g.withColumn("rank_biserial", 1 - F.try_divide(2 * F.col("u"), F.col("n1") * F.col("n2")))
    z = F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12))
    return g.withColumn("p", _vector(lambda x: 2 * S.normal_cdf(-abs(x)), z)).drop("rs")


def residual_correlation(df: DataFrame, keys: list[str], unit: list[str], value: str, raw: str | None = None) -> DataFrame:
    """``keys, arm_a, arm_b, n, corr (, raw_corr)`` over shared units: one join on the unit's key, one aggregation."""
    side = lambda s: df.select(*keys, *unit, F.col("arm").alias(f"arm_{s}"), F.col(value).alias(f"v_{s}"), *([F.col(raw).alias(f"r_{s}")] if raw else []))
    from plumbline.operators.ranks import safe_corr

    j = side("a").join(side("b"), [*keys, *unit]).where("arm_a < arm_b")
    more = [safe_corr("r_a", "r_b").alias("raw_corr")] if raw else []
    return j.groupBy(*keys, "arm_a", "arm_b").agg(F.count(F.lit(1)).alias("n"), safe_corr("v_a", "v_b").alias("corr"), *more)
