"""Ensembles and calibration (sections I and J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import calibrate as K
from plumbline.operators import ensemble as I
from plumbline.operators import metrics as M
from plumbline.operators import offsets as O
from plumbline.operators import population as P
from plumbline.operators import ranks as R
from plumbline.plans.book import query, r, tidy
from plumbline.plans.metric_queries import _P_SCORES, corr_sql, rank_sql
from plumbline.sources import fixtures as X
from plumbline.sources.fixtures import twin

ARMS = [a[0] for a in X.ARMS]
AE = ["arm", "endpoint"]
WEIGHTS = (("A", "plain", 0.5), ("A", "deadzone", 0.5), ("N", "deadzone", 0.7), ("N", "tree", 0.3), ("R", "plain", 0.2), ("R", "deadzone", 0.5), ("R", "tree", 0.3))
_WV = ", ".join(f"('{e}', '{a}', {w}e0)" for e, a, w in WEIGHTS)


def weights(spark):
    return spark.sql(f"select * from values {_WV} as t(endpoint, arm, weight)")


@query(twin("select repeat_id, fold, unit_id, endpoint, " + r(*ARMS, "y_true", digits=8) + " from w", "w"))
def oof_wide(spark, d):
    return tidy(I.complete_wide(X.wide(spark, d), ARMS), "repeat_id fold unit_id endpoint", "", " ".join([*ARMS, "y_true"]), 8)


_SUB = [("plain", "deadzone"), ("plain", "tree"), ("plain", "naive"), ("deadzone", "tree"), ("deadzone", "naive"), ("tree", "naive"), ("plain", "deadzone", "tree"), ("plain", "deadzone", "naive"), ("plain", "tree", "naive"), ("deadzone", "tree", "naive"), tuple(ARMS)]


@query(twin("select endpoint, unnest([" + ", ".join(f"'{'+'.join(s)}'" for s in _SUB) + "]) as subset, unnest([" + ", ".join(f"round(avg(abs(({' + '.join(s)}) / {len(s)} - y_true)), 6) + 0.0" for s in _SUB) + "]) as mae from w group by endpoint", "w"))
def subset_average(spark, d):
    return tidy(I.subset_scores(X.wide(spark, d), ARMS, ["endpoint"]), "endpoint subset", "", "mae")


@query(twin(f", wt as (select * from (values {_WV}) t(endpoint, arm, weight)) select repeat_id, unit_id, endpoint, round(sum(weight * y_pred) / sum(weight), 6) + 0.0 as y_blend from oof join wt using (endpoint, arm) group by 1, 2, 3", "oof"))
def weighted_blend(spark, d):
    return tidy(I.weighted_blend(X.oof(spark, d), weights(spark), ["repeat_id", "unit_id"]), "repeat_id unit_id endpoint", "", "y_blend")


@query()
def greedy_blend(spark, d):
    return I.greedy_blend(X.wide(spark, d), ["endpoint"], ARMS, 12)


@query(twin("select endpoint, unnest(['plain', 'deadzone', 'tree', 'naive']) as arm, unnest([" + ", ".join(f"round(avg(abs({a} - y_true)), 6) + 0.0" for a in ARMS) + "]) as mae from w group by endpoint", "w"))
def greedy_first_step(spark, d):
    s = I._scores(X.wide(spark, d), ["endpoint"], ARMS, {e: [0] * 4 for e in "ANR"}, "mae")
    return spark.createDataFrame([(e, a, round(v, 6)) for e, vs in s.items() for a, v in zip(ARMS, vs)], "endpoint string, arm string, mae double")


_ZW = ", g as (select endpoint, avg(y_true) as my, stddev_pop(y_true) as sy, " + ", ".join(f"avg({a}) as m_{a}, stddev_pop({a}) as s_{a}" for a in ARMS) + " from w group by 1), zw as (select endpoint, y_true, " + ", ".join(f"case when s_{a} > 0 then ({a} - m_{a}) / s_{a} else 0 end * sy + my as {a}" for a in ARMS) + " from w join g using (endpoint))"


@query()
def greedy_blend_z(spark, d):
    return I.greedy_blend(X.wide(spark, d), ["endpoint"], ARMS, 12, space="z")


@query(twin(_ZW + " select endpoint, unnest([" + ", ".join(f"'{a}'" for a in ARMS) + "]) as arm, unnest([" + ", ".join(f"round(avg(abs({a} - y_true)), 6) + 0.0" for a in ARMS) + "]) as mae from zw group by endpoint", "w"))
def greedy_z_first_step(spark, d):
    g = I.z_space(X.wide(spark, d), ["endpoint"], ARMS).groupBy("endpoint").agg(*[F.avg(F.abs(F.col(a) - F.col("y_true"))).alias(a) for a in ARMS])
    return tidy(g.unpivot("endpoint", ARMS, "arm", "mae"), "endpoint arm", "", "mae")


def _shared_step(prefix):
    """SQL: for each arm the mean over the endpoints of the ST-RAE of its average with the arms of ``prefix``."""
    of = lambda a: "(" + " + ".join([*prefix, a]) + f") / {len(prefix) + 1}"
    soft = lambda p: f"sum(greatest({p} - conf_high, 0) + greatest(conf_low - ({p}), 0))"
    scores = ", ".join(f"{soft(of(a))} / {soft('m')} as {a}" for a in ARMS)
    return twin(f", m as (select endpoint, avg(y_true) as m from w group by 1), s as (select endpoint, {scores} from w join m using (endpoint) group by endpoint) select unnest([{', '.join(repr(a) for a in ARMS)}]) as arm, unnest([{', '.join(f'round(avg({a}), 6) + 0.0' for a in ARMS)}]) as st_rae from s", "w")


def _all(spark, d):
    return X.wide(spark, d).withColumn("all_endpoints", F.lit("all"))


@query(_shared_step([]))
def shared_first_step(spark, d):
    s = I._scores(_all(spark, d), ["all_endpoints"], ARMS, {"all": [0] * 4}, "st_rae", "endpoint")
    return spark.createDataFrame([(a, round(v, 6)) for a, v in zip(ARMS, s["all"])], "arm string, st_rae double")


@query(_shared_step(["deadzone"]))
def shared_second_step(spark, d):
    s = I._scores(_all(spark, d), ["all_endpoints"], ARMS, {"all": [int(a == "deadzone") for a in ARMS]}, "st_rae", "endpoint")
    return spark.createDataFrame([(a, round(v, 6)) for a, v in zip(ARMS, s["all"])], "arm string, st_rae double")


@query()
def shared_weights(spark, d):
    return I.greedy_blend(_all(spark, d), ["all_endpoints"], ARMS, 12, metric="st_rae", macro="endpoint")


@query()
def forward_set(spark, d):
    return I.greedy_blend(_all(spark, d), ["all_endpoints"], ARMS, len(ARMS), metric="st_rae", macro="endpoint", replacement=False).where("count > 0").select("arm", "score")


@query()
def nested_blend(spark, d):
    return I.nested_blend(X.wide(spark, d), ["endpoint"], ARMS, 5, 6)


@query()
def bagged_selection(spark, d):
    return I.bagged_selection(X.wide(spark, d), ["endpoint"], ARMS, 4, 0.75, 6, start=2)


@query(twin(f", wt as (select * from (values {_WV}) t(endpoint, arm, weight)), m as (select endpoint, arm, avg(y_pred) as mu, stddev_pop(y_pred) as sd from oof where fold <> 0 group by 1, 2) select repeat_id, unit_id, endpoint, round(sum(weight * (y_pred - mu) / sd), 6) + 0.0 as z from oof join m using (endpoint, arm) join wt using (endpoint, arm) where fold = 0 group by 1, 2, 3", "oof"))
def apply_blend(spark, d):
    o = X.oof(spark, d)
    m = o.where("fold <> 0").groupBy("endpoint", "arm").agg(F.avg("y_pred").alias("mu"), F.stddev_pop("y_pred").alias("sd"))
    j = o.where("fold = 0").join(weights(spark), ["endpoint", "arm"]).join(m, ["endpoint", "arm"])
    return tidy(j.groupBy("repeat_id", "unit_id", "endpoint").agg(F.sum(F.col("weight") * F.try_divide(F.col("y_pred") - F.col("mu"), F.col("sd"))).alias("z")), "repeat_id unit_id endpoint", "", "z")


_ORDER = ["deadzone", "plain", "tree", "naive"]


@query(twin("select endpoint, unnest([1, 2, 3, 4]) as members, unnest([" + ", ".join(f"round(avg(abs(({' + '.join(_ORDER[:k])}) / {k} - y_true)), 6) + 0.0" for k in range(1, 5)) + "]) as mae from w group by endpoint", "w"))
def member_trajectory(spark, d):
    aggs = [F.avg(F.abs(sum((F.col(a) for a in _ORDER[:k]), F.lit(0.0)) / k - F.col("y_true"))).alias(f"m{k}") for k in range(1, 5)]
    g = X.wide(spark, d).groupBy("endpoint").agg(*aggs)
    z = F.explode(F.array(*[F.struct(F.lit(k).alias("members"), F.col(f"m{k}").alias("mae")) for k in range(1, 5)])).alias("z")
    return tidy(g.select("endpoint", z).select("endpoint", "z.*"), "endpoint members", "", "mae")


@query(twin("select endpoint, fold, " + ", ".join(f"round(sum({a} * {b}) / count(*), 6) + 0.0 as {a}_{b}" for a, b in (("plain", "plain"), ("plain", "tree"), ("tree", "y_true"))) + " from w group by 1, 2", "w"))
def gram_sums(spark, d):
    g = I.gram(X.wide(spark, d), ["endpoint", "fold"], ARMS)
    n = F.col("`one*one`")
    return tidy(g.select("endpoint", "fold", (F.col("`plain*plain`") / n).alias("plain_plain"), (F.col("`plain*tree`") / n).alias("plain_tree"), (F.col("`tree*y`") / n).alias("tree_y_true")), "endpoint fold", "", "plain_plain plain_tree tree_y_true")


def _stack(kind):
    def run(spark, d):
        return I.stack(X.wide(spark, d), ["plain", "deadzone", "tree"], kind)

    run.__name__ = f"stack_{kind}"
    return query()(run)


stack_ridge, stack_enet, stack_nnls, stack_nnridge, stack_simplex = map(_stack, ("ridge", "enet", "nnls", "nnridge", "simplex"))


@query(twin("select arm, count(*) as n, round(avg(x), 6) + 0.0 as mean, round(stddev_samp(x), 6) + 0.0 as sd, round(avg((x < 0)::int), 6) + 0.0 as negative, round(avg((x > 0.9)::int), 6) + 0.0 as large from (select arm, regr_slope(y_true, y_pred) as x from oof where arm <> 'naive' group by arm, endpoint, fold, repeat_id) group by arm", "oof"))
def coef_summary(spark, d):
    x = X.oof(spark, d).where("arm <> 'naive'").groupBy("arm", "endpoint", "fold", "repeat_id").agg(F.regr_slope("y_true", "y_pred").alias("x"))
    g = x.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.avg((F.col("x") < 0).cast("double")).alias("negative"), F.avg((F.col("x") > 0.9).cast("double")).alias("large"))
    return tidy(g, "arm", "n", "mean sd negative large")


_MEAN = "((plain + deadzone + tree + naive) / 4)"


@query(twin(f"select endpoint, round(avg(({_MEAN} - y_true) ** 2), 6) + 0.0 as ensemble, round((" + " + ".join(f"avg(({a} - y_true) ** 2)" for a in ARMS) + ") / 4, 6) + 0.0 as members, round((" + " + ".join(f"avg(({a} - {_MEAN}) ** 2)" for a in ARMS) + ") / 4, 6) + 0.0 as ambiguity from w group by endpoint", "w"))
def ambiguity(spark, d):
    return tidy(I.ambiguity(X.wide(spark, d), ARMS, ["endpoint"]), "endpoint", "", "ensemble members ambiguity")


@query(twin("select a.endpoint, a.arm as arm_a, b.arm as arm_b, round(avg((a.y_pred - b.y_pred) ** 2) / 4, 6) + 0.0 as ambiguity from oof a join oof b on a.unit_id = b.unit_id and a.endpoint = b.endpoint and a.repeat_id = b.repeat_id join arms x on x.arm = a.arm join arms y on y.arm = b.arm where list_position(['plain', 'deadzone', 'tree', 'naive'], a.arm) < list_position(['plain', 'deadzone', 'tree', 'naive'], b.arm) group by 1, 2, 3", "oof"))
def pair_ambiguity(spark, d):
    return tidy(I.pair_ambiguity(X.wide(spark, d), ARMS, ["endpoint"]), "endpoint arm_a arm_b", "", "ambiguity")


@query(twin(", v as (select *, 2 * plain + 1 as affine, plain as copy from w) select 'affine' as a, 'plain' as b, round(corr(affine, plain), 6) as c, bool_and(affine = plain) as identical from v union all select 'copy', 'plain', round(corr(copy, plain), 6), bool_and(copy = plain) from v union all select 'affine', 'copy', round(corr(affine, copy), 6), bool_and(affine = copy) from v", "w"))
def distinct_objects(spark, d):
    from itertools import combinations

    v = X.wide(spark, d).select("plain", "deadzone", "tree", (2 * F.col("plain") + 1).alias("affine"), F.col("plain").alias("copy"))
    pairs = list(combinations(sorted(v.columns), 2))
    g = v.agg(*[F.struct(F.corr(a, b).alias("c"), F.bool_and(F.col(a) == F.col(b)).alias("identical")).alias(f"{a}__{b}") for a, b in pairs])
    z = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}__{b}.c"), 6).alias("c"), F.col(f"{a}__{b}.identical").alias("identical"), F.col(f"{a}__{b}.c").alias("raw")) for a, b in pairs])).alias("z")
    return g.select(z).select("z.*").where(F.col("raw") > 1 - 1e-9).drop("raw")


@query(twin(f", v as (select endpoint, 3 * deadzone - 2 as sent, plain, deadzone, tree from w), k as (select endpoint, {rank_sql('sent', 'endpoint')} as s, " + ", ".join(f"{rank_sql(a, 'endpoint')} as {a}" for a in ("plain", "deadzone", "tree")) + " from v) select endpoint, unnest(['plain', 'deadzone', 'tree']) as model, unnest([corr(s, plain) > 1 - 1e-9, corr(s, deadzone) > 1 - 1e-9, corr(s, tree) > 1 - 1e-9]) as origin from k group by endpoint", "w"))
def trace_origin(spark, d):
    v = X.wide(spark, d).select("endpoint", (3 * F.col("deadzone") - 2).alias("sent"), "plain", "deadzone", "tree")
    v = R.average_ranks(v, ["endpoint"], {c: f"r_{c}" for c in ("sent", "plain", "deadzone", "tree")})
    g = v.groupBy("endpoint").agg(*[F.corr("r_sent", f"r_{c}").alias(c) for c in ("plain", "deadzone", "tree")])
    return g.unpivot(["endpoint"], ["plain", "deadzone", "tree"], "model", "c").select("endpoint", "model", (F.col("c") > 1 - 1e-9).alias("origin"))


_DEC = f"dec as (select *, 2 * rho * k - k ** 2 - b ** 2 as r2 from (select arm, endpoint, coalesce({corr_sql('y_true', 'y_pred')}, 0) as rho, stddev_pop(y_pred) / stddev_pop(y_true) as k, avg(y_pred - y_true) / stddev_pop(y_true) as b from p group by 1, 2))"


@query(twin(f", {_DEC} select arm, endpoint, {r('rho k b r2')}, round((k - rho) ** 2, 6) + 0.0 as scale_loss, round(b ** 2, 6) + 0.0 as bias_loss from dec", "p"))
def r2_decomp(spark, d):
    return tidy(K.r2_decomposition(X.predictions(spark, d), AE), "arm endpoint", "", "rho k b r2 scale_loss bias_loss")


@query(twin("select a.arm, a.endpoint, k as fold, round(regr_slope(y_true, y_pred), 5) + 0.0 as slope, round(regr_intercept(y_true, y_pred), 5) + 0.0 as intercept from oof a cross join (select cast(unnest(range(5)) as integer) as k) where k <> fold and arm <> 'naive' group by 1, 2, 3", "oof"))
def ols_recal(spark, d):
    return tidy(K.ols_recalibration(X.oof(spark, d).where("arm <> 'naive'"), AE, "fold"), "arm endpoint fold", "", "slope intercept", 5)


@query(twin(", t as (select endpoint, avg(y_true) + 0.3 as mean, stddev_pop(y_true) * 1.1 as sd from labs where conf_high - conf_low > 0.4 group by 1), g as (select arm, endpoint, corr(y_true, y_pred) as rho, stddev_pop(y_pred) as sp, avg(y_pred) as mp from p where arm <> 'naive' group by 1, 2) select arm, endpoint, round(rho, 6) + 0.0 as rho, round(rho * sd / sp, 6) + 0.0 as slope, round(mean - rho * sd / sp * mp, 6) + 0.0 as intercept from g join t using (endpoint)", "p"))
def moment_calibration(spark, d):
    t = X.labels(spark, d).where("conf_high - conf_low > 0.4").groupBy("endpoint").agg((F.avg("y_true") + 0.3).alias("mean"), (F.stddev_pop("y_true") * 1.1).alias("sd"))
    return tidy(K.moment_calibration(X.predictions(spark, d).where("arm <> 'naive'"), AE, t), "arm endpoint", "", "rho slope intercept")


_SWEEP = """, m as (select arm, endpoint, avg(y_true) as my, avg(y_pred) as mp, var_pop(y_true) as vy from p group by 1, 2), g as (select unnest({offsets}) as off), h as (select unnest({scales}) as scl),
sw as (select p.arm, p.endpoint, off as "offset", scl as scale, sum(greatest(mp + scl * (y_pred - mp) + off - conf_high, 0) + greatest(conf_low - mp - scl * (y_pred - mp) - off, 0)) / sum(greatest(my - conf_high, 0) + greatest(conf_low - my, 0)) as st_rae,
  1 - avg((mp + scl * (y_pred - mp) + off - y_true) ** 2) / any_value(vy) as r2 from p join m using (arm, endpoint) cross join g cross join h group by 1, 2, 3, 4)"""
OFFSETS = [round(-1 + 0.05 * k, 2) for k in range(41)]
SCALES = [round(0.5 + 0.1 * k, 1) for k in range(16)]


def _sw(offsets, scales):
    return _SWEEP.replace("{offsets}", repr([float(x) for x in offsets]) + "::double[]").replace("{scales}", repr([float(x) for x in scales]) + "::double[]")


def _offsets(spark, d):
    return K.sweep(X.predictions(spark, d), AE, [(o, 1.0) for o in OFFSETS])


def _spreads(spark, d):
    return K.sweep(X.predictions(spark, d), AE, [(0.0, s) for s in SCALES])


@query(twin(_sw(OFFSETS, [1.0]) + ' select arm, endpoint, "offset", ' + r("st_rae r2") + " from sw", "p"))
def offset_sweep(spark, d):
    return tidy(_offsets(spark, d), "arm endpoint offset", "", "st_rae r2")


CURVE = (-2.0, 2.0, 401)
_CURVE = [round(-2 + 0.01 * k, 2) for k in range(401)]
_Z = """, z as (select arm, endpoint, conf_high - y_pred as z from p union all select arm, endpoint, conf_low - y_pred from p), o as (select *, row_number() over (partition by arm, endpoint order by z) as k, count(*) over (partition by arm, endpoint) as m from z),
mid as (select arm, endpoint, min(z) filter (where k = m // 2) as low, min(z) filter (where k = m // 2 + 1) as high from o group by 1, 2), g as (select arm, endpoint, avg(y_true) as my, avg(y_true - y_pred) as gain, var_pop(y_true) as vy from p group by 1, 2),
s as (select p.arm, p.endpoint, low, high, gain, sum(greatest(y_pred + low - conf_high, 0) + greatest(conf_low - y_pred - low, 0)) as e, sum(greatest(y_pred - conf_high, 0) + greatest(conf_low - y_pred, 0)) as e0, sum(greatest(my - conf_high, 0) + greatest(conf_low - my, 0)) as base, 1 - avg((y_pred + gain - y_true) ** 2) / any_value(vy) as r2
  from p join mid using (arm, endpoint) join g using (arm, endpoint) group by all)"""


@query(twin(_sw(_CURVE, [1.0]) + ' select arm, endpoint, "offset", ' + r("st_rae r2") + " from sw", "p"))
def offset_curve(spark, d):
    return tidy(O.offset_curve(X.predictions(spark, d), AE, *CURVE), "arm endpoint", "", "offset st_rae r2")


@query(twin(_Z + f" select arm, endpoint, {r('low high gain gap st_rae raw r2')} from (select *, low - gain as gap, e / base as st_rae, e0 / base as raw from s)", "p"))
def offset_optimum(spark, d):
    best = O.offset_optimum(X.predictions(spark, d), AE).withColumnRenamed("r2_offset", "gain")
    return tidy(best, "arm endpoint", "", "low high gain gap st_rae raw r2")


@query(twin(_Z + f" select arm, endpoint, round(low, 6) + 0.0 as by_st_rae, round(gain, 6) + 0.0 as by_r2 from mid join g using (arm, endpoint)", "p"))
def offset_opt(spark, d):
    """The best offset of all by ST-RAE (of several the smallest) and by R2: no grid."""
    best = O.offset_optimum(X.predictions(spark, d), AE)
    return tidy(best.select(*AE, F.col("low").alias("by_st_rae"), F.col("r2_offset").alias("by_r2")), "arm endpoint", "", "by_st_rae by_r2")


_RHO = f"""rho as (select arm, endpoint, {corr_sql('y_true', 'y_pred')} as rho from p group by 1, 2), q as (select *, round(st_rae, 9) as st from sw join rho using (arm, endpoint)),
e as (select arm, endpoint, rho, arg_min(scale, struct_pack(a := st, b := scale)) as best_scale, min(st_rae) as best, max(scale) filter (where scale <= rho) as x0, max(scale) as top, min(scale) as low, min(scale) filter (where scale >= rho) as x1 from q group by 1, 2, 3),
v as (select e.*, a.st_rae + coalesce((rho - x0) / nullif(x1 - x0, 0), 0) * (b.st_rae - a.st_rae) as at_rho from e left join sw a on a.arm = e.arm and a.endpoint = e.endpoint and a.scale = x0 left join sw b on b.arm = e.arm and b.endpoint = e.endpoint and b.scale = x1)"""


@query(twin(_sw([0.0], SCALES) + ", " + _RHO + f" select arm, endpoint, best_scale in (low, top) as at_boundary, coalesce(rho between low and top, false) as inside, {r('rho best_scale best at_rho gap')} from (select *, at_rho - best as gap from v)", "p"))
def spread_at_rho(spark, d):
    s = O.spread_at_rho(_spreads(spark, d), X.predictions(spark, d), AE)
    return tidy(s, "arm endpoint at_boundary inside", "", "rho best_scale best at_rho gap")


@query(twin(_sw([0.0], SCALES) + " select arm, endpoint, scale, " + r("st_rae r2") + " from sw", "p"))
def spread_sweep(spark, d):
    return tidy(_spreads(spark, d), "arm endpoint scale", "", "st_rae r2")


@query(twin(_sw([-0.2, 0.0, 0.2], [0.8, 1.0, 1.2]) + ' select arm, endpoint, "offset", scale, ' + r("st_rae r2") + " from sw", "p"))
def joint_sweep(spark, d):
    return tidy(K.sweep(X.predictions(spark, d), AE, [(o, s) for o in (-0.2, 0.0, 0.2) for s in (0.8, 1.0, 1.2)]), "arm endpoint offset scale", "", "st_rae r2")


_RATIO = "g as (select arm, endpoint, avg(y_pred) as m, stddev_samp(y_pred) / stddev_samp(y_true) as rt, min(y_pred) as lo, max(y_pred) as hi from p where arm <> 'naive' group by 1, 2), t as (select endpoint, max(rt) as ratio from g group by 1)"


def _targets(spark, d):
    p = X.predictions(spark, d).where("arm <> 'naive'")
    g = p.groupBy(*AE).agg((F.stddev_samp("y_pred") / F.stddev_samp("y_true")).alias("rt"))
    return p, g.groupBy("endpoint").agg(F.max("rt").alias("ratio"))


@query(twin(f", {_RATIO}, f as (select *, case when abs(ratio - rt) / ratio >= 0.05 then ratio / rt else 1 end as fc from g join t using (endpoint)) select arm, endpoint, round(fc, 6) + 0.0 as factor, round(m + fc * (lo - m), 6) + 0.0 as low, round(m + fc * (hi - m), 6) + 0.0 as high from f", "p"))
def widen(spark, d):
    p, t = _targets(spark, d)
    return tidy(K.widen(p, AE, t, 0.05).groupBy(*AE).agg(F.max("factor").alias("factor"), F.min("y_wide").alias("low"), F.max("y_wide").alias("high")), "arm endpoint", "", "factor low high")


@query(twin(f", q as ({_P_SCORES}), s as (select arm, endpoint, stddev_samp(y_pred) / stddev_samp(y_true) as ratio from p group by 1, 2) select endpoint, arg_min(q.arm, round(st_rae, 6)) as arm, round(arg_min(ratio, round(st_rae, 6)), 6) + 0.0 as ratio, count(*) as n from q join s using (arm, endpoint) group by endpoint", "p"))
def target_ratio(spark, d):
    p = X.predictions(spark, d)
    g = M.score(p, AE).join(p.groupBy(*AE).agg((F.stddev_samp("y_pred") / F.stddev_samp("y_true")).alias("ratio")), AE)
    k = F.struct(F.round("st_rae", 6), "arm")
    return tidy(g.groupBy("endpoint").agg(F.min_by("arm", k).alias("arm"), F.min_by("ratio", k).alias("ratio"), F.count(F.lit(1)).alias("n")), "endpoint arm", "n", "ratio")


@query(twin(f", {_DEC}, s as (select unnest([0.0e0, 0.25e0, 0.5e0, 0.75e0, 1.0e0]) as s), q as (select arm, endpoint, s, rho, (1 - s) * b as bs, k + s * (rho - k) as ks from dec cross join s) select arm, endpoint, s, round(bs, 6) + 0.0 as bs, round(ks, 6) + 0.0 as ks, round(2 * rho * ks - ks ** 2 - bs ** 2, 6) + 0.0 as r2_s from q", "p"))
def partial_correction(spark, d):
    return tidy(K.partial_correction(K.r2_decomposition(X.predictions(spark, d), AE), [0.0, 0.25, 0.5, 0.75, 1.0]), "arm endpoint s", "", "bs ks r2_s")


@query(twin(f", {_DEC} select arm, endpoint, round(rho ** 2 - r2, 6) + 0.0 as headroom, round(-b / k, 6) + 0.0 as sensitivity from dec where arm <> 'naive'", "p"))
def headroom(spark, d):
    x = K.r2_decomposition(X.predictions(spark, d).where("arm <> 'naive'"), AE)
    return tidy(x.select(*AE, (F.col("rho") ** 2 - F.col("r2")).alias("headroom"), F.try_divide(-F.col("b"), F.col("k")).alias("sensitivity")), "arm endpoint", "", "headroom sensitivity")


@query()
def root_scan(spark, d):
    p = X.predictions(spark, d).where("arm = 'plain'")
    e = F.col("y_pred") - F.col("y_true")
    return K.root_scan(p.groupBy("endpoint").agg(F.stddev_pop(e).alias("sd"), F.avg(F.abs(e)).alias("mae")))


#: Offsets of the submissions whose population is solved for: an unbiased one has its solution at an end of the range, if any.
MOVES = [-0.8, 0.0, 0.4, 0.8]
_ERF = "(1 - ((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t} * exp(-{x} * {x}))"
_SOLVE = f""", m as (select arm, endpoint, y_true, moved, y_pred + moved as y_pred from p cross join (select unnest({MOVES!r}::double[]) as moved) where arm <> 'naive'), b as (select arm, endpoint, moved, avg(y_pred) as mean, stddev_pop(y_pred) as sd, {corr_sql('y_true', 'y_pred')} as rho, 1 - avg((y_pred - y_true) ** 2) / var_pop(y_true) as r2, avg(abs(y_pred - y_true)) as mae from m group by 1, 2, 3),
kn as (select endpoint, avg(y_true) as km, stddev_pop(y_true) as ks from p where arm <> 'naive' group by 1),
lim as (select *, greatest(rho - sqrt(greatest(rho ** 2 - r2, 0)), 1e-6) as low, rho + sqrt(greatest(rho ** 2 - r2, 0)) as high from b where rho ** 2 >= r2),
gr as (select *, low + i * ((high - low) / 3999) as k from lim cross join generate_series(0, 3999) as t(i)),
er as (select *, sqrt(greatest(2 * rho * k - k ** 2 - r2, 0)) * sd / k as m, greatest(sd / k * sqrt(greatest(1 - 2 * rho * k + k ** 2, 0)), 1e-12) as s from gr),
ex as (select *, m / (s * sqrt(2.0e0)) as x, 1 / (1 + 0.3275911e0 * (m / (s * sqrt(2.0e0)))) as t from er),
ga as (select *, s * sqrt(2 / pi()) * exp(-(m ** 2) / (2 * s ** 2)) + m * {_ERF.format(t='t', x='x')} - mae as y0 from ex),
nx as (select *, lead(y0) over (partition by arm, endpoint, moved order by i) as y1 from ga),
fi as (select *, row_number() over (partition by arm, endpoint, moved order by i) as n from nx where y0 = 0 or y0 * y1 < 0),
so as (select arm, endpoint, moved, low + (i + y0 / (y0 - y1)) * ((high - low) / 3999) as k from fi where n = 1),
bi as (select b.*, km, ks, so.k, case when so.k is not null then sqrt(greatest(2 * rho * so.k - so.k ** 2 - r2, 0)) end as bias from b join kn using (endpoint) left join so on so.arm = b.arm and so.endpoint = b.endpoint and so.moved = b.moved),
me as (select *, sd / k as label_sd, mean + bias * sd / k as up, mean - bias * sd / k as dn from bi),
pk as (select *, case when abs(up - km) <= abs(dn - km) then up else dn end as label_mean, case when abs(up - km) <= abs(dn - km) then dn else up end as mirror_mean from me),
st as (select *, case when k is null then 'INFEASIBLE' when label_sd > 3 * ks or label_sd < 0.2 * ks or abs(label_mean - km) > 3 * ks then 'IMPLAUSIBLE' when abs(mirror_mean - km) / greatest(abs(label_mean - km), 1e-9) < 1.5 then 'AMBIGUOUS' else 'OK' end as status from pk)
select arm, endpoint, moved, status, {r('k bias label_sd label_mean mirror_mean', digits=5)} from st"""


@query(twin(_SOLVE, "p"))
def population_solve(spark, d):
    p = X.predictions(spark, d).where("arm <> 'naive'")
    m = p.select(*AE, "y_true", F.explode(F.array(*map(F.lit, MOVES))).alias("moved"), "y_pred").withColumn("y_pred", F.col("y_pred") + F.col("moved"))
    e = F.col("y_pred") - F.col("y_true")
    b = m.groupBy(*AE, "moved").agg(F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("sd"), F.corr("y_true", "y_pred").alias("rho"), (1 - F.avg(e**2) / F.var_pop("y_true")).alias("r2"), F.avg(F.abs(e)).alias("mae"))
    known = p.groupBy("endpoint").agg(F.avg("y_true").alias("mean"), F.stddev_pop("y_true").alias("sd"))
    return tidy(P.solve_population(b, known, ["endpoint"]), "arm endpoint moved status", "", "k bias label_sd label_mean mirror_mean", 5)


@query()
def population_grid_fit(spark, d):
    p = X.predictions(spark, d).where("arm <> 'naive'")
    b = p.groupBy(*AE).agg(F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("sd")).join(K.r2_decomposition(p, AE).select(*AE, "rho", "r2"), AE)
    return K.population_fit(b)


@query(twin("select endpoint, round(min(m), 6) + 0.0 as low, round(max(m), 6) + 0.0 as high, count(distinct (round(m, 3), round(s, 3))) as equations from (select arm, endpoint, avg(y_pred) as m, stddev_pop(y_pred) as s from p group by 1, 2) group by 1", "p"))
def identifiable(spark, d):
    g = X.predictions(spark, d).groupBy(*AE).agg(F.avg("y_pred").alias("m"), F.stddev_pop("y_pred").alias("s"))
    return tidy(g.groupBy("endpoint").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.countDistinct(F.round("m", 3), F.round("s", 3)).alias("equations")), "endpoint", "equations", "low high")


@query(twin(f", k as (select *, {rank_sql('y_true', 'arm, endpoint, repeat_id')} as ra, {rank_sql('y_pred', 'arm, endpoint, repeat_id')} as rb from oof where arm <> 'naive') select arm, endpoint, repeat_id, round(2 * sin(pi() * corr(ra, rb) / 6), 6) + 0.0 as proxy, round(2 * sin(pi() * corr(ra, rb) / 6) - corr(y_true, y_pred), 6) + 0.0 as bias from k group by 1, 2, 3", "oof"))
def rho_proxy(spark, d):
    o, keys = X.oof(spark, d).where("arm <> 'naive'"), [*AE, "repeat_id"]
    g = R.spearman(o, keys, "y_true", "y_pred", "s").join(o.groupBy(*keys).agg(F.corr("y_true", "y_pred").alias("c")), keys)
    proxy = 2 * F.sin(F.pi() * F.col("s") / 6)
    return tidy(g.select(*keys, proxy.alias("proxy"), (proxy - F.col("c")).alias("bias")), "arm endpoint repeat_id", "", "proxy bias")


@query(twin(f", v as (select endpoint, repeat_id, plain as a, 1.5 * plain - 2 as b from w), k as (select *, {rank_sql('a', 'endpoint, repeat_id')} as ra, {rank_sql('b', 'endpoint, repeat_id')} as rb from v) select endpoint, repeat_id, bool_and(ra = rb) as same_ranks, count(*) as n from k group by 1, 2", "w"))
def rank_invariance(spark, d):
    v = X.wide(spark, d).select("endpoint", "repeat_id", F.col("plain").alias("a"), (1.5 * F.col("plain") - 2).alias("b"))
    v = R.average_ranks(v, ["endpoint", "repeat_id"], {"a": "ra", "b": "rb"})
    return v.groupBy("endpoint", "repeat_id").agg(F.bool_and(F.col("ra") == F.col("rb")).alias("same_ranks"), F.count(F.lit(1)).alias("n"))
