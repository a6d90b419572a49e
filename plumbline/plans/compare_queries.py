"""Method comparison (section H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import compare as C
from plumbline.operators import metrics as M
from plumbline.operators import ranks as R
from plumbline.plans.book import query, r, tidy
from plumbline.plans.metric_queries import _HARD, _flags, corr_sql, fold_scores, rank_sql
from plumbline.sources import fixtures as X
from plumbline.sources.fixtures import twin


def rows(spark, d):
    return C.long_format(M.macro_scores(X.oof(spark, d), ["arm", "repeat_id", "fold"]), "arm", ["repeat_id", "fold"], "value")


_ROWS = ", x as (select arm, concat_ws('_', repeat_id, fold) as subject, value from ms)"


@query(twin(_ROWS + f" select arm, subject, {r('value')} from x", "ms"))
def cmp_long(spark, d):
    return tidy(rows(spark, d), "arm subject", "", "value")


_LEV = _ROWS + """, z as (select x.arm, value, abs(value - m) as z from x join (select arm, median(value) as m from x group by 1) q on q.arm = x.arm),
g as (select arm, count(*) as n, avg(z) as zm, var_pop(z) as zv, var_samp(value) as v from z group by 1), t as (select count(*) as k, sum(n) as nn, sum(n * zm) / sum(n) as grand, sum(n * zv) as within_, max(v) as hi, min(v) as lo from g)
select round((nn - k) * (select sum(n * (zm - grand) ** 2) from g) / ((k - 1) * within_), 6) + 0.0 as statistic, k - 1 as df1, cast(nn - k as bigint) as df2, lo < 1e-12 as zero_variance from t"""


@query(twin(_LEV, "ms"))
def levene(spark, d):
    return tidy(C.levene(rows(spark, d)), "zero_variance", "df1 df2", "statistic")


@query()
def levene_p(spark, d):
    return C.levene(rows(spark, d))


_ANOVA = _ROWS + """, g as (select avg(value) as g, sum(value ** 2) - count(*) * avg(value) ** 2 as total from x), a as (select sum(n * (m - g) ** 2) as ss, count(*) as k from (select arm, count(*) as n, avg(value) as m from x group by 1) cross join g),
s as (select sum(n * (m - g) ** 2) as ss, count(*) as k from (select subject, count(*) as n, avg(value) as m from x group by 1) cross join g), av as (select a.ss / (a.k - 1) as ms_arm, a.k - 1 as df_arm, (a.k - 1) * (s.k - 1) as df_error, (total - a.ss - s.ss) / ((a.k - 1) * (s.k - 1)) as ms_error, s.k as subjects from g, a, s)"""


@query(twin(_ANOVA + " select round(ms_arm / ms_error, 4) + 0.0 as f, df_arm, df_error, round(ms_error, 9) + 0.0 as ms_error from av", "ms"))
def rm_anova(spark, d):
    return C.rm_anova(rows(spark, d)).select(F.round("f", 4).alias("f"), "df_arm", "df_error", F.round("ms_error", 9).alias("ms_error"))


_PAIRS = "(select a.arm as arm_a, b.arm as arm_b, a.m as mean_a, b.m as mean_b from (select arm, avg(value) as m from x group by 1) a join (select arm, avg(value) as m from x group by 1) b on a.arm < b.arm)"


@query(twin(_ANOVA + f" select arm_a, arm_b, round(mean_a - mean_b, 6) + 0.0 as diff, round(abs(mean_a - mean_b) / sqrt(ms_error / subjects), 5) + 0.0 as q from {_PAIRS} cross join av", "ms"))
def tukey(spark, d):
    return C.tukey(rows(spark, d)).select("arm_a", "arm_b", F.round("diff", 6).alias("diff"), F.round("q", 5).alias("q"))


@query()
def tukey_p(spark, d):
    return C.tukey(rows(spark, d))


_RK = _ROWS + f", k as (select *, {rank_sql('value', 'subject')} as rank_ from x)"


@query(twin(_RK + """, s as (select sum(r ** 2) as r2, count(*) as k from (select arm, sum(rank_) as r from k group by 1)), n as (select count(distinct subject) as n from x), t as (select sum(t ** 3 - t) as ties from (select count(*) as t from k group by subject, rank_))
select round((12 * r2 / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - ties / (n * (k ** 3 - k))), 6) + 0.0 as statistic, k - 1 as df, n as n_subjects from s, n, t""", "ms"))
def friedman(spark, d):
    return tidy(C.friedman(rows(spark, d)), "", "df n_subjects", "statistic")


@query(twin(_RK + """, s as (select arm, sum(rank_) as r from k group by 1), c as (select (select count(distinct subject) from x)::double as n, (select count(*) from s)::double as k, (select sum(rank_ ** 2) from k) as a1, (select sum(r ** 2) from s) as r2)
select a.arm as arm_a, b.arm as arm_b, round(abs(a.r - b.r) / nullif(sqrt(2 * (n * a1 - r2) / ((n - 1) * (k - 1))), 0), 6) + 0.0 as t from s a join s b on a.arm < b.arm cross join c""", "ms"))
def conover_holm(spark, d):
    return tidy(C.holm(C.conover(rows(spark, d)), "p"), "arm_a arm_b", "", "t")


_PD = _ROWS + ", pd as (select a.arm as arm_a, b.arm as arm_b, count(*) as n, avg(a.value - b.value) as diff, stddev_samp(a.value - b.value) as sd, stddev_samp(a.value - b.value) / sqrt(count(*)) as se, count(*) filter (where a.value < b.value) as n_better from x a join x b on a.subject = b.subject and a.arm < b.arm group by 1, 2)"


@query(twin(_PD + " select arm_a, arm_b, n, n_better, round(diff, 6) + 0.0 as diff, round(se, 6) + 0.0 as se, round(diff / se, 4) + 0.0 as t from pd", "ms"))
def paired_test(spark, d):
    p = C.paired(rows(spark, d))
    return p.select("arm_a", "arm_b", "n", "n_better", F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query(twin(_PD + " select arm_a, arm_b, round(diff / se, 4) + 0.0 as t from pd", "ms"))
def bh_pairwise(spark, d):
    return C.benjamini_hochberg(C.paired(rows(spark, d)), "p").select("arm_a", "arm_b", F.round("t", 4).alias("t"))


@query()
def paired_shapiro(spark, d):
    return C.signed_rank(rows(spark, d))


_PS = "(select o_orderpriority as grp, o_orderkey as k, case when o_orderkey % 7 = 0 then null else round(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 7))::bigint / 268435456.0e0, 6) end as p from orders)"


def _ps(spark, d):
    p = F.round(X.unit(F.md5(F.col("o_orderkey").cast("string"))), 6)
    return X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, p).alias("p"))


@query(f"select grp, k, round(case when p is not null then least(1, min(s) over (partition by grp order by p desc nulls last, k desc rows unbounded preceding)) end, 6) + 0.0 as p_bh from (select *, count(p) over (partition by grp) * p / row_number() over (partition by grp order by p nulls last, k) as s from {_PS})")
def bh(spark, d):
    return tidy(C.benjamini_hochberg(_ps(spark, d), "p", keys=["grp"], buckets=64), "grp k", "", "p_bh")


@query(f"select grp, k, round(case when p is not null then max(s) over (partition by grp order by p nulls last, k rows unbounded preceding) end, 6) + 0.0 as p_holm from (select *, least(1.0, (count(p) over (partition by grp) - row_number() over (partition by grp order by p nulls last, k) + 1) * p) as s from {_PS})")
def holm(spark, d):
    return tidy(C.holm(_ps(spark, d), "p", keys=["grp"], buckets=64), "grp k", "", "p_holm")


@query(twin(_ROWS + ", g as (select arm, var_samp(value) as v from x group by 1) select count(*) as arms, case when count(*) > 10 then 'bh' when max(v) / min(v) <= 9 then 'tukey' else 'conover_holm' end as route, round(0.05e0 / 3, 6) as alpha from g", "ms"))
def posthoc_route(spark, d):
    x = rows(spark, d)
    v = x.groupBy("arm").agg(F.var_samp("value").alias("v")).agg(F.count(F.lit(1)).alias("arms"), F.try_divide(F.max("v"), F.min("v")).alias("ratio"))
    route = F.when(F.col("arms") > 10, "bh").when(F.coalesce(F.col("ratio") <= 9, F.lit(False)), "tukey").otherwise("conover_holm")
    return v.select("arms", route.alias("route"), F.round(F.lit(0.05 / 3), 6).alias("alpha"))


@query()
def cld(spark, d):
    x = rows(spark, d)
    return C.letters(x.groupBy("arm").agg(F.avg("value").alias("mean")), C.tukey(x))


@query()
def leaderboard(spark, d):
    x = rows(spark, d)
    board = C.letters(x.groupBy("arm").agg(F.avg("value").alias("mean")), C.tukey(x))
    s = fold_scores(spark, d).groupBy("arm").agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "r2")])
    best = board.agg(F.min_by("letters", "mean").alias("best"), F.min("mean").alias("top"))
    tied = F.size(F.array_intersect(F.split("letters", ""), F.split("best", ""))) > 0
    tier = F.when(F.col("mean") == F.col("top"), "best").when(tied, "tied").otherwise("worse")
    return board.crossJoin(best).join(s, "arm").select("arm", "letters", tier.alias("tier"), F.col("mean").alias("st_rae"), "mae", "rmse", "r2").orderBy("st_rae")


@query(twin(_PD.replace(_ROWS, ", x as (select arm, endpoint, concat_ws('_', repeat_id, fold) as subject, st_rae as value from sc)").replace("select a.arm as arm_a, b.arm as arm_b,", "select a.arm as arm, a.endpoint,").replace("a.subject = b.subject and a.arm < b.arm", "a.subject = b.subject and a.endpoint = b.endpoint and b.arm = 'plain' and a.arm <> 'plain'") + " select arm, endpoint, n, round(diff, 6) + 0.0 as diff from pd", "sc"))
def vs_baseline(spark, d):
    x = C.long_format(fold_scores(spark, d).withColumn("e", F.col("endpoint")), "arm", ["endpoint", "repeat_id", "fold"], "st_rae").withColumn("endpoint", F.split("subject", "_")[0])
    p = C.paired(x, ["endpoint"]).where("arm_a = 'plain' or arm_b = 'plain'")
    flip = F.col("arm_a") == "plain"
    p = C.benjamini_hochberg(p.select("endpoint", "n", "p", F.when(flip, F.col("arm_b")).otherwise(F.col("arm_a")).alias("arm"), F.when(flip, -F.col("diff")).otherwise(F.col("diff")).alias("diff")), "p", keys=["endpoint"])
    return tidy(p, "arm endpoint", "n", "diff")


@query(twin(_PD + ", bar as (select 2 * avg(se) as bar from pd) select arm_a, arm_b, round(diff, 6) + 0.0 as diff, round(bar, 6) + 0.0 as bar, abs(diff) >= bar as material, round(100 * abs(diff) / bar, 3) + 0.0 as percent_of_bar from pd cross join bar", "ms"))
def materiality(spark, d):
    p = C.paired(rows(spark, d))
    p = p.crossJoin(p.agg((2 * F.avg("se")).alias("bar")))
    return p.select("arm_a", "arm_b", F.round("diff", 6).alias("diff"), F.round("bar", 6).alias("bar"), (F.abs("diff") >= F.col("bar")).alias("material"), F.round(100 * F.abs("diff") / F.col("bar"), 3).alias("percent_of_bar"))


@query(twin(_ROWS + f", g as (select arm, avg(value) as m, stddev_samp(value) as sd from x group by 1), w as (select max(sd) as widest from g) select a.arm as arm_a, b.arm as arm_b, round(a.m - b.m, 6) + 0.0 as diff, abs(a.m - b.m) > widest as resolved from g a join g b on a.arm < b.arm cross join w", "ms"))
def seed_verdict(spark, d):
    g = rows(spark, d).groupBy("arm").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    p = C.arm_pairs(g, ["m"]).crossJoin(g.agg(F.max("sd").alias("widest")))
    diff = F.col("m_a") - F.col("m_b")
    return p.select("arm_a", "arm_b", F.round(diff, 6).alias("diff"), (F.abs(diff) > F.col("widest")).alias("resolved"))


_HALF = """, h as (select arm, fold < 3 as side, concat_ws('_', repeat_id, fold) as subject, value from ms), q as (select a.side, a.arm as arm_a, b.arm as arm_b, avg(a.value - b.value) as diff, stddev_samp(a.value - b.value) / sqrt(count(*)) as se from h a join h b on a.subject = b.subject and a.side = b.side and a.arm < b.arm group by 1, 2, 3)"""


def _halves(spark, d):
    x = rows(spark, d).withColumn("side", F.split("subject", "_")[1].cast("int") < 3)
    return x, C.paired(x, ["side"])


@query(twin(_HALF + " select u.arm_a, u.arm_b, case when abs(u.diff) > 2 * u.se and abs(v.diff) > 2 * v.se then case when sign(u.diff) = sign(v.diff) then 'agree' else 'flip' end else 'unresolved' end as verdict from q u join q v on u.side and not v.side and u.arm_a = v.arm_a and u.arm_b = v.arm_b", "ms"))
def sign_flip(spark, d):
    _, p = _halves(spark, d)
    half = lambda s, t: p.where(F.col("side") == F.lit(s)).select("arm_a", "arm_b", F.col("diff").alias(f"d{t}"), (F.abs("diff") > 2 * F.col("se")).alias(f"ok{t}"))
    j = half(True, 1).join(half(False, 2), ["arm_a", "arm_b"])
    v = F.when(F.col("ok1") & F.col("ok2"), F.when(F.signum("d1") == F.signum("d2"), "agree").otherwise("flip")).otherwise("unresolved")
    return j.select("arm_a", "arm_b", v.alias("verdict"))


@query(twin(", g as (select fold < 3 as side, arm, avg(value) as m from ms group by 1, 2), a as (select arm, max(m) filter (where side) as u, max(m) filter (where not side) as v from g group by 1), k as (select *, rank() over (order by u) as ru, rank() over (order by v) as rv from a) select round(corr(ru, rv), 6) + 0.0 as spearman, arg_min(arm, u) as best_first, arg_min(arm, v) as best_rest from k", "ms"))
def order_agreement(spark, d):
    x, _ = _halves(spark, d)
    a = x.groupBy("arm").agg(F.avg(F.when(F.col("side"), F.col("value"))).alias("u"), F.avg(F.when(~F.col("side"), F.col("value"))).alias("v"))
    best = a.agg(F.min_by("arm", "u").alias("best_first"), F.min_by("arm", "v").alias("best_rest"))
    return tidy(R.spearman(a, [], "u", "v").crossJoin(best), "best_first best_rest", "", "spearman")


@query(twin(f", k as (select *, conf_high - conf_low > 0.4 as wide, {rank_sql('y_true', 'endpoint')} as rk from labs), g as (select endpoint, sum(rk) filter (where wide) as rs, count(*) filter (where wide) as n1, count(*) filter (where not wide) as n2 from k group by 1) select endpoint, round(rs - n1 * (n1 + 1) / 2, 1) + 0.0 as u, round(1 - 2 * (rs - n1 * (n1 + 1) / 2) / (n1 * n2), 6) + 0.0 as rank_biserial from g", "labs"))
def mwu(spark, d):
    m = C.mann_whitney(X.labels(spark, d).withColumn("wide", F.col("conf_high") - F.col("conf_low") > 0.4), ["endpoint"], "y_true", "wide")
    return m.select("endpoint", F.round("u", 1).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"))


_T22 = "select {0}, count(*) filter (where {1} and {2}) as n11, count(*) filter (where {1} and not {2}) as n10, count(*) filter (where not {1} and {2}) as n01, count(*) filter (where not {1} and not {2}) as n00 from {3} group by {0}"
_PHI = "round((n11::double * n00 - n10::double * n01) / sqrt((n11 + n10)::double * (n01 + n00) * (n11 + n01) * (n10 + n00)), 6) + 0.0 as phi"


@query(twin(_HARD + f", t as ({_T22.format('endpoint', 'hard', 'disputed', 'he')}) select *, round(n11::double * n00 / nullif(n10 * n01, 0), 6) + 0.0 as odds_ratio from t", "oof"))
def fisher_2x2(spark, d):
    return tidy(C.two_by_two(_flags(spark, d), ["endpoint"], "hard", "disputed"), "endpoint", "n11 n10 n01 n00", "odds_ratio")


@query(twin(_HARD + f", j as (select a.endpoint as ea, b.endpoint as eb, a.hard as x, b.hard as y from he a join he b on a.unit_id = b.unit_id and a.endpoint < b.endpoint), t as ({_T22.format('ea, eb', 'x', 'y', 'j')}) select ea, eb, n11, {_PHI} from t", "oof"))
def phi_transfer(spark, d):
    h = _flags(spark, d)
    side = lambda s, f: h.select("unit_id", F.col("endpoint").alias(f"e{s}"), F.col("hard").alias(f))
    t = C.two_by_two(side("a", "x").join(side("b", "y"), "unit_id").where("ea < eb"), ["ea", "eb"], "x", "y")
    return tidy(t, "ea eb", "n11", "phi")


@query(twin(f", k as (select *, conf_high - conf_low > 0.4 as wide from labs), g as (select endpoint, {corr_sql('y_true', 'wide::int::double')} as rr from k group by 1) select endpoint, round(rr, 6) + 0.0 as r, abs(rr) >= 0.3 as passes from g", "labs"))
def effect_gate(spark, d):
    k = X.labels(spark, d).withColumn("wide", (F.col("conf_high") - F.col("conf_low") > 0.4).cast("double"))
    return tidy(k.groupBy("endpoint").agg(R.safe_corr("y_true", "wide").alias("r")).withColumn("passes", F.abs("r") >= 0.3), "endpoint passes", "", "r")


@query(twin(", g as (select endpoint, avg(st_rae) filter (where arm = 'tree') as base, avg(st_rae) filter (where arm = 'plain') as loss, avg(st_rae) filter (where arm = 'deadzone') as both_ from sc group by 1) select endpoint, round(base - both_, 6) + 0.0 as gain, round((base - loss) / (base - both_), 5) + 0.0 as loss_share, round((loss - both_) / (base - both_), 5) + 0.0 as clip_share from g", "sc"))
def gain_decomp(spark, d):
    v = lambda a: F.avg(F.when(F.col("arm") == a, F.col("st_rae")))
    g = fold_scores(spark, d).groupBy("endpoint").agg(v("tree").alias("a"), v("plain").alias("b"), v("deadzone").alias("c"))
    gain = F.col("a") - F.col("c")
    return g.select("endpoint", F.round(gain, 6).alias("gain"), F.round((F.col("a") - F.col("b")) / gain, 5).alias("loss_share"), F.round((F.col("b") - F.col("c")) / gain, 5).alias("clip_share"))


_RC = ", e as (select *, y_pred - y_true as e from oof)"


def _resid(spark, d):
    return X.oof(spark, d).withColumn("e", F.col("y_pred") - F.col("y_true"))


_RCC = _RC + f", rc as (select a.endpoint, a.arm as arm_a, b.arm as arm_b, count(*) as n, {corr_sql('a.e', 'b.e')} as corr, {corr_sql('a.y_pred', 'b.y_pred')} as raw_corr from e a join e b on a.unit_id = b.unit_id and a.endpoint = b.endpoint and a.repeat_id = b.repeat_id and a.arm < b.arm group by 1, 2, 3)"


@query(twin(_RCC + f" select endpoint, arm_a, arm_b, n, {r('corr raw_corr')} from rc", "oof"))
def resid_corr(spark, d):
    return tidy(C.residual_correlation(_resid(spark, d), ["endpoint"], ["unit_id", "repeat_id"], "e", "y_pred"), "endpoint arm_a arm_b", "n", "corr raw_corr")


@query(twin(_RC + f", c as (select a.endpoint, a.arm, a.repeat_id as ra, b.repeat_id as rb, {corr_sql('a.e', 'b.e')} as c from e a join e b on a.unit_id = b.unit_id and a.endpoint = b.endpoint and a.arm = b.arm and a.repeat_id < b.repeat_id group by all) select endpoint, arm, count(*) as n_pairs, round(avg(c), 6) + 0.0 as floor, round(stddev_samp(c), 6) + 0.0 as sd from c group by 1, 2", "oof"))
def corr_floor(spark, d):
    e = _resid(spark, d).select("endpoint", F.col("arm").alias("model"), F.col("repeat_id").cast("string").alias("arm"), "unit_id", "e")
    c = C.residual_correlation(e, ["endpoint", "model"], ["unit_id"], "e")
    g = c.groupBy("endpoint", "model").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("corr").alias("floor"), F.stddev_samp("corr").alias("sd"))
    return tidy(g.withColumnRenamed("model", "arm"), "endpoint arm", "n_pairs", "floor sd")


@query(twin(_RCC + " select endpoint, arm, count(*) as n, round(avg(corr), 6) + 0.0 as mean_corr from (select endpoint, arm_a as arm, corr from rc union all select endpoint, arm_b, corr from rc) group by 1, 2", "oof"))
def pool_corr(spark, d):
    c = C.residual_correlation(_resid(spark, d), ["endpoint"], ["unit_id", "repeat_id"], "e")
    u = c.select("endpoint", F.col("arm_a").alias("arm"), "corr").union(c.select("endpoint", "arm_b", "corr"))
    return tidy(u.groupBy("endpoint", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("corr").alias("mean_corr")), "endpoint arm", "n", "mean_corr")


_FAM = "case when {0} in ('plain', 'deadzone') then 'net' else 'other' end"


@query(twin(_RCC + f" select least(fa, fb) as family_a, greatest(fa, fb) as family_b, count(*) as n, round(avg(corr), 6) + 0.0 as mean_corr from (select corr, {_FAM.format('arm_a')} as fa, {_FAM.format('arm_b')} as fb from rc) group by 1, 2", "oof"))
def family_corr(spark, d):
    c = C.residual_correlation(_resid(spark, d), ["endpoint"], ["unit_id", "repeat_id"], "e")
    fam = lambda x: F.when(F.col(x).isin("plain", "deadzone"), "net").otherwise("other")
    c = c.select("corr", fam("arm_a").alias("fa"), fam("arm_b").alias("fb"))
    g = c.groupBy(F.least("fa", "fb").alias("family_a"), F.greatest("fa", "fb").alias("family_b")).agg(F.count(F.lit(1)).alias("n"), F.avg("corr").alias("mean_corr"))
    return tidy(g, "family_a family_b", "n", "mean_corr")
