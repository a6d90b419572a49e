"""Scores, ranks, resampling and difficulty (section G)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.errors import soft_error
from plumbline.operators import metrics as M
from plumbline.operators import ranks as R
from plumbline.operators import resample as B
from plumbline.operators.concordance import kendall_any
from plumbline.operators.draws import bootstrap_draws, interval
from plumbline.plans.book import n, query, r, tidy
from plumbline.sources import fixtures as X
from plumbline.sources.fixtures import twin
from plumbline.sources.storage import materialise

AE = ["arm", "endpoint"]
_SOFT = "(greatest(y_pred - conf_high, 0) + greatest(conf_low - y_pred, 0))"
_FLAT = "max({0}) - min({0}) <= 1e-12"


def corr_sql(a: str, b: str) -> str:
    return f"case when not ({_FLAT.format(a)} or {_FLAT.format(b)}) then corr({a}, {b}) end"


def rank_sql(col: str, part: str) -> str:
    return f"(rank() over (partition by {part} order by {col}) + (count(*) over (partition by {part}, {col}) - 1) / 2.0e0)"


@query(twin(f"select arm, endpoint, n, hits, {r('soft_sum soft_max', digits=4)} from (select arm, endpoint, sum({_SOFT}) as soft_sum, max({_SOFT}) as soft_max, count(*) as n, count(*) filter (where {_SOFT} = 0) as hits from p group by 1, 2)", "p"))
def soft_errors(spark, d):
    s = soft_error("y_pred", "conf_low", "conf_high")
    g = X.predictions(spark, d).groupBy(*AE).agg(F.sum(s).alias("soft_sum"), F.max(s).alias("soft_max"), F.count(F.lit(1)).alias("n"), F.count_if(s == 0).alias("hits"))
    return tidy(g, "arm endpoint", "n hits", "soft_sum soft_max", 4)


_P_SCORES = """select arm, endpoint, count(*) as n,
  sum(greatest(y_pred - conf_high, 0) + greatest(conf_low - y_pred, 0)) / nullif(sum(greatest(m - conf_high, 0) + greatest(conf_low - m, 0)), 0) as st_rae,
  avg(abs(y_pred - y_true)) as mae, sqrt(avg((y_pred - y_true) ** 2)) as rmse, avg(y_pred - y_true) as bias, 1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true)) as r2,
  """ + corr_sql("y_true", "y_pred") + " as pearson from (select *, avg(y_true) over (partition by arm, endpoint) as m from p) t group by arm, endpoint"


@query(twin(f"select arm, endpoint, n, {r('st_rae')} from ({_P_SCORES})", "p"))
def st_rae(spark, d):
    return tidy(M.score(X.predictions(spark, d), AE), "arm endpoint", "n", "st_rae")


@query(twin(f"select arm, endpoint, {r('mae rmse bias r2')} from ({_P_SCORES})", "p"))
def reg_metrics(spark, d):
    return tidy(M.score(X.predictions(spark, d), AE), "arm endpoint", "", "mae rmse bias r2")


@query(twin(f"select arm, endpoint, {r('pearson')} from ({_P_SCORES})", "p"))
def pearson(spark, d):
    return tidy(M.score(X.predictions(spark, d), AE), "arm endpoint", "", "pearson")


@query(twin(f"select arm, {r('macro')} from (select arm, avg(st_rae) as macro from ({_P_SCORES}) group by arm)", "p"))
def macro_st_rae(spark, d):
    return tidy(M.macro(M.score(X.predictions(spark, d), AE), ["arm"], "st_rae", 3), "arm", "", "macro")


@query(twin(f"select arm, endpoint, count(*) as n, round({corr_sql('ra', 'rb')}, 6) + 0.0 as spearman from (select *, {rank_sql('y_true', 'arm, endpoint')} as ra, {rank_sql('y_pred', 'arm, endpoint')} as rb from p) group by 1, 2", "p"))
def spearman(spark, d):
    return tidy(R.spearman(X.predictions(spark, d), AE, "y_true", "y_pred", buckets=16), "arm endpoint", "n", "spearman")


_KEYS = "arm, endpoint, repeat_id, fold"
_TAU = f""", pairs as (
  select a.arm, a.endpoint, a.repeat_id, a.fold, sum(sign(a.y_true - b.y_true) * sign(a.y_pred - b.y_pred)) as s, count(*) filter (where a.y_true <> b.y_true) as x, count(*) filter (where a.y_pred <> b.y_pred) as y
  from oof a join oof b on a.arm = b.arm and a.endpoint = b.endpoint and a.repeat_id = b.repeat_id and a.fold = b.fold and a.unit_id < b.unit_id group by all),
sizes as (select {_KEYS}, count(*) as n from oof group by all)
select {_KEYS}, n, case when x > 0 and y > 0 then round(s / sqrt(x::double * y), 6) + 0.0 end as kendall from sizes join pairs using ({_KEYS})"""


@query(twin(_TAU, "oof"))
def kendall(spark, d):
    return tidy(M.kendall(X.oof(spark, d), ["arm", "endpoint", "repeat_id", "fold"], "y_true", "y_pred"), "arm endpoint repeat_id fold", "n", "kendall")


@query("""with o as (select o_orderkey as k, o_totalprice as x, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as y from orders),
pairs as (select sum(sign(a.x - b.x) * sign(a.y - b.y)) as s, count(*) filter (where a.x <> b.x) as x, count(*) filter (where a.y <> b.y) as y from o a join o b on a.k < b.k)
select (select count(*) from o) as n, round(s / sqrt(x::double * y), 6) + 0.0 as kendall from pairs""")
def kendall_whole(spark, d):
    """One group of all orders, which no task holds: ranges of either column."""
    o = X.table(spark, d, "orders").select("o_totalprice", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("days"))
    return tidy(kendall_any(o, [], "o_totalprice", "days", limit=2_000, ranges=16), "", "n", "kendall")


@query(twin(f"select {_KEYS}, n, {r('st_rae mae r2')} from sc", "sc"))
def score_folds(spark, d):
    return tidy(M.score(X.oof(spark, d), ["arm", "endpoint", "repeat_id", "fold"]), "arm endpoint repeat_id fold", "n", "st_rae mae r2")


SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(twin("select arm, endpoint, share, round(q, 6) + 0.0 as q from (select arm, endpoint, unnest([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0]) as share, unnest(quantile_cont(abs(y_pred - y_true), [0.05, 0.25, 0.5, 0.75, 0.95])) as q from p group by arm, endpoint)", "p"))
def quantiles(spark, d):
    rows = X.predictions(spark, d).withColumn("e", F.abs(F.col("y_pred") - F.col("y_true")))
    return tidy(R.quantiles(rows, AE, "e", SHARES), "arm endpoint share", "", "q")


def _edges(value: str, source: str, part: str, bins: int) -> str:
    """SQL: ``source`` with the quantile bin of ``value``."""
    shares = ", ".join(str(k / bins) for k in range(bins + 1))
    return f"""(select s.*, greatest(len(list_filter(edges[1:len(edges) - 1], lambda e: e < {value})) - 1, 0) as bin
      from {source} s join (select {part}, list_sort(list_distinct(quantile_cont({value}, [{shares}]))) as edges from {source} group by all) q using ({part}))"""


@query(twin(f"select endpoint, cast(bin as bigint) as bin, count(*) as n, round(min(y_true), 6) + 0.0 as low, round(max(y_true), 6) + 0.0 as high from {_edges('y_true', 'labs', 'endpoint', 10)} group by endpoint, bin", "labs"))
def qcut(spark, d):
    b = R.quantile_bin(X.labels(spark, d), ["endpoint"], "y_true", 10)
    g = b.groupBy("endpoint", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("y_true").alias("low"), F.max("y_true").alias("high"))
    return tidy(g, "endpoint", "bin n", "low high")


_DRAWN = """, pool as (select endpoint, repeat_id, fold, unit_id, row_number() over (partition by endpoint, repeat_id, fold order by unit_id) - 1 as k from (select distinct endpoint, repeat_id, fold, unit_id from oof)),
size as (select endpoint, repeat_id, fold, count(*) as n from pool group by all),
slots as (select endpoint, repeat_id, fold, n, b, s, cast(('0x' || substr(md5(concat_ws(':', endpoint, cast(repeat_id as varchar), cast(fold as varchar), cast(b as varchar), cast(s as varchar))), 1, 7)) as bigint) % n as k from size, lateral (select unnest(range({B})) as b) x, lateral (select unnest(range(n)) as s) y),
drawn as (select endpoint, repeat_id, fold, b, k, count(*) as times from slots group by all),
j as (select o.*, b, times from oof o join pool using (endpoint, repeat_id, fold, unit_id) join drawn using (endpoint, repeat_id, fold, k)),
m as (select arm, endpoint, repeat_id, fold, b, sum(times * y_true) / sum(times) as m from j group by all),
bs as (select arm, endpoint, repeat_id, fold, b, sum(times) as n, sum(times * abs(y_pred - y_true)) / sum(times) as mae,
  sum(times * (greatest(y_pred - conf_high, 0) + greatest(conf_low - y_pred, 0))) / nullif(sum(times * (greatest(m - conf_high, 0) + greatest(conf_low - m, 0))), 0) as st_rae
  from j join m using (arm, endpoint, repeat_id, fold, b) group by arm, endpoint, repeat_id, fold, b)
"""
SAMPLES = 20
DRAWS = 1000


_FOLD = ["endpoint", "repeat_id", "fold"]


def _boot(spark, d):
    rows = X.oof(spark, d)
    return rows, B.draw_counts(rows, _FOLD, "unit_id", SAMPLES)


def _boot_scores(spark, d):
    rows, draws = _boot(spark, d)
    return B.bootstrap_scores(rows, ["arm", *_FOLD], draws, _FOLD)


_BOOT = _DRAWN.replace("{B}", str(SAMPLES))


@query(twin(_BOOT + f"select arm, endpoint, repeat_id, fold, cast(b as integer) as b, {n('n')}, {r('mae st_rae')} from bs", "oof"))
def bootstrap_metrics(spark, d):
    return tidy(_boot_scores(spark, d), "arm endpoint repeat_id fold b", "n", "mae st_rae")


@query()
def bootstrap_poisson(spark, d):
    p = X.predictions(spark, d)
    return tidy(B.poisson_bootstrap(p, AE, "unit_id", F.abs(F.col("y_pred") - F.col("y_true")), 25), "arm endpoint b", "", "mean")


@query(twin(_BOOT + "select arm, endpoint, repeat_id, fold, count(*) as n, round(avg(st_rae), 6) + 0.0 as mean, round(quantile_cont(st_rae, 0.025), 6) + 0.0 as low, round(quantile_cont(st_rae, 0.975), 6) + 0.0 as high from bs group by all", "oof"))
def bootstrap_ci(spark, d):
    g = _boot_scores(spark, d).groupBy("arm", *_FOLD).agg(F.count(F.lit(1)).alias("n"), F.avg("st_rae").alias("mean"), F.percentile("st_rae", F.lit(0.025)).alias("low"), F.percentile("st_rae", F.lit(0.975)).alias("high"))
    return tidy(g, "arm endpoint repeat_id fold", "n", "mean low high")


@query(twin(_BOOT.rstrip() + f""", e as (select arm, endpoint, repeat_id, fold, b, y_true, y_pred, unnest(range(times)) as t from j),
  rk as (select *, {rank_sql('y_true', 'arm, endpoint, repeat_id, fold, b')} as ra, {rank_sql('y_pred', 'arm, endpoint, repeat_id, fold, b')} as rb from e),
  sp as (select arm, endpoint, repeat_id, fold, b, {corr_sql('ra', 'rb')} as s from rk group by all)
  select arm, endpoint, repeat_id, fold, count(s) as n, count(*) filter (where s is null) as degenerate, round(avg(s), 6) + 0.0 as mean, round(quantile_cont(s, 0.025), 6) + 0.0 as low, round(quantile_cont(s, 0.975), 6) + 0.0 as high from sp group by all""", "oof"))
def boot_spearman(spark, d):
    rows, draws = _boot(spark, d)
    s = B.bootstrap_spearman(rows, ["arm", *_FOLD], draws, _FOLD, SAMPLES)
    g = s.groupBy("arm", *_FOLD).agg(F.count("s").alias("n"), F.count_if(F.col("s").isNull()).alias("degenerate"), F.avg("s").alias("mean"), F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"))
    return tidy(g, "arm endpoint repeat_id fold", "n degenerate", "mean low high")


@query()
def bootstrap_thousand(spark, d):
    """1,000 draws of every fold: intervals of ST-RAE and of Spearman's correlation, with the draws that leave them undefined."""
    keys = ["arm", *_FOLD]
    b = materialise(bootstrap_draws(X.oof(spark, d), keys, "unit_id", DRAWS), "draws")  # read for both intervals
    both = interval(b, keys, "st_rae").join(interval(b.select(*keys, "spearman"), keys, "spearman").select(*keys, F.col("mean").alias("rho"), F.col("low").alias("rho_low"), F.col("high").alias("rho_high"), F.col("undefined").alias("rho_undefined")), keys)
    return tidy(both, "arm endpoint repeat_id fold", "undefined rho_undefined", "mean low high rho rho_low rho_high")


@query(twin(f"select arm, repeat_id, fold, count(*) as n_endpoints, round(avg(st_rae), 6) + 0.0 as st_rae, round(avg(mae), 6) + 0.0 as mae, max(dup) as dup from (select *, cast(count(*) over (partition by {_KEYS}) as bigint) as dup from sc) group by 1, 2, 3", "sc"))
def point_estimates(spark, d):
    s = M.score(X.oof(spark, d), ["arm", "endpoint", "repeat_id", "fold"])
    g = s.groupBy("arm", "repeat_id", "fold").agg(F.count(F.lit(1)).alias("n_endpoints"), (F.count(F.lit(1)) - F.countDistinct("endpoint") + 1).alias("dup"), F.avg("st_rae").alias("st_rae"), F.avg("mae").alias("mae"))
    return tidy(g, "arm repeat_id fold", "n_endpoints dup", "st_rae mae")


def fold_scores(spark, d):
    return M.score(X.oof(spark, d), ["arm", "endpoint", "repeat_id", "fold"])


@query(twin("select arm, endpoint, metric, count(*) as n, round(avg(v), 6) + 0.0 as mean, round(stddev_samp(v), 6) + 0.0 as sd from (select arm, endpoint, unnest(['st_rae', 'mae', 'r2']) as metric, unnest([st_rae, mae, r2]) as v from sc) group by all", "sc"))
def arm_summary(spark, d):
    long = fold_scores(spark, d).unpivot(["arm", "endpoint"], ["st_rae", "mae", "r2"], "metric", "v")
    return tidy(long.groupBy("arm", "endpoint", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")), "arm endpoint metric", "n", "mean sd")


@query(twin(f"select arm, endpoint, {r('first rest delta')}, round(max(abs(delta)) over (), 6) + 0.0 as worst from (select *, rest - first as delta from (select arm, endpoint, avg(st_rae) filter (where repeat_id < 3) as first, avg(st_rae) filter (where repeat_id >= 3) as rest from sc group by all))", "sc"))
def foldset_delta(spark, d):
    s = fold_scores(spark, d)
    g = s.groupBy(*AE).agg(F.avg(F.when(F.col("repeat_id") < 3, F.col("st_rae"))).alias("first"), F.avg(F.when(F.col("repeat_id") >= 3, F.col("st_rae"))).alias("rest")).withColumn("delta", F.col("rest") - F.col("first"))
    worst = g.agg(F.max(F.abs("delta")).alias("worst"))
    return tidy(g.crossJoin(worst), "arm endpoint", "", "first rest delta worst")


#: Student's t at 97.5 % by degrees of freedom (fixed values).
T975 = {4: 2.7764451051977987, 9: 2.2621571628540993, 14: 2.1447866879169273, 19: 2.093024054408263, 24: 2.0638985616280205, 29: 2.045229642132703}
_T = ", ".join(f"({k}, {v}e0)" for k, v in T975.items())


@query(twin(f"select arm, n, {r('mean low high')} from (select arm, n, mean, mean - t * sd / sqrt(n) as low, mean + t * sd / sqrt(n) as high from (select arm, count(*) as n, avg(value) as mean, stddev_samp(value) as sd from ms group by arm) join (values {_T}) q(df, t) on df = n - 1)", "ms"))
def mean_ci(spark, d):
    g = M.macro_scores(X.oof(spark, d), ["arm", "repeat_id", "fold"]).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    t = spark.sql(f"select * from values {_T} as q(df, t)")
    j = g.join(F.broadcast(t), F.col("df") == F.col("n") - 1)
    half = F.col("t") * F.col("sd") / F.sqrt("n")
    return tidy(j.select("arm", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high")), "arm", "n", "mean low high")


@query(twin("select arm, endpoint, unit_id, round(avg(y_pred), 6) + 0.0 as y_pred, count(*) as n_repeats from oof group by 1, 2, 3", "oof"))
def repeat_avg(spark, d):
    return tidy(M.repeat_average(X.oof(spark, d), ["arm", "endpoint", "unit_id"]), "arm endpoint unit_id", "n_repeats", "y_pred")


_DIFF = f""", ba as (select unit_id, endpoint, arm, avg(y_pred - y_true) as err, stddev_samp(y_pred - y_true) as sd, avg({_SOFT}) as soft from oof group by 1, 2, 3),
du as (select unit_id, endpoint, avg(abs(err)) as abs_error, stddev_samp(err) as arm_sd, avg(sd) as repeat_sd, avg(soft) as soft from ba group by 1, 2)"""


@query(twin(_DIFF + f" select unit_id, endpoint, {r('abs_error arm_sd repeat_sd soft')} from du", "oof"))
def unit_difficulty(spark, d):
    return tidy(M.unit_difficulty(X.oof(spark, d)), "unit_id endpoint", "", "abs_error arm_sd repeat_sd soft")


_HARD = _DIFF + """, du2 as (select unit_id, endpoint, round(abs_error, 6) as abs_error, round(arm_sd, 6) as arm_sd, round(soft, 6) as soft from du),
q as (select endpoint, quantile_cont(abs_error, 0.9) as ha, quantile_cont(abs_error, 0.1) as la, quantile_cont(soft, 0.9) as hs, quantile_cont(arm_sd, 0.9) as hd from du2 group by endpoint),
he as (select unit_id, endpoint, abs_error >= ha - 1e-9 as hard, abs_error <= la + 1e-9 as easy, soft >= hs - 1e-9 as hard_soft, arm_sd >= hd - 1e-9 as disputed from du2 join q using (endpoint))"""


def _flags(spark, d):
    du = M.unit_difficulty(X.oof(spark, d))
    return M.hard_easy(du.select("unit_id", "endpoint", *[F.round(c, 6).alias(c) for c in ("abs_error", "arm_sd", "soft")]))


@query(twin(_HARD + " select endpoint, count(*) as n, count(*) filter (where hard) as hard, count(*) filter (where easy) as easy, count(*) filter (where hard_soft) as hard_soft, count(*) filter (where disputed) as disputed from he group by endpoint", "oof"))
def hard_easy(spark, d):
    g = _flags(spark, d).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("hard", "easy", "hard_soft", "disputed")])
    return tidy(g, "endpoint", "n hard easy hard_soft disputed")


@query(twin(_HARD + " select endpoint, round(j, 6) + 0.0 as jaccard, j < 0.8 as material from (select endpoint, count(*) filter (where hard and hard_soft) / nullif(count(*) filter (where hard or hard_soft), 0) as j from he group by endpoint)", "oof"))
def flag_jaccard(spark, d):
    j = F.try_divide(F.count_if(F.col("hard") & F.col("hard_soft")), F.count_if(F.col("hard") | F.col("hard_soft")))
    return tidy(_flags(spark, d).groupBy("endpoint").agg(j.alias("jaccard")).withColumn("material", F.col("jaccard") < 0.8), "endpoint material", "", "jaccard")


_DEC = f"""select arm, endpoint, cast(bin as bigint) as bin, n, {r('low high error')}, cast(sum(cross_) over (partition by arm, endpoint) as bigint) as crossings, min(falls) over (partition by arm, endpoint) as monotone
from (select *, coalesce(cast(sign(lag(error) over w) <> sign(error) as integer), 0) as cross_, coalesce(error <= lag(error) over w, true) as falls
  from (select arm, endpoint, bin, count(*) as n, min(y_true) as low, max(y_true) as high, avg(y_pred - y_true) as error from {_edges('y_true', 'p', 'arm, endpoint', 10)} group by all) window w as (partition by arm, endpoint order by bin))"""


@query(twin(_DEC, "p"))
def error_by_decile(spark, d):
    b = R.quantile_bin(X.predictions(spark, d), AE, "y_true", 10)
    g = b.groupBy(*AE, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("y_true").alias("low"), F.max("y_true").alias("high"), F.avg(F.col("y_pred") - F.col("y_true")).alias("error"))
    w = Window.partitionBy(*AE).orderBy("bin")
    prev = F.lag("error").over(w)
    g = g.withColumn("cross", F.coalesce((F.signum(prev) != F.signum("error")).cast("int"), F.lit(0))).withColumn("falls", F.coalesce(F.col("error") <= prev, F.lit(True)))
    all_ = Window.partitionBy(*AE)
    g = g.withColumn("crossings", F.sum("cross").over(all_)).withColumn("monotone", F.min("falls").over(all_))
    return tidy(g, "arm endpoint monotone", "bin n crossings", "low high error")


@query(twin("select arm, endpoint, round(avg(y_pred - y_true), 6) + 0.0 as mean, round(median(y_pred - y_true), 6) + 0.0 as median, round(count(*) filter (where y_pred < y_true) / count(*), 6) + 0.0 as negative from p group by all", "p"))
def sign_summary(spark, d):
    e = F.col("y_pred") - F.col("y_true")
    p = X.predictions(spark, d)
    g = p.groupBy(*AE).agg(F.avg(e).alias("mean"), F.avg((e < 0).cast("int")).alias("negative"))
    return tidy(g.join(R.medians(p, AE, e, "median"), AE), "arm endpoint", "", "mean median negative")


@query(twin("""select arm, endpoint, round(sum(greatest(y_pred - conf_high, 0)), 4) + 0.0 as over_total, round(sum(greatest(conf_low - y_pred, 0)), 4) + 0.0 as under_total,
  round(avg(conf_high - conf_low) filter (where y_true <= m), 4) + 0.0 as width_low, round(avg(conf_high - conf_low) filter (where y_true > m), 4) + 0.0 as width_high
  from p join (select endpoint, median(y_true) as m from labs group by endpoint) q using (endpoint) group by all""", "p"))
def asymmetry(spark, d):
    mid = R.medians(X.labels(spark, d), ["endpoint"], "y_true", "m")
    wd = F.col("conf_high") - F.col("conf_low")
    g = X.predictions(spark, d).join(mid, "endpoint").groupBy(*AE).agg(
        F.sum(F.greatest(F.col("y_pred") - F.col("conf_high"), F.lit(0.0))).alias("over_total"), F.sum(F.greatest(F.col("conf_low") - F.col("y_pred"), F.lit(0.0))).alias("under_total"),
        F.avg(F.when(F.col("y_true") <= F.col("m"), wd)).alias("width_low"), F.avg(F.when(F.col("y_true") > F.col("m"), wd)).alias("width_high"))
    return tidy(g, "arm endpoint", "", "over_total under_total width_low width_high", 4)


_PW = "(select *, round(conf_high - conf_low, 6) as width from p)"


@query(twin(f"select arm, endpoint, cast(bin as bigint) as bin, count(*) as n, round(avg(abs(y_pred - y_true)), 6) + 0.0 as error, round(stddev_samp(abs(y_pred - y_true)) / sqrt(count(*)), 6) + 0.0 as se from {_edges('width', _PW, 'arm, endpoint', 10)} group by all", "p"))
def binned_error(spark, d):
    b = R.quantile_bin(X.predictions(spark, d).withColumn("width", F.round(F.col("conf_high") - F.col("conf_low"), 6)), AE, "width", 10)
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    return tidy(b.groupBy(*AE, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("error"), (F.stddev_samp(e) / F.sqrt(F.count(F.lit(1)))).alias("se")), "arm endpoint", "bin n", "error se")


@query(twin(f"select arm, endpoint, round({corr_sql('abs(y_pred - y_true)', '(conf_high - conf_low)')}, 6) + 0.0 as width_corr, round({corr_sql('abs(y_pred - y_true)', 'y_true')}, 6) + 0.0 as label_corr from p group by all", "p"))
def resid_cov_corr(spark, d):
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    return tidy(X.predictions(spark, d).groupBy(*AE).agg(R.safe_corr(e, F.col("conf_high") - F.col("conf_low")).alias("width_corr"), R.safe_corr(e, F.col("y_true")).alias("label_corr")), "arm endpoint", "", "width_corr label_corr")


_PS = f""", t as (select arm, endpoint, repeat_id, y_true, abs(y_pred - y_true) as e, round(conf_high - conf_low, 6) as width from oof),
rk as (select arm, endpoint, repeat_id, {rank_sql('e', 'arm, endpoint, repeat_id')} as a, {rank_sql('y_true', 'arm, endpoint, repeat_id')} as b, {rank_sql('width', 'arm, endpoint, repeat_id')} as c from t),
c as (select arm, endpoint, repeat_id, {corr_sql('a', 'b')} as r_ab, {corr_sql('a', 'c')} as r_ac, {corr_sql('b', 'c')} as r_bc from rk group by all)
select arm, endpoint, repeat_id, {r('r_ab r_ac r_bc')}, round((r_ab - r_ac * r_bc) / sqrt((1 - r_ac ** 2) * (1 - r_bc ** 2)), 6) + 0.0 as partial from c"""


@query(twin(_PS, "oof"))
def partial_spearman(spark, d):
    t = X.oof(spark, d).select(*AE, "repeat_id", "y_true", F.abs(F.col("y_pred") - F.col("y_true")).alias("e"), F.round(F.col("conf_high") - F.col("conf_low"), 6).alias("width"))
    return tidy(M.partial_spearman(t, [*AE, "repeat_id"], "e", "y_true", "width"), "arm endpoint repeat_id", "", "r_ab r_ac r_bc partial")


_GATE = "select *, st_rae < 0.95 and r2 > 0.05 as passes, mae > 3 or abs(bias) > 0.25 as alarm from (" + _P_SCORES + ")"


@query(twin(f"select arm, endpoint, passes, alarm, bool_or(passes and not alarm) over (partition by arm) as arm_passes from ({_GATE})", "p"))
def gate_verdict(spark, d):
    g = M.score(X.predictions(spark, d), AE).select(*AE, ((F.col("st_rae") < 0.95) & (F.col("r2") > 0.05)).alias("passes"), ((F.col("mae") > 3) | (F.abs("bias") > 0.25)).alias("alarm"))
    arm = g.groupBy("arm").agg(F.bool_or(F.col("passes") & ~F.col("alarm")).alias("arm_passes"))
    return g.join(arm, "arm").select(*AE, "passes", "alarm", "arm_passes")


@query(twin(f""", t as (select repeat_id, fold, unit_id, endpoint, plain as a, deadzone as b from w),
k as (select *, {rank_sql('a', 'endpoint')} as ra, {rank_sql('b', 'endpoint')} as rb from t)
select endpoint, round(corr(a, b), 6) + 0.0 as pearson, round(corr(ra, rb), 6) + 0.0 as spearman, round(avg(abs(a - b)), 6) + 0.0 as mean_diff, round(median(abs(a - b)), 6) + 0.0 as median_diff, round(max(abs(a - b)), 6) + 0.0 as max_diff, count(*) filter (where abs(a - b) > 0.5) as moved from k group by endpoint""", "w"))
def pred_agreement(spark, d):
    t = X.wide(spark, d).select("endpoint", F.col("plain").alias("a"), F.col("deadzone").alias("b"))
    rk = R.average_ranks(t, ["endpoint"], {"a": "ra", "b": "rb"})
    e = F.abs(F.col("a") - F.col("b"))
    g = rk.groupBy("endpoint").agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.avg(e).alias("mean_diff"), F.max(e).alias("max_diff"), F.count_if(e > 0.5).alias("moved"))
    g = g.join(R.medians(t, ["endpoint"], e, "median_diff"), "endpoint")
    return tidy(g, "endpoint", "moved", "pearson spearman mean_diff median_diff max_diff")


@query(twin(f"select arm, endpoint, {r('ratio mean_offset')}, round(min(ratio) over (partition by arm), 6) + 0.0 as low, round(max(ratio) over (partition by arm), 6) + 0.0 as high from (select arm, endpoint, stddev_samp(y_pred) / stddev_samp(y_true) as ratio, avg(y_pred) - avg(y_true) as mean_offset from p group by 1, 2)", "p"))
def spread_ratio(spark, d):
    g = X.predictions(spark, d).groupBy(*AE).agg((F.stddev_samp("y_pred") / F.stddev_samp("y_true")).alias("ratio"), (F.avg("y_pred") - F.avg("y_true")).alias("mean_offset"))
    arm = g.groupBy("arm").agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"))
    return tidy(g.join(arm, "arm"), "arm endpoint", "", "ratio mean_offset low high")


@query(twin(f"select arm, {r('a b gap')}, round(gap / abs(a), 6) + 0.0 as relative from (select *, b - a as gap from (select arm, avg(st_rae) filter (where fold < 3) as a, avg(st_rae) filter (where fold >= 3) as b from sc group by arm))", "sc"))
def regime_gap(spark, d):
    s = fold_scores(spark, d)
    g = s.groupBy("arm").agg(F.avg(F.when(F.col("fold") < 3, F.col("st_rae"))).alias("a"), F.avg(F.when(F.col("fold") >= 3, F.col("st_rae"))).alias("b")).withColumn("gap", F.col("b") - F.col("a"))
    return tidy(g.withColumn("relative", F.try_divide(F.col("gap"), F.abs("a"))), "arm", "", "a b gap relative")


@query("""with e as (select event_type as run, cast(event_id % 50 as bigint) as epoch, user_id % 5 as fold, value from events),
c as (select run, fold, epoch, round(avg(value), 6) as loss from e group by all), b as (select run, fold, arg_min(epoch, struct_pack(loss := loss, epoch := epoch)) as epoch, min(loss) as loss from c group by all)
select run, cast(median(epoch) as double) as best_epoch, round(avg(loss), 6) + 0.0 as loss from b group by run""")
def argmin_epoch(spark, d):
    e = X.table(spark, d, "events")
    c = e.groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 5).alias("fold"), (F.col("event_id") % 50).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    b = c.groupBy("run", "fold").agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss"))
    return tidy(b.groupBy("run").agg(F.median("epoch").alias("best_epoch"), F.avg("loss").alias("loss")), "run", "", "best_epoch loss")


@query("""with s as (select event_type as submission, date_trunc('day', ts) as day, round(avg(value), 6) as score from events group by all)
select submission, cast(day as varchar)[1:10] as day, score + 0.0 as score, min(score) over (partition by submission order by day rows unbounded preceding) + 0.0 as best from s""")
def running_best(spark, d):
    s = X.table(spark, d, "events").groupBy(F.col("event_type").alias("submission"), F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("score"))
    return tidy(M.running_best(s, ["submission"], ["day"], "score").withColumn("day", F.date_format("day", "yyyy-MM-dd")), "submission day", "", "score best")
