"""Similarity, clustering, splits and training populations (sections E and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators import ranks as R
from plumbline.operators import similarity as E
from plumbline.operators import splits as S
from plumbline.operators.graph import connected_components
from plumbline.plans.book import query, r, tidy
from plumbline.sources import fixtures as X
from plumbline.sources.fixtures import twin

T = X.table
LEAST = 0.3


def documents(spark, d):
    return T(spark, d, "documents").select("doc_id", E.token_set("text").alias("tokens"))


def vectors(spark, d):
    return E.unit_vectors(T(spark, d, "embeddings"), "vec_id", "embedding", "label")


_TOK = "tok as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as tokens from documents)"
_PAIRS = "pairs as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as sim from embeddings a join embeddings b on a.vec_id < b.vec_id)"
_NEAR = f"{_PAIRS}, near as (select a, b, sim from pairs where sim >= 0.3), sym as (select a as q, b as r, sim from pairs union all select b, a, sim from pairs)"


@query(f"with {_TOK}, b as (select doc_id, list_sort(list_distinct(list_transform(tokens, lambda t: cast(('0x' || substr(md5(t), 1, 7))::bigint % 256 as integer)))) as bits from tok) select doc_id, len(bits) as n_bits, cast(coalesce(list_sum(bits), 0) as bigint) as bit_sum from b")
def set_fingerprint(spark, d):
    b = documents(spark, d).select("doc_id", E.set_fingerprint(F.col("tokens"), 256).alias("bits"))
    return b.select("doc_id", F.size("bits").cast("long").alias("n_bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda s, x: s + x).alias("bit_sum"))


_JP = f"with {_TOK}, j as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.tokens, b.tokens)) as common, len(a.tokens) as na, len(b.tokens) as nb from tok a join tok b on a.doc_id < b.doc_id where len(a.tokens) > 0 and len(b.tokens) > 0), p as (select a, b, common, common / (na + nb - common)::double as sim from j)"


_JC = f"with {_TOK}, c as (select list_sort(tokens) as tokens, min(doc_id) as rep, count(*) as m from tok where len(tokens) > 0 group by 1), p as (select a.rep as a, b.rep as b, a.m as ma, b.m as mb, len(list_intersect(a.tokens, b.tokens)) as common, len(a.tokens) as na, len(b.tokens) as nb from c a join c b on a.rep < b.rep and least(len(a.tokens), len(b.tokens)) >= 0.8 * greatest(len(a.tokens), len(b.tokens))), l as (select a, b, common, common / (na + nb - common)::double as sim from p where common / (na + nb - common)::double >= 0.8)"


@query(_JC + " select a, b, cast(common as bigint) as common, round(sim, 6) + 0.0 as sim from l union all select c.rep, doc_id, len(c.tokens), 1.0 from tok join c on list_sort(tok.tokens) = c.tokens where doc_id <> c.rep")
def sim_join(spark, d):
    """Linked pairs of classes of equal token sets, by their smallest doc_id, and a row for each other member with its class (similarity one)."""
    linked, members = E.jaccard_pairs(documents(spark, d), "doc_id", "tokens", 0.8)
    return tidy(E.membership(linked, members), "a b", "common", "sim")


@query(_JC + ", k as (select rep, count(*) as links from (select a as rep from l union all select b from l) group by 1) select doc_id, c.rep, c.m as members, coalesce(links, 0) as links from tok join c on list_sort(tok.tokens) = c.tokens left join k on k.rep = c.rep")
def sim_classes(spark, d):
    """Each document with its class of equal token sets and the class's links."""
    linked, members = E.jaccard_pairs(documents(spark, d), "doc_id", "tokens", 0.8)
    return E.class_links(linked, members).withColumnRenamed("id", "doc_id")


@query(_JP + " select count(*) as n_pairs, round(avg(sim), 6) + 0.0 as mean, round(median(sim), 6) + 0.0 as middle from p")
def jaccard_pairs(spark, d):
    """Summary over all pairs of documents, alike or not."""
    return tidy(E.tally_summary(E.jaccard_tally(documents(spark, d), "doc_id", "tokens")), "", "n_pairs", "mean middle")


def near_pairs(spark, d):
    return E.cosine_pairs(vectors(spark, d), LEAST)


@query(f"with {_NEAR} select a, b, round(sim, 5) + 0.0 as sim from near")
def cosine_pairs(spark, d):
    return tidy(near_pairs(spark, d), "a b", "", "sim", 5)


@query(f"with {_NEAR} select q, round(max(sim), 5) + 0.0 as sim from sym where q % 20 = 0 and r % 20 <> 0 group by q")
def nn_sim(spark, d):
    v = vectors(spark, d)
    return tidy(E.nearest(v.where("id % 20 = 0"), v.where("id % 20 <> 0")), "q", "", "sim", 5)


@query(f"with {_NEAR} select q, round(max(sim), 5) + 0.0 as sim from sym group by q")
def nn_loo(spark, d):
    v = vectors(spark, d)
    return tidy(E.nearest(v, v), "q", "", "sim", 5)


_VF = "vf as (select vec_id, cast(('0x' || substr(md5(concat(vec_id, ':f')), 1, 7))::bigint % 5 as integer) as fold from embeddings)"


@query(f"with {_NEAR}, {_VF}, n as (select q, x.fold, max(sim) as sim from sym join vf x on x.vec_id = q join vf y on y.vec_id = r where q % 20 = 0 and x.fold <> y.fold group by 1, 2) select fold, count(*) as n, round(avg(sim), 5) + 0.0 as mean, round(median(sim), 5) + 0.0 as middle from n group by fold")
def nn_by_fold(spark, d):
    v = vectors(spark, d).withColumn("fold", (X.draw(F.md5(F.concat(F.col("id").cast("string"), F.lit(":f")))) % 5).cast("int"))
    out = None
    for k in range(5):
        n = E.nearest(v.where((F.col("id") % 20 == 0) & (F.col("fold") == k)), v.where(F.col("fold") != k)).withColumn("fold", F.lit(k))
        out = n if out is None else out.union(n)
    return tidy(out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("mean"), F.median("sim").alias("middle")), "fold", "n", "mean middle", 5)


_SIZED = "k as (select unnest(range(3)) as k), n as (select k, q, max(sim) as sim from sym cross join k where ('0x' || substr(md5(concat(r, ':s', k)), 1, 7))::bigint / 268435456.0e0 < 0.8 group by 1, 2)"


@query(f"with {_NEAR}, {_SIZED} select k, count(*) as n, round(median(sim), 5) + 0.0 as middle from n group by k")
def nn_size_matched(spark, d):
    """Every vector against three draws of 80 % of the table: the draws are the control that is measured."""
    v = vectors(spark, d)
    out = None
    for k in range(3):
        ref = v.where(X.unit(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":s{k}")))) < 0.8)
        n = E.nearest(v, ref).withColumn("k", F.lit(k))
        out = n if out is None else out.union(n)
    return tidy(out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.median("sim").alias("middle")), "", "k n", "middle", 5)


@query(f"with {_NEAR}, n as (select 'all' as side, q, max(sim) as s from sym group by 2 union all select 'other label', q, max(sim) from sym join embeddings x on x.vec_id = q join embeddings y on y.vec_id = r where x.label <> y.label group by 2) select side, count(*) as n, round(avg(s), 5) + 0.0 as mean, round(median(s), 5) + 0.0 as middle from n group by side")
def nn_summary(spark, d):
    v = vectors(spark, d)
    every = E.nearest(v, v).select(F.lit("all").alias("side"), "sim").union(E.nearest(v, v, apart="label").select(F.lit("other label"), "sim"))
    return tidy(every.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("mean"), F.median("sim").alias("middle")), "side", "n", "mean middle", 5)


def _values(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"))


_CL = f"{_NEAR}, cl as (select n.a, n.b, sim, abs(x.label - y.label)::double as delta from near n join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b)"


@query(f"with {_CL} select a, b, round(delta, 5) + 0.0 as delta, round(delta / (1 - sim), 4) + 0.0 as score, delta >= 3 as is_cliff from cl")
def cliffs(spark, d):
    c = E.valued_cliffs(E.cosine_pairs(vectors(spark, d), LEAST, "label"), 3.0)
    return c.select("a", "b", F.round("delta", 5).alias("delta"), F.round("score", 4).alias("score"), "is_cliff")


@query(f"with {_CL} select count(*) as n_pairs, count(*) filter (where delta >= 3) as n_cliffs, round(avg((delta >= 3)::int), 6) + 0.0 as prevalence from cl")
def cliff_prevalence(spark, d):
    c = E.cosine_tally(vectors(spark, d), LEAST, "label", 3.0)
    return tidy(c.select("n_pairs", F.col("n_far").alias("n_cliffs"), F.try_divide("n_far", "n_known").alias("prevalence")), "", "n_pairs n_cliffs", "prevalence")


@query("with b as (select p_partkey, floor(p_size / 10) as bin from part) select p_partkey, cast(bin as bigint) as bin from b qualify row_number() over (partition by bin order by md5(concat(p_partkey, ':s')), p_partkey) <= 20")
def strat_sample(spark, d):
    from pyspark.sql.window import Window

    b = T(spark, d, "part").select("p_partkey", F.floor(F.col("p_size") / 10).alias("bin"))
    w = Window.partitionBy("bin").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(":s"))), "p_partkey")
    return b.withColumn("_r", F.row_number().over(w)).where("_r <= 20").drop("_r")


@query()
def leader_cluster(spark, d):
    return E.leader_clusters(T(spark, d, "embeddings").select(F.col("vec_id").alias("id")), near_pairs(spark, d).select("a", "b"))


@query("with s as (select p_brand, p_type, count(*) as n from part group by 1, 2) select count(*) as clusters, cast(sum(n) as bigint) as members, round(avg((n = 1)::int), 6) + 0.0 as singleton_share, min(n) as smallest, round(median(n), 6) + 0.0 as middle, round(avg(n), 6) + 0.0 as mean, max(n) as largest from s")
def cluster_sizes(spark, d):
    p = T(spark, d, "part").withColumn("c", F.concat_ws("/", "p_brand", "p_type"))
    return tidy(E.cluster_sizes(p, "c"), "", "clusters members smallest largest", "singleton_share middle mean")


@query("""with e as (select distinct c_custkey as a, c_nationkey + 1000000000000 as b from customer union select s_suppkey + 2000000000000, s_nationkey + 1000000000000 from supplier),
hub as (select b, min(least(a, b)) as m from e group by b)
select a as node, m as component from e join hub using (b) union select b, m from hub""")
def coupled_groups(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("a"), (F.col("c_nationkey") + 1000000000000).cast("long").alias("b"))
    s = T(spark, d, "supplier").select((F.col("s_suppkey") + 2000000000000).cast("long").alias("a"), (F.col("s_nationkey") + 1000000000000).cast("long").alias("b"))
    return connected_components(c.union(s), "a", "b")


@query("select n, count(*) as groups from (select l_orderkey, count(*) as n from lineitem group by 1) group by n")
def freq_of_freq(spark, d):
    return T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


_PN = """with t as (select unnest(range(1, 11)) as t), s as (select t, p_partkey, p_brand, row_number() over (partition by t order by p_partkey) as k from part cross join t),
v as (select t, p_retailprice as v, row_number() over (partition by t order by md5(concat_ws(':', cast(p_partkey as varchar), cast(t as varchar))), p_partkey) as k from part cross join t),
n as (select t, avg(sp) as s from (select s.t, p_brand, max(v) - min(v) as sp, count(*) as c from s join v on s.t = v.t and s.k = v.k group by 1, 2) where c > 1 group by t),
o as (select avg(sp) as observed from (select p_brand, max(p_retailprice) - min(p_retailprice) as sp, count(*) as c from part group by 1) where c > 1)
select round(max(observed), 4) + 0.0 as observed, round(avg(s), 4) + 0.0 as null_mean, round(stddev_samp(s), 4) + 0.0 as null_sd, round(avg((s >= observed - 1e-6)::int), 4) + 0.0 as p from n cross join o"""


@query(_PN)
def permutation_null(spark, d):
    return tidy(E.permutation_null(T(spark, d, "part"), "p_partkey", "p_brand", "p_retailprice", 10), "", "", "observed null_mean null_sd p", 4)


@query(f"with {_CL}, top as (select vec_id as seed from embeddings order by label desc, vec_id limit 20), m as (select a as x, b as y, sim from near union all select b, a, sim from near), c as (select x as seed, y as id, sim from m where x in (select seed from top) and y not in (select seed from top)), s as (select *, row_number() over (partition by seed order by sim desc, id) as slot from c), k as (select *, row_number() over (partition by id order by sim desc, seed) as claim from s where slot <= 10) select seed, id, slot from k where claim = 1")
def analog_holdout(spark, d):
    h = E.analog_holdout(near_pairs(spark, d), _values(spark, d), "vec_id", "label", 20, 10)
    return h.select("seed", "id", F.col("slot").cast("long").alias("slot"))


@query("with o as (select o_orderpriority as grp, o_orderkey as id from orders where o_orderkey % 3 <> 0) select grp, id from o qualify row_number() over (partition by grp order by md5(concat(id, ':p')), id) <= round(0.1 * count(*) over (partition by grp))")
def prop_holdout(spark, d):
    o = T(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id")).withColumn("_h", F.md5(F.concat(F.col("id").cast("string"), F.lit(":p"))))
    n = o.groupBy("grp").agg(F.round(0.1 * F.count(F.lit(1))).alias("_n"))
    ranked = R.average_rank(o, ["grp"], "_h", "_r")
    return ranked.join(n, "grp").where("_r <= _n").select("grp", "id")


@query(f"with {_NEAR}, n as (select q, max(sim) as s from sym join embeddings e on e.vec_id = r where q % 20 = 0 and e.label >= 5 group by q) select round(corr(s, label), 5) + 0.0 as c, count(*) as n from n join embeddings on vec_id = q")
def nn_vs_residual(spark, d):
    v = vectors(spark, d)
    n = E.nearest(v.where("id % 20 = 0"), v.where("label >= 5")).join(v.select(F.col("id").alias("q"), "label"), "q")
    return tidy(n.agg(R.safe_corr(F.col("sim"), F.col("label").cast("double")).alias("c"), F.count(F.lit(1)).alias("n")), "", "n", "c", 5)


@query("with u as (select distinct cast(l_partkey as varchar) as unit_id from lineitem), r as (select unnest(range(5)) as repeat_id) select unit_id, cast(repeat_id as integer) as repeat_id, cast(ntile(5) over (partition by repeat_id order by md5(concat(unit_id, ':k', repeat_id)), unit_id) - 1 as integer) as fold from u cross join r")
def kfold(spark, d):
    return S.exact_kfold(X.units(spark, d), "unit_id", 5, 5)


@query(twin("select a.repeat_id as ra, b.repeat_id as rb, round(avg((a.fold = b.fold)::int), 6) + 0.0 as share from f a join f b on a.unit_id = b.unit_id and a.repeat_id < b.repeat_id group by 1, 2", "f"))
def fold_overlap(spark, d):
    return tidy(S.fold_overlap(X.folds(spark, d), "unit_id"), "ra rb", "", "share")


@query(twin("select repeat_id, endpoint, fold, n, round(share, 6) + 0.0 as share, share < 0.15 as low from (select repeat_id, endpoint, fold, count(*) as n, count(*) / sum(count(*)) over (partition by repeat_id, endpoint) as share from f join lm using (unit_id) group by 1, 2, 3)", "f", "lm"))
def fold_balance(spark, d):
    return tidy(S.fold_balance(X.folds(spark, d), X.multi_labels(spark, d), "unit_id"), "repeat_id endpoint fold low", "n", "share")


def _brands(spark, d):
    return T(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("grp"))


@query()
def group_folds_random(spark, d):
    return S.group_folds(_brands(spark, d), "grp", 5, 5, False)


@query()
def group_folds_lpt(spark, d):
    return S.group_folds(_brands(spark, d), "grp", 5, 5, True)


@query(twin(", j as (select f.*, p_brand from f join part on unit_id = cast(p_partkey as varchar)), g as (select repeat_id, p_brand, count(distinct fold) as k from j group by 1, 2) select repeat_id, count(*) as n_groups, count(*) filter (where k > 1) as n_split from g group by 1", "f"))
def group_split_check(spark, d):
    j = X.folds(spark, d).join(T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("unit_id"), "p_brand"), "unit_id")
    return S.split_groups(j, "p_brand")


@query(twin(", c as (select a.fold as x, b.fold as y, count(*) as n from f a join f b on a.unit_id = b.unit_id and a.repeat_id = 0 and b.repeat_id = 1 group by 1, 2), m as (select max(s) as best from (select a.n + b.n + c.n + d.n + e.n as s from c a, c b, c c, c d, c e where a.x = 0 and b.x = 1 and c.x = 2 and d.x = 3 and e.x = 4 and len(list_distinct([a.y, b.y, c.y, d.y, e.y])) = 5)) select round(sum(n) filter (where x = y) / sum(n), 6) + 0.0 as same_share, round((select best from m) / sum(n), 6) + 0.0 as best_share from c", "f"))
def partition_agreement(spark, d):
    f = X.folds(spark, d)
    return tidy(S.partition_agreement(f.where("repeat_id = 0"), f.where("repeat_id = 1"), "unit_id", 5), "", "", "same_share best_share")


_SS = "ss as (select unit_id, repeat_id, case when fold = 0 then 'test' when percent_rank() over (partition by repeat_id, fold = 0 order by md5(concat(unit_id, ':v', repeat_id)), unit_id) < 0.15 then 'val' else 'train' end as split from f)"


@query(twin(f", {_SS} select * from ss", "f"))
def screen_split(spark, d):
    return S.screen_split(X.folds(spark, d), "unit_id", 0, 0.15)


@query("with u as (select distinct cast(l_partkey as varchar) as unit_id from lineitem) select unit_id, case when percent_rank() over (order by md5(concat(unit_id, ':v', 0)), unit_id) < 0.15 then 'val' else 'train' end as split from u")
def final_split(spark, d):
    u = X.units(spark, d).select("unit_id", F.lit(0).alias("repeat_id"), F.lit(1).alias("fold"))
    return S.screen_split(u, "unit_id", 0, 0.15).select("unit_id", "split")


@query(twin(f", {_SS} select repeat_id, split, endpoint, count(*) as n from ss join lm using (unit_id) group by 1, 2, 3", "f", "lm"))
def screen_population(spark, d):
    return S.screen_split(X.folds(spark, d), "unit_id", 0, 0.15).join(X.multi_labels(spark, d), "unit_id").groupBy("repeat_id", "split", "endpoint").agg(F.count(F.lit(1)).alias("n"))


@query(twin(f", {_SS} select unit_id, endpoint, round(y_true, 9) + 0.0 as y_true, case split when 'val' then 'valid' else 'fit' end as role from ss join lm using (unit_id) where repeat_id = 0 and split <> 'test'", "f", "lm"))
def training_table(spark, d):
    s = S.screen_split(X.folds(spark, d).where("repeat_id = 0"), "unit_id", 0, 0.15).where("split <> 'test'")
    role = F.try_element_at(F.create_map(F.lit("val"), F.lit("valid"), F.lit("train"), F.lit("fit")), F.col("split"))
    return tidy(s.join(X.multi_labels(spark, d), "unit_id").withColumn("role", role), "unit_id endpoint role", "", "y_true", 9)


@query(twin("select arm, repeat_id, fold, n_units, ('0x' || substr(md5(concat('seed:', repeat_id, ':', fold)), 1, 7))::bigint as seed from arms cross join (select repeat_id, fold, count(*) as n_units from f group by 1, 2)", "arms", "f"))
def manifest(spark, d):
    return S.manifest(X.arms(spark).select("arm"), X.folds(spark, d))


_FR = ", e as (select unit_id, endpoint, round(avg(abs(y_pred - y_true)), 6) as e, max(conf_high - conf_low) as w0 from oof group by 1, 2), e2 as (select *, round(w0, 6) as width from e), fr as (select *, e > quantile_cont(e, 0.95) over (partition by endpoint) as resid, width >= quantile_cont(width, 0.95) over (partition by endpoint) as wide from e2)"


def _outliers(spark, d):
    e = X.oof(spark, d).groupBy("unit_id", "endpoint").agg(F.round(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))), 6).alias("e"), F.round(F.max(F.col("conf_high") - F.col("conf_low")), 6).alias("width"))
    a = S.outlier_flags(e, ["endpoint"], "e", 0.95, True).withColumnRenamed("flag", "resid")
    return S.outlier_flags(a, ["endpoint"], "width", 0.95, False).withColumnRenamed("flag", "wide")


@query(twin(_FR + " select unit_id, endpoint, e + 0.0 as e from fr where resid", "oof"))
def flag_residual(spark, d):
    return _outliers(spark, d).where("resid").select("unit_id", "endpoint", "e")


@query(twin(_FR + " select unit_id, endpoint, width + 0.0 as width from fr where wide", "oof"))
def flag_width(spark, d):
    return _outliers(spark, d).where("wide").select("unit_id", "endpoint", "width")


@query(twin(_FR + " select endpoint, count(*) filter (where resid) as n_resid, count(*) filter (where wide) as n_wide, count(*) filter (where resid and wide) as n_both, round(count(*) filter (where resid and wide) / least(count(*) filter (where resid), count(*) filter (where wide)), 6) + 0.0 as overlap from fr group by endpoint", "oof"))
def flag_overlap(spark, d):
    g = _outliers(spark, d).groupBy("endpoint").agg(F.count_if("resid").alias("n_resid"), F.count_if("wide").alias("n_wide"), F.count_if(F.col("resid") & F.col("wide")).alias("n_both"))
    return tidy(g.withColumn("overlap", F.try_divide(F.col("n_both"), F.least("n_resid", "n_wide"))), "endpoint", "n_resid n_wide n_both", "overlap")


@query(twin(_FR + f", {_SS} select split, count(*) as n from ss join lm using (unit_id) left join fr using (unit_id, endpoint) where repeat_id = 0 and not (split = 'train' and coalesce(resid, false)) group by split", "oof"))
def train_exclude(spark, d):
    pop = S.screen_split(X.folds(spark, d).where("repeat_id = 0"), "unit_id", 0, 0.15).join(X.multi_labels(spark, d), "unit_id")
    out = _outliers(spark, d).where("resid").select("unit_id", "endpoint", F.lit("train").alias("split"))
    return pop.join(out, ["unit_id", "endpoint", "split"], "left_anti").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(twin(_FR + " select unit_id, endpoint from fr where not resid qualify row_number() over (partition by endpoint order by md5(concat(unit_id, ':m')), unit_id) <= (select count(*) from fr x where x.resid and x.endpoint = fr.endpoint)".replace("(select count(*) from fr x where x.resid and x.endpoint = fr.endpoint)", "any_value(n)").replace("<= any_value(n)", "<= n").replace("from fr where not resid", "from fr join (select endpoint, count(*) as n from fr where resid group by 1) q using (endpoint) where not resid"), "oof"))
def random_mask(spark, d):
    o = _outliers(spark, d).withColumn("_h", F.md5(F.concat("unit_id", F.lit(":m"))))
    n = o.where("resid").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))
    ranked = R.average_rank(o.where("not resid"), ["endpoint"], "_h", "_r")
    return ranked.join(n, "endpoint").where("_r <= n").select("unit_id", "endpoint")


@query(twin("select f.repeat_id, k as fold, endpoint, count(*) as n_train, round(quantile_cont(y_true, 0.05), 6) + 0.0 as lo, round(quantile_cont(y_true, 0.95), 6) + 0.0 as hi from lm join f using (unit_id) cross join (select cast(unnest(range(5)) as integer) as k) where k <> f.fold group by 1, 2, 3", "lm", "f"))
def winsorise_fold(spark, d):
    return tidy(S.winsorise_by_fold(X.multi_labels(spark, d), X.folds(spark, d), "unit_id", "y_true", 0.05, 0.95), "repeat_id fold endpoint", "n_train", "lo hi")


_KDE = """with s as (select c_mktsegment as g, min(c_acctbal) as lo, max(c_acctbal) as hi, stddev_samp(c_acctbal) as sd, count(*) as n from customer group by 1), p as (select *, sd * pow(n, -0.2e0) as bw, greatest((hi - lo) / 256, 1e-12) as step from s),
j as (select c_custkey, g, cast(least(floor((c_acctbal - lo) / step), 255) as integer) as cell, step, bw, n from customer join p on g = c_mktsegment), q as (select g, cell, count(*) as c, any_value(step) as step, any_value(bw) as bw, any_value(n) as n from j group by 1, 2),
dn as (select a.g, a.cell, sum(b.c * exp(-0.5 * ((a.cell - b.cell) * a.step / a.bw) ** 2)) / any_value(a.n * a.bw * sqrt(2 * pi())) as density from q a join q b on a.g = b.g group by 1, 2), w as (select c_custkey, g, density, 1 / density as raw from j join dn using (g, cell)), m as (select g, avg(raw) as m from w group by 1)"""


def _kde(spark, d):
    return S.kde_weights(T(spark, d, "customer"), "c_custkey", ["c_mktsegment"], "c_acctbal")


@query(_KDE + " select c_custkey, round(density * 1000, 6) + 0.0 as density, round(least(raw / m, 5.0), 6) + 0.0 as weight from w join m using (g)")
def kde_weights(spark, d):
    return tidy(_kde(spark, d).withColumn("density", F.col("density") * 1000), "c_custkey", "", "density weight")


@query(_KDE + " select g as c_mktsegment, count(*) as n, round(avg(x), 6) + 0.0 as mean, round(median(x), 6) + 0.0 as middle, round(min(x), 6) + 0.0 as low, round(max(x), 6) + 0.0 as high from (select g, least(raw / m, 5.0) as x from w join m using (g)) group by g")
def weight_summary(spark, d):
    g = _kde(spark, d).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean"), F.median("weight").alias("middle"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    return tidy(g, "c_mktsegment", "n", "mean middle low high")


@query(twin("select arm, endpoint, count(*) as n, round(avg(greatest(least(y_pred, conf_high), conf_low)), 6) + 0.0 as target, round(avg((y_pred < conf_low or y_pred > conf_high)::int), 6) + 0.0 as changed from p group by 1, 2", "p"))
def deadzone_target(spark, d):
    t = S.dead_zone(X.predictions(spark, d))
    g = t.groupBy("arm", "endpoint").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("target"), F.avg((F.col("target") != F.col("y_pred")).cast("double")).alias("changed"))
    return tidy(g, "arm endpoint", "n", "target changed")
