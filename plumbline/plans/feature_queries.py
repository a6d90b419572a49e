"""Features, baselines and streams (sections K and M)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import features as K
from plumbline.operators import gram as G
from plumbline.plans.book import query, r, tidy
from plumbline.plans.metric_queries import corr_sql, rank_sql
from plumbline.sources import fixtures as X
from plumbline.sources.fixtures import twin
from plumbline.streaming import metrics as S

T = X.table
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _block(spark, d):
    g = T(spark, d, "lineitem").groupBy("l_partkey").agg(*[F.avg(c).alias(c) for c in COLS])
    return g.join(T(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice").hint("merge"), "l_partkey")  # part grows with the table, so it isn't sent through the driver


_B = "b as (select l_partkey, " + ", ".join(f"avg({c}) as {c}" for c in COLS) + ", any_value(p_size)::double as p_size, any_value(p_retailprice) as p_retailprice from lineitem join part on l_partkey = p_partkey group by l_partkey)"
ALL = [*COLS, "p_size", "p_retailprice"]


@query(f"with {_B} select l_partkey, " + r("l_discount l_tax p_size p_retailprice", digits=5) + " from b")
def feature_block(spark, d):
    b = _block(spark, d)
    f = K.assemble_block(b.select("l_partkey"), [b.select("l_partkey", "l_discount", "l_tax"), b.select("l_partkey", "p_size", "p_retailprice")], "l_partkey")
    return tidy(f, "l_partkey", "", "l_discount l_tax p_size p_retailprice", 5)


@query("select l_returnflag, feature, constant from (select l_returnflag, unnest(['l_quantity', 'l_tax', 'zero']) as feature, unnest([min(l_quantity) = max(l_quantity), min(l_tax) = max(l_tax), true]) as constant from lineitem group by 1)")
def constant_cols(spark, d):
    return K.constant_columns(T(spark, d, "lineitem").withColumn("zero", F.lit(0.0)), ["l_quantity", "l_tax", "zero"], ["l_returnflag"])


_RKB = ", k as (select " + ", ".join(f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0e0) as {c}" for c in ALL) + " from b)"


@query(f"with {_B}{_RKB} select feature, round(c, 5) + 0.0 as rho, abs(c) >= 0.3 as confounded from (select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as feature, unnest([corr(l_quantity, p_size), corr(l_extendedprice, p_size), corr(l_discount, p_size), corr(l_tax, p_size)]) as c from k)")
def size_confound(spark, d):
    c = K.correlations(_block(spark, d), "l_partkey", [*COLS[:4], "p_size"]).where("b = 'p_size'")
    return tidy(c.select(F.col("a").alias("feature"), "rho", (F.abs("rho") >= 0.3).alias("confounded")), "feature confounded", "", "rho", 5)


@query(f"with {_B}, b2 as (select *, l_quantity * 2 as twice, p_size + p_retailprice as mixed from b), k as (select corr(l_quantity, twice) as c from b2) select unnest(['l_quantity', 'l_discount']) as feature, (select abs(c) >= 0.95 from k) as twice_goes")
def collinear(spark, d):
    b = _block(spark, d).withColumn("twice", F.col("l_quantity") * 2)
    cols = ["l_quantity", "l_discount", "twice"]
    kept = K.drop_collinear(K.correlations(b, "l_partkey", cols), cols, 0.95)
    return spark.createDataFrame([(c, "twice" not in kept) for c in kept], "feature string, twice_goes boolean")


@query("select p_partkey, round(rk / n, 6) + 0.0 as rank_share, round((rk - m) / s, 6) + 0.0 as z from (select *, avg(rk) over (partition by p_brand) as m, stddev_pop(rk) over (partition by p_brand) as s, count(*) over (partition by p_brand) as n from (select p_partkey, p_brand, " + rank_sql("p_size", "p_brand") + " as rk from part))")
def rank_z(spark, d):
    return tidy(K.rank_z(T(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size"), "p_partkey", "", "rank_share z")


@query(f"with {_B}{_RKB} select arg_max(f, abs(c)) as feature, round(max(abs(c)), 5) + 0.0 as rho from (select unnest(['l_discount', 'l_linenumber', 'l_quantity', 'l_tax']) as f, unnest([corr(l_discount, l_extendedprice), corr(l_linenumber, l_extendedprice), corr(l_quantity, l_extendedprice), corr(l_tax, l_extendedprice)]) as c from k)")
def best_single(spark, d):
    c = K.correlations(_block(spark, d), "l_partkey", ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber"]).where("a = 'l_extendedprice'")
    return tidy(c.agg(F.max_by("b", F.abs("rho")).alias("feature"), F.max(F.abs("rho")).alias("rho")), "feature", "", "rho", 5)


_IMP = "select l_partkey, " + ", ".join(f"coalesce({c}, median({c}) over ()) as {c}" for c in ("l_quantity", "l_tax", "l_linenumber")) + " from (select * replace (case when l_partkey % 10 = 0 then null else l_tax end as l_tax) from b)"


@query(f"with {_B}, i as ({_IMP}) select l_partkey, " + ", ".join(f"round(({c} - avg({c}) over ()) / stddev_samp({c}) over (), 5) + 0.0 as {c}" for c in ("l_quantity", "l_tax", "l_linenumber")) + " from i")
def impute_scale(spark, d):
    b = _block(spark, d).withColumn("l_tax", F.when(F.col("l_partkey") % 10 != 0, F.col("l_tax")))
    return tidy(K.impute_scale(b, "l_partkey", ["l_quantity", "l_tax", "l_linenumber"]), "l_partkey", "", "l_quantity l_tax l_linenumber", 5)


@query()
def pca_pipeline(spark, d):
    return K.explained_variance(K.impute_scale(_block(spark, d), "l_partkey", ALL), ALL)


@query(twin("select endpoint, repeat_id, k as fold, round(avg(y_true), 6) + 0.0 as mean, round(median(y_true), 6) + 0.0 as median from lm join f using (unit_id) cross join (select cast(unnest(range(5)) as integer) as k) where k <> fold group by 1, 2, 3", "lm", "f"))
def naive_baseline(spark, d):
    j = X.in_folds(X.multi_labels(spark, d).where("unit_id is not null"))
    return tidy(K.naive_baseline(j, ["endpoint", "repeat_id"], "y_true"), "endpoint repeat_id fold", "", "mean median")


def _folded(spark, d):
    return _block(spark, d).withColumn("fold", (X.draw(F.md5(F.concat(F.col("l_partkey").cast("string"), F.lit(":k")))) % 3).cast("int"))


@query()
def tabular_ridge(spark, d):
    p = K.fold_regressor(_folded(spark, d), ["l_quantity", "l_discount", "p_size", "p_retailprice"], "l_extendedprice", 3, "ridge")
    return p.select("l_partkey", "fold", "l_extendedprice", "prediction")


@query()
def tabular_gbt(spark, d):
    inner = _folded(spark, d).withColumn("inner", F.pmod(F.xxhash64("l_partkey"), F.lit(5)) == 0)  # stops early on these rows of the training side
    p = K.fold_regressor(inner, ["l_quantity", "l_discount", "p_size", "p_retailprice"], "l_extendedprice", 3, "gbt", inner="inner")
    return p.select("l_partkey", "fold", "l_extendedprice", "prediction")


@query()
def tabular_forest(spark, d):
    p = K.fold_regressor(_folded(spark, d), ["l_quantity", "l_discount", "p_size", "p_retailprice"], "l_extendedprice", 3, "forest")
    return p.select("l_partkey", "fold", "l_extendedprice", "prediction")


@query()
def recoverability(spark, d):
    return K.recoverability(_folded(spark, d), ["p_size", "l_partkey"], "p_retailprice", 3)


@query()
def grid_landscape(spark, d):
    return K.grid_landscape(_folded(spark, d), ["l_quantity", "l_discount"], "l_extendedprice", 3, [0.0, 0.1, 1.0])


WIDTH = 1613
_HASHED = f"""with d as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents where text is not null),
c as (select doc_id, cast(('0x' || substr(md5(w), 1, 7)) as bigint) % {WIDTH} as f, count(*)::double as x from d group by all),
n as (select count(distinct doc_id) as n from documents where text is not null),
m as (select f, sum(x) as s, sum(x * x) as ss from c group by f),
p as (select a.f as a, b.f as b, sum(a.x * b.x) as xy from c a join c b on a.doc_id = b.doc_id and a.f < b.f group by 1, 2),
r as (select p.a, p.b, n.n, (xy - u.s * v.s / n) / sqrt((u.ss - u.s * u.s / n) * (v.ss - v.s * v.s / n)) as rho from p join m u on u.f = p.a join m v on v.f = p.b, n)"""


def _hashed(spark, d):
    """A row of WIDTH word counts for each document, by hash."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    bucket = lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % WIDTH).cast("int")
    doc = T(spark, d, "documents").where("text is not null").select("doc_id", F.transform(words, bucket).alias("f"))
    doc = doc.groupBy("doc_id").agg(F.flatten(F.collect_list("f")).alias("f"))

    def count(batches):
        for batch in batches:
            for k in range(0, len(batch), 512):
                b = batch.iloc[k : k + 512]
                yield pd.DataFrame({"doc_id": b["doc_id"], "x": [np.bincount(np.asarray(f, np.int64), minlength=WIDTH).astype(float) for f in b["f"]]})

    return doc.mapInPandas(count, "doc_id long, x array<double>")


@query(_HASHED + " select cast(a as integer) as a, cast(b as integer) as b, n, round(rho, 6) + 0.0 as rho from r where rho >= 0.6")
def gram_pairs(spark, d):
    """Pairs of 1,613 columns at a correlation of 0.6 or more, by blocks of columns."""
    p = G.correlation_pairs(G.gram_blocks(_hashed(spark, d), "x", WIDTH), WIDTH, 0.6).where("rho > 0")
    return tidy(p, "a b", "n", "rho")


@query()
def gram_components(spark, d):
    """How many components of 1,613 columns explain 90, 95 and 99 % of their variance."""
    return G.components(_hashed(spark, d), "x", WIDTH)[1]


_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("select event_type as run, event_id % 50 as epoch, count(*) as n, max(value) as highest, min(value) as lowest from events group by 1, 2")
def stream_epochs(spark, d):
    s = S.file_stream(spark, f"{d}/event[s].parquet", _EVENTS).select(F.col("event_type").alias("run"), (F.col("event_id") % 50).alias("epoch"), "value")
    return S.run_upsert(S.epochs(s, ["run", "epoch"], "value"), ["run", "epoch"])


@query("select event_id, user_id, event_type, value from events")
def stream_upsert(spark, d):
    s = S.file_stream(spark, f"{d}/event[s].parquet", _EVENTS).select("event_id", "user_id", "event_type", "value")
    return S.run_upsert(s, ["event_id"], "append")
