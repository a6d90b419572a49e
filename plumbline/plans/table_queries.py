"""Audits, scalars, curation and aggregation of measurements (sections A to D)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import curate as C
from plumbline.operators import ranks as R
from plumbline.plans.book import n, query, r, tidy
from plumbline.plans.metric_queries import AE, _edges, corr_sql, rank_sql
from plumbline.sources import fixtures as X
from plumbline.sources.fixtures import twin
from plumbline.sources.storage import shared_dir

DOSES = {"dose_a": 2.286, "dose_b": 11.43, "dose_c": 57.14}
T = X.table


@query("select c_custkey, c_name, c_nationkey, case when isnan(c_acctbal) then null else c_acctbal end as c_acctbal, case when trim(c_mktsegment) <> '' then c_mktsegment end as c_mktsegment from customer")
def scan_typed(spark, d):
    return A.read_table(spark, f"{d}/customer.parquet", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query(twin("select repeat_id, fold, count(*) as n, count(distinct arm) as arms, round(sum(y_pred), 4) + 0.0 as total from oof group by 1, 2", "oof"))
def glob_parts(spark, d):
    """Predictions in a file for each repeat and fold, which only its name tells."""
    root = f"{shared_dir(spark)}/plumbline/parts-{uuid.uuid4().hex}"
    rows = X.oof(spark, d).withColumn("part", F.concat(F.lit("r"), F.col("repeat_id"), F.lit("_f"), F.col("fold")))
    rows.drop("repeat_id", "fold").repartition("part").write.partitionBy("part").parquet(root)
    g = A.glob_concat(spark, f"{root}/part=*/*.parquet", {"repeat_id": r"part=r(\d+)_f", "fold": r"part=r\d+_f(\d+)"})
    g = g.groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("arm").alias("arms"), F.sum("y_pred").alias("total"))
    return tidy(g, "repeat_id fold", "n arms", "total", 4)


@query("select count(*) as n, cast(sum(l_linenumber) as bigint) as total from lineitem")
def glob_concat(spark, d):
    g = A.glob_concat(spark, f"{d}/lineitem.parquet", {})
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _prof(c: str, numeric: bool) -> str:
    num = f"min({c})::double as lowest, max({c})::double as highest, avg({c}) as mean" if numeric else "null::double as lowest, null::double as highest, null::double as mean"
    return f"select '{c}' as \"column\", count(*) as n, avg(({c} is null)::int) as null_share, count(distinct {c}) as n_distinct, {num} from orders"


@query(f"select \"column\", n, n_distinct, {r('null_share lowest highest', 'mean', digits=4)} from (" + " union all ".join(_prof(c, c not in ("o_orderstatus", "o_orderpriority")) for c in _PROFILED) + ")")
def profile(spark, d):
    return tidy(A.profile(T(spark, d, "orders"), list(_PROFILED)), "column", "n n_distinct", "null_share lowest highest mean", 4)


@query(twin(" union all ".join(f"select '{c}' as \"column\", round(avg(({c} is null)::int), 6) + 0.0 as null_share, case when avg(({c} is null)::int) = 1 then 'always' when avg(({c} is null)::int) = 0 then 'never' else 'partly' end as kind from s" for c in ("value", *DOSES)), "s"))
def null_report(spark, d):
    return tidy(A.null_report(X.readings(spark, d), ["value", *DOSES]), "column kind", "", "null_share")


_SHOWN = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(" union all ".join(f"select '{c}' as \"column\", string_agg(v, '|' order by v) as examples from (select distinct cast({c} as varchar) as v from orders where {c} is not null order by v limit 5)" for c in _SHOWN))
def profile_examples(spark, d):
    return A.examples(T(spark, d, "orders"), list(_SHOWN)).select("column", F.array_join("examples", "|").alias("examples"))


_ROWNULL = "((value is null)::int + (dose_a is null)::int + (dose_b is null)::int + (dose_c is null)::int) / 4.0e0"


@query(twin(f"select count(*) as n, count(*) filter (where {_ROWNULL} > 0.3) as above, round(avg({_ROWNULL}), 6) + 0.0 as mean_rate, round(max({_ROWNULL}), 6) + 0.0 as max_rate from s", "s"))
def null_rows(spark, d):
    return tidy(A.null_rows(X.readings(spark, d), ["value", *DOSES], 0.3), "", "n above", "mean_rate max_rate")


_TWO = """, a as (select unit_id, endpoint, avg(y_true) as v from labs where unit_id not like '%7' group by all), b as (select unit_id, endpoint, avg(y_true) + case when unit_id like '%3' then 0.5 else 0 end as v from labs where unit_id not like '%1' group by unit_id, endpoint)"""


def _two(spark, d):
    g = X.labels(spark, d).groupBy("unit_id", "endpoint").agg(F.avg("y_true").alias("v"))
    return g.where(~F.col("unit_id").like("%7")), g.where(~F.col("unit_id").like("%1")).withColumn("v", F.col("v") + F.when(F.col("unit_id").like("%3"), 0.5).otherwise(0.0))


@query(twin(_TWO + """ select count(*) filter (where a.v is not null and b.v is not null) as shared, count(*) filter (where abs(a.v - b.v) <= 1e-6) as identical, round(max(abs(a.v - b.v)), 6) + 0.0 as max_diff,
count(*) filter (where b.v is null) as only_a, count(*) filter (where a.v is null) as only_b from a full join b using (unit_id, endpoint)""", "labs"))
def compare_columns(spark, d):
    return tidy(A.compare_columns(*_two(spark, d), ["unit_id", "endpoint"], "v", 1e-6), "", "shared identical only_a only_b", "max_diff")


_CELLS = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, "column", a, b from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['l_returnflag', 'l_linestatus']) as "column", unnest([l_returnflag, l_linestatus]) as a, unnest([case when l_orderkey % 50 = 0 then 'X' else l_returnflag end, l_linestatus]) as b from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_returnflag) as l_returnflag, max(l_linestatus) as l_linestatus from lineitem group by 1, 2, 3, 4)) where a is distinct from b"""


@query(_CELLS)
def cell_diff(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = T(spark, d, "lineitem").groupBy(*key).agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    return A.cell_diff(a, a.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 50 == 0, "X").otherwise(F.col("l_returnflag"))), key)


@query("select n_name, count(*) as n, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey group by 1")
def validated_join(spark, d):
    nation = T(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = A.validated_join(T(spark, d, "customer"), nation, ["c_nationkey"])
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select case when b.k is null then 'left_only' when a.k is null then 'right_only' else 'both' end as side, count(*) as n from (select distinct c_custkey as k from customer) a full join (select distinct o_custkey as k from orders where o_orderstatus <> 'F') b on a.k = b.k group by 1")
def alignment(spark, d):
    return A.alignment(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("k")), ["k"])


@query(twin("select endpoint, count(*) as n, 1000::bigint as expected, count(*) = 1000 as ok from lm group by endpoint", "lm"))
def expect_counts(spark, d):
    lm = X.multi_labels(spark, d)
    return A.expect_counts(lm, ["endpoint"], lm.select("endpoint", F.lit(1000).cast("long").alias("expected")).distinct())


@query(twin(""", pr as (select arm, unit_id, endpoint, case when arm = 'tree' and unit_id like '%9' then null else y_pred end as y_pred from oof where repeat_id = 0 and not (arm = 'plain' and unit_id like '%5')),
e as (select distinct unit_id, endpoint from lm where endpoint <> 'N'), g as (select * from e cross join (select distinct arm from pr)), c as (select arm, unit_id, endpoint, count(*) as k, count(*) filter (where y_pred is null) as z from pr group by all)
select arm, count(*) filter (where k is null) as missing, count(*) filter (where e is null) as unexpected, count(*) filter (where k > 1) as repeated, cast(coalesce(sum(z), 0) as bigint) as nulls from (select *, 1 as e from g) q full join c using (arm, unit_id, endpoint) group by arm""", "oof"))
def completeness(spark, d):
    o = X.oof(spark, d).where("repeat_id = 0 and not (arm = 'plain' and unit_id like '%5')")
    o = o.withColumn("y_pred", F.when(~((F.col("arm") == "tree") & F.col("unit_id").like("%9")), F.col("y_pred")))
    return A.completeness(o, X.multi_labels(spark, d).where("endpoint <> 'N'"), "arm", ["unit_id", "endpoint"], "y_pred")


@query(twin(f", t as (select *, round(conf_high - conf_low, 6) as width from labs), k as (select *, {rank_sql('width', 'endpoint')} as ra, {rank_sql('y_true', 'endpoint')} as rb from t) select endpoint, count(*) filter (where conf_high < conf_low) as reversed, round(min(width), 6) + 0.0 as low, round(median(width), 6) + 0.0 as middle, round(max(width), 6) + 0.0 as high, round({corr_sql('ra', 'rb')}, 6) + 0.0 as spearman from k group by endpoint", "labs"))
def interval_sanity(spark, d):
    t = X.labels(spark, d).withColumn("width", F.round(F.col("conf_high") - F.col("conf_low"), 6))
    rk = R.average_ranks(t, ["endpoint"], {"width": "ra", "y_true": "rb"})
    g = rk.groupBy("endpoint").agg(F.count_if(F.col("conf_high") < F.col("conf_low")).alias("reversed"), F.min("width").alias("low"), F.max("width").alias("high"), R.safe_corr("ra", "rb").alias("spearman"))
    return tidy(g.join(R.medians(t, ["endpoint"], "width", "middle"), "endpoint"), "endpoint", "reversed", "low middle high spearman")


def _folded(part: int, base: int) -> str:
    return f"list_reduce(list_prepend(0::bigint, list(cast('0x' || substr(h, {part}, 7) as bigint) order by o_orderdate, substr(h, 1, 14))), lambda s, x: (s * {base} + x) % {A.MODULUS})"


@query(f"select count(*) as n, printf('%08x%08x', {_folded(1, A.BASES[0])}, {_folded(8, A.BASES[1])}) as fingerprint from (select *, md5(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus)) as h from orders)")
def fingerprint_ordered(spark, d):
    """Orders by date: the hash changes with the order of rows."""
    return A.ordered_fingerprint(T(spark, d, "orders"), ["o_orderdate"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@query()
def fingerprint(spark, d):
    t = T(spark, d, "orders")
    return A.table_fingerprint(t, t.columns)


@query("""with new as (select o_orderkey, o_custkey, 'Z' as o_orderstatus from orders where o_orderkey % 10 = 3 union all select -o_orderkey - 1, o_custkey, 'N' from orders where o_orderkey % 100 = 7)
select * from new union all select o_orderkey, o_custkey, o_orderstatus from orders o where not exists (select 1 from new where new.o_orderkey = o.o_orderkey)""")
def upsert(spark, d):
    old = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.where("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("Z"))
    more = old.where("o_orderkey % 100 = 7").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return A.upsert(old, new.union(more), ["o_orderkey"])


@query("""with u as (select c_custkey as k, c_acctbal as v, 'a' as origin from customer where c_custkey % 3 <> 0 union all select c_custkey, c_acctbal + 1, 'b' from customer where c_custkey % 2 = 0)
select k, arg_min(v, origin) as v, min(origin) as origin, count(distinct origin) as n_origins from u group by k""")
def provenance_union(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return A.provenance_union({"a": c.where("k % 3 <> 0"), "b": c.where("k % 2 = 0").withColumn("v", F.col("v") + 1)}, ["k"])


@query(twin(", g as (select arm, count(distinct (repeat_id, fold, unit_id)) as n_units from oof where not (arm = 'tree' and fold = 4) group by arm) select arm, n_units, n_units = max(n_units) over () as complete from g", "oof"))
def coverage_grid(spark, d):
    return A.coverage_grid(X.oof(spark, d).where("not (arm = 'tree' and fold = 4)"), "arm", ["repeat_id", "fold", "unit_id"])


@query(twin(f"select unit_id, endpoint, kind, round(v, 9) + 0.0 as v from (select unit_id, endpoint, unnest(['y_true', 'conf_low', 'conf_high']) as kind, unnest([y_true, conf_low, conf_high]) as v from lm)", "lm"))
def unpivot_labels(spark, d):
    return tidy(X.multi_labels(spark, d).unpivot(["unit_id", "endpoint"], ["y_true", "conf_low", "conf_high"], "kind", "v"), "unit_id endpoint kind", "", "v", 9)


@query(twin("select endpoint, repeat_id, fold, " + ", ".join(f"round(max(mae) filter (where arm = '{a[0]}'), 6) + 0.0 as {a[0]}" for a in X.ARMS) + " from sc group by 1, 2, 3", "sc"))
def pivot_scores(spark, d):
    from plumbline.plans.metric_queries import fold_scores

    names = [a[0] for a in X.ARMS]
    return tidy(fold_scores(spark, d).groupBy("endpoint", "repeat_id", "fold").pivot("arm", names).agg(F.max("mae")), "endpoint repeat_id fold", "", " ".join(names))


@query(twin("select arm, round(avg(e), 6) + 0.0 as macro, count(*) as n, abs(avg(e) - avg(e)) <= 1e-9 as agrees from (select arm, endpoint, avg(st_rae) as e from sc group by 1, 2) group by arm", "sc"))
def macro_reconcile(spark, d):
    from plumbline.plans.metric_queries import fold_scores

    s = fold_scores(spark, d)
    published = s.groupBy("arm", "repeat_id", "fold").agg(F.avg("st_rae").alias("m")).groupBy("arm").agg(F.avg("m").alias("published"))
    own = s.groupBy(*AE).agg(F.avg("st_rae").alias("e")).groupBy("arm").agg(F.avg("e").alias("macro"), F.count(F.lit(1)).alias("n"))
    return tidy(own.join(published, "arm").withColumn("agrees", F.abs(F.col("macro") - F.col("published")) <= 1e-9), "arm agrees", "n", "macro")


@query(twin("select arm, endpoint, count(*) as n, round(max(abs(mae - round(mae, 2))), 6) + 0.0 as worst, max(abs(mae - round(mae, 2))) <= 0.005 as ok from sc group by 1, 2", "sc"))
def regress_check(spark, d):
    from plumbline.plans.metric_queries import fold_scores

    s = fold_scores(spark, d).select("arm", "endpoint", "repeat_id", "fold", "mae")
    stored = s.withColumn("stored", F.round("mae", 2)).drop("mae")
    g = s.join(stored, ["arm", "endpoint", "repeat_id", "fold"]).groupBy(*AE).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("mae") - F.col("stored"))).alias("worst"))
    return tidy(g.withColumn("ok", F.col("worst") <= 0.005), "arm endpoint ok", "n", "worst")


@query("select source, count(*) as n, count(*) filter (where contains(text, '.')) as dots, count(*) filter (where contains(text, '###')) as marks from documents group by source")
def literal_flag(spark, d):
    return T(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(A.contains_literal("text", ".")).alias("dots"), F.count_if(A.contains_literal("text", "###")).alias("marks"))


@query("""with b as (select unnest(['1', '2', '3', 'other']) as bucket), x as (select case when l_linenumber in (1, 2, 3) then cast(l_linenumber as varchar) else 'other' end as bucket, l_quantity as q from lineitem)
select bucket, count(q) as n, round(avg(q), 6) + 0.0 as mean, round(median(q), 6) + 0.0 as middle from b left join x using (bucket) group by bucket""")
def bucket_stats(spark, d):
    b = spark.sql("select explode(array('1', '2', '3', 'other')) as bucket")
    x = T(spark, d, "lineitem").select(F.when(F.col("l_linenumber").isin(1, 2, 3), F.col("l_linenumber").cast("string")).otherwise("other").alias("bucket"), "l_quantity")
    g = x.groupBy("bucket").agg(F.count("l_quantity").alias("n"), F.avg("l_quantity").alias("mean"), F.median("l_quantity").alias("middle"))
    return tidy(b.join(g, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0))), "bucket", "n", "mean middle")


@query("""select l_returnflag, round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) + 0.0 as unit_price, round(avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) + 0.0 as charge, round(max(l_extendedprice) - min(l_extendedprice), 6) + 0.0 as span, round(avg((p_retailprice + p_size) / 2), 6) + 0.0 as mixed from lineitem join part on l_partkey = p_partkey group by 1""")
def derived_columns(spark, d):
    j = T(spark, d, "lineitem").join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("l_returnflag").agg(F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("unit_price"), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"), (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("span"), F.avg((F.col("p_retailprice") + F.col("p_size")) / 2).alias("mixed"))
    return tidy(g, "l_returnflag", "", "unit_price charge span mixed")


_NORM = "trim(regexp_replace(replace(replace(replace(translate({0}, '‐‑‒–—−‘’“” ', '------''''\"\" '), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"select doc_id, md5({_NORM.format('text')}) as digest, length({_NORM.format('text')}) as n_chars from documents")
def text_norm(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5(A.normalise_text("text")).alias("digest"), F.length(A.normalise_text("text")).cast("long").alias("n_chars"))


@query("select l_orderkey, " + ", ".join(f"round(min(l_quantity) filter (where l_returnflag = '{f}'), 6) + 0.0 as {f}_min, round(max(l_quantity) filter (where l_returnflag = '{f}'), 6) + 0.0 as {f}_max, round(avg(l_quantity) filter (where l_returnflag = '{f}'), 6) + 0.0 as {f}_mean" for f in "ANR") + " from lineitem group by l_orderkey")
def category_stats(spark, d):
    return tidy(C.conditioned(T(spark, d, "lineitem"), "l_orderkey", "l_returnflag", list("ANR"), "l_quantity"), "l_orderkey", "", " ".join(f"{f}_{k}" for f in "ANR" for k in ("min", "max", "mean")))


@query("select source, count(*) as n, count(*) filter (where nullif(regexp_extract(text, 'token = \"([0-9a-f]+)\"', 1), '') is null) as failures from documents group by 1")
def parse_failures(spark, d):
    key = F.nullif(F.regexp_extract("text", 'token = "([0-9a-f]+)"', 1), F.lit(""))
    return T(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(key.isNull()).alias("failures"))


_KEYED = f"(select doc_id, md5(lower({_NORM.format('text')})) as key from documents)"


@query(f"select doc_id, key from {_KEYED}")
def canonical_key(spark, d):
    return T(spark, d, "documents").select("doc_id", A.canonical_key("text").alias("key"))


@query(f"select key, count(distinct doc_id) as n_ids, min(doc_id) as first_id from {_KEYED} group by key having count(distinct doc_id) > 1")
def dup_keys(spark, d):
    return C.duplicate_keys(canonical_key(spark, d), "key", "doc_id")


@query("with s as (select distinct unnest(string_split(text, chr(10))) as line from documents), b as (select distinct unnest(string_split(text, chr(10))) as line from benchmark) select line from b where line in (select line from s)")
def leakage(spark, d):
    lines = lambda t: T(spark, d, t).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return C.leakage(lines("documents"), lines("benchmark"), "line")


@query("""with s as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), q as (select distinct o_custkey as k from orders where o_totalprice > 300000), c as (select c_custkey as k from customer)
select case when s.k is not null then 'scored' when q.k is not null then 'known' else 'new' end as part, count(*) as n from c left join s using (k) left join q on c.k = q.k group by 1""")
def overlap_partition(spark, d):
    o = T(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    p = C.overlap_partition(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 300000"), ["k"])
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'A'), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'N' and l_linenumber = 1), c as (select distinct l_partkey as k from lineitem where l_quantity > 45 and l_linenumber = 2)
select (select count(*) from a where k not in (select k from b)) as a_not_b, (select count(*) from b where k not in (select k from a)) as b_not_a, (select count(*) from a where k not in (select k from b) and k not in (select k from c)) as a_alone""")
def key_setops(spark, d):
    li = T(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return C.key_set_counts(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N' and l_linenumber = 1"), li.where("l_quantity > 45 and l_linenumber = 2"), "k")


@query(twin(", o as (select distinct unit_id, endpoint from lm where unit_id like '%4') select endpoint, count(*) as n, count(*) filter (where o.unit_id is not null) as excluded, count(*) filter (where o.unit_id is not null) > 0.05 * count(*) as flagged from lm left join o using (unit_id, endpoint) group by endpoint", "lm"))
def overlap_exclude(spark, d):
    lm = X.multi_labels(spark, d).select("unit_id", "endpoint")
    left = C.exclude_overlap(lm, lm.where("unit_id like '%4'"), ["unit_id", "endpoint"]).groupBy("endpoint").agg(F.count(F.lit(1)).alias("stay"))
    g = lm.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n")).join(left, "endpoint", "left")
    gone = F.col("n") - F.coalesce("stay", F.lit(0))
    return g.select("endpoint", "n", gone.alias("excluded"), (gone > 0.05 * F.col("n")).alias("flagged"))


@query("select kind, count(*) as n from (select case event_type when 'click' then 'act' when 'purchase' then 'act' when 'view' then 'look' end as kind from events) where kind is not null group by 1")
def category_map(spark, d):
    m = C.map_category(T(spark, d, "events"), "event_type", {"click": "act", "purchase": "act", "view": "look"}, "kind")
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(twin(""", own as (select unit_id, endpoint from lm where unit_id not like '%2'), ex as (select unit_id, endpoint from lm where unit_id like '%2' or unit_id like '%3'), sp as (select unit_id, case when fold = 0 then 'test' when fold = 1 then 'val' else 'train' end as split from f where repeat_id = 0)
select is_extra, split, count(*) as n from (select false as is_extra, coalesce(split, 'train') as split from own left join sp using (unit_id) union all select true, 'train' from ex where not exists (select 1 from own where own.unit_id = ex.unit_id)) group by all""", "lm", "f"))
def augment_population(spark, d):
    lm = X.multi_labels(spark, d).select("unit_id", "endpoint")
    sp = X.folds(spark, d).where("repeat_id = 0").select("unit_id", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train").alias("split"))
    a = C.augment(lm.where("unit_id not like '%2'"), lm.where("unit_id like '%2' or unit_id like '%3'"), sp, ["unit_id"])
    return a.groupBy("is_extra", "split").agg(F.count(F.lit(1)).alias("n"))


@query(twin("select unit_id, " + ", ".join(f"round(max(y_true) filter (where endpoint = '{e}'), 9) + 0.0 as {e}" for e in "ANR") + ", count(*) as n_labels from lm group by unit_id", "lm"))
def label_matrix(spark, d):
    m = C.label_matrix(X.multi_labels(spark, d), "unit_id", "endpoint", "y_true", list("ANR"))
    return tidy(m.withColumn("n_labels", sum(F.col(e).isNotNull().cast("int") for e in "ANR")), "unit_id", "n_labels", "A N R", 9)


@query(twin("select endpoint, count(*) as n, round(count(*) / (select count(*) from f where repeat_id = 0), 6) + 0.0 as share, round(count(*) / (select count(*) from part), 6) + 0.0 as against_test from lm group by endpoint", "lm", "f"))
def data_inventory(spark, d):
    g = X.multi_labels(spark, d).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))
    sizes = X.units(spark, d).agg(F.count(F.lit(1)).alias("u")).crossJoin(T(spark, d, "part").agg(F.count(F.lit(1)).alias("t")))
    return tidy(g.crossJoin(sizes).select("endpoint", "n", (F.col("n") / F.col("u")).alias("share"), (F.col("n") / F.col("t")).alias("against_test")), "endpoint", "n", "share against_test")


@query(twin("select repeat_id, unit_id, endpoint, " + ", ".join(f"round(max(y_pred) filter (where arm = '{a[0]}'), 6) + 0.0 as {a[0]}" for a in X.ARMS) + " from oof group by all", "oof"))
def assemble_columns(spark, d):
    names = [a[0] for a in X.ARMS]
    return tidy(X.oof(spark, d).groupBy("repeat_id", "unit_id", "endpoint").pivot("arm", names).agg(F.max("y_pred")), "repeat_id unit_id endpoint", "", " ".join(names))


@query(twin("select repeat_id, unit_id, endpoint, arm, round(y_pred, 6) + 0.0 as y_pred from oof where ((endpoint = 'A' and arm = 'plain') or (endpoint = 'N' and arm = 'deadzone') or (endpoint = 'R' and arm = 'tree'))", "oof"))
def recombine(spark, d):
    choice = spark.sql("select * from values ('A', 'plain'), ('N', 'deadzone'), ('R', 'tree') as t(endpoint, arm)")
    return tidy(C.recombine(X.oof(spark, d), choice, ["repeat_id", "unit_id"]), "repeat_id unit_id endpoint arm", "", "y_pred")


_TOP = "greatest(case when dose_a is not null then 2.286e0 end, case when dose_b is not null then 11.43e0 end, case when dose_c is not null then 57.14e0 end)"


def _floors(spark, d):
    return X.readings(spark, d).withColumn("floor", C.censor_floor(DOSES))


@query(twin(f"select event_id, round({_TOP}, 6) + 0.0 as top, round(-log10({_TOP}), 6) + 0.0 as floor from s", "s"))
def censor_floor(spark, d):
    return tidy(X.readings(spark, d).withColumn("top", C.top_level(DOSES)).withColumn("floor", C.censor_floor(DOSES)), "event_id", "", "top floor")


@query(twin("select unit_id, endpoint, round(avg(value), 6) + 0.0 as mean, count(value) as n, bool_or(censored) as any_censored, round(arg_min(value, event_id), 6) + 0.0 as first from s group by all", "s"))
def replicate_mean(spark, d):
    return tidy(C.replicate_mean(X.readings(spark, d), ["unit_id", "endpoint"], "value", "censored", "event_id"), "unit_id endpoint any_censored", "n", "mean first")


_REC = f", z as (select *, -log10({_TOP}) as floor from s) select unit_id, endpoint, coalesce(avg(value) filter (where not censored), min(floor) filter (where censored)) as value, count(*) filter (where not censored) = 0 as is_censored from z group by all"


@query(twin(_REC.replace("coalesce(avg(value) filter (where not censored), min(floor) filter (where censored)) as value", "round(coalesce(avg(value) filter (where not censored), min(floor) filter (where censored)), 6) + 0.0 as value"), "s"))
def reconcile_censored(spark, d):
    return tidy(C.reconcile_censored(_floors(spark, d), ["unit_id", "endpoint"], "value", "censored", "floor"), "unit_id endpoint is_censored", "", "value")


@query(twin(f", z as (select *, -log10({_TOP}) as floor from s) select endpoint, count(*) filter (where not censored) as exact, count(*) filter (where censored) as censored, round(min(floor) filter (where censored), 6) + 0.0 as low, round(max(floor) filter (where censored), 6) + 0.0 as high from z group by endpoint", "s"))
def censor_counts(spark, d):
    c = F.when(F.col("censored"), F.col("floor"))
    g = _floors(spark, d).groupBy("endpoint").agg(F.count_if(~F.col("censored")).alias("exact"), F.count_if("censored").alias("censored"), F.min(c).alias("low"), F.max(c).alias("high"))
    return tidy(g, "endpoint", "exact censored", "low high")


@query(twin("select unit_id, round(avg(value) filter (where endpoint = 'click'), 6) + 0.0 as first, round(-avg(value) filter (where endpoint = 'view'), 6) + 0.0 as second, count(*) filter (where endpoint = 'view') as n from s group by unit_id having count(*) filter (where endpoint in ('click', 'view')) > 0", "s"))
def second_readout(spark, d):
    s = X.readings(spark, d).where("endpoint in ('click', 'view')")
    v = lambda e: F.when(F.col("endpoint") == e, F.col("value"))
    g = s.groupBy("unit_id").agg(F.avg(v("click")).alias("first"), (-F.avg(v("view"))).alias("second"), F.count(v("view")).alias("n"))
    return tidy(g, "unit_id", "n", "first second")


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("select user_id, " + ", ".join(f"round(avg(value) filter (where event_type = '{k}'), 6) + 0.0 as {k}" for k in _KINDS) + " from events group by user_id")
def screen_pivot(spark, d):
    return tidy(T(spark, d, "events").groupBy("user_id").pivot("event_type", list(_KINDS)).agg(F.avg("value")), "user_id", "", " ".join(_KINDS))


@query("with u as (select user_id, event_type, bool_or(value > 40) as hit from events group by all), a as (select user_id, bool_or(hit) as hit, count(*) filter (where hit) as k from u group by 1) select k as categories_hit, count(*) as n_users, cast(sum(hit::int) as bigint) as hits from a group by 1")
def hit_calling(spark, d):
    u = T(spark, d, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 40).alias("hit"))
    a = u.groupBy("user_id").agg(F.bool_or("hit").alias("hit"), F.count_if("hit").alias("categories_hit"))
    return a.groupBy("categories_hit").agg(F.count(F.lit(1)).alias("n_users"), F.count_if("hit").alias("hits"))


_DL = "(select n_chars::double as v, quality as y, source from documents join labels using (doc_id))"


def _dl(spark, d):
    return T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("v"), F.col("quality").alias("y"), "source")


@query(f"select count(*) as n, cast(sum(y) as bigint) as positives, round((sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 as auc from (select y, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0e0 as r from {_DL})")
def promotion_auc(spark, d):
    return tidy(C.auc(_dl(spark, d), [], "v", "y"), "", "n positives", "auc")


@query(f"with g as (select unnest(range(0, 5001, 250))::double as t), a as (select t, avg(((v >= t) = (y = 1))::int) as acc from {_DL} cross join g group by t) select (select count(*) from {_DL}) as n, (select round(avg(y), 6) + 0.0 from {_DL}) as base_rate, round(acc, 6) + 0.0 as accuracy, t as threshold from a order by acc desc, t desc limit 1")
def best_threshold(spark, d):
    return tidy(C.best_threshold(_dl(spark, d), "v", "y", [float(t) for t in range(0, 5001, 250)]), "", "n", "base_rate accuracy threshold")


@query(f"select cast(bin as bigint) as bin, count(*) as n, min(v) as low, max(v) as high, round(avg(y), 6) + 0.0 as rate from {_edges('v', '(select v, y, 1 as one from ' + _DL + ')', 'one', 10)} group by bin")
def rate_by_decile(spark, d):
    b = R.quantile_bin(_dl(spark, d), [], "v", 10)
    return tidy(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("y").alias("rate")), "", "bin n", "low high rate")


@query(f"select significant, count(*) as n, round(avg(y), 6) + 0.0 as rate, round(avg(v), 6) + 0.0 as mean from (select *, v >= 2000 as significant from {_DL}) group by 1")
def rate_by_sig(spark, d):
    return tidy(_dl(spark, d).groupBy((F.col("v") >= 2000).alias("significant")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg("v").alias("mean")), "significant", "n", "rate mean")


@query(twin("select unit_id, round(coalesce(a, case when n > 6 then 4.0 end), 9) + 0.0 as label, a is null and n > 6 as bounded from (select unit_id, max(y_true) filter (where endpoint = 'A') as a, max(y_true) filter (where endpoint = 'N') as n from lm group by unit_id)", "lm"))
def interval_label(spark, d):
    v = lambda e: F.max(F.when(F.col("endpoint") == e, F.col("y_true")))
    g = X.multi_labels(spark, d).groupBy("unit_id").agg(v("A").alias("a"), v("N").alias("n"))
    can = F.coalesce(F.col("n") > 6, F.lit(False))
    return tidy(g.select("unit_id", F.coalesce("a", F.when(can, 4.0)).alias("label"), (F.col("a").isNull() & can).alias("bounded")), "unit_id bounded", "", "label", 9)


@query(twin("select endpoint, count(*) as n, round(avg(y_true), 6) + 0.0 as mean, round(stddev_pop(y_true), 6) + 0.0 as sd_pop, round(stddev_samp(y_true), 6) + 0.0 as sd, round(avg(y_true) - (select avg(y_true) from lm), 6) + 0.0 as gap from lm group by endpoint", "lm"))
def pop_moments(spark, d):
    lm = X.multi_labels(spark, d)
    g = C.moments(lm, ["endpoint"], "y_true").crossJoin(lm.agg(F.avg("y_true").alias("own")))
    return tidy(g.withColumn("gap", F.col("mean") - F.col("own")), "endpoint", "n", "mean sd_pop sd gap")


@query()
def censored_mle(spark, d):
    s = X.readings(spark, d).withColumn("floor", F.lit(0.5))
    return C.censored_normal(s, ["endpoint"], "value", "censored", "floor")


_CH = ("l_quantity", "l_discount")


@query("select o_orderkey, coalesce(n_children, 0) as n_children, " + ", ".join(r(f"{c}_{k}") for c in _CH for k in ("min", "max", "range", "std", "mean_abs")) + " from orders left join (select l_orderkey, count(*) as n_children, " + ", ".join(f"min({c}) as {c}_min, max({c}) as {c}_max, max({c}) - min({c}) as {c}_range, stddev_pop({c}) as {c}_std, avg(abs({c})) as {c}_mean_abs" for c in _CH) + " from lineitem group by 1) on l_orderkey = o_orderkey")
def child_aggs(spark, d):
    a = C.child_aggregates(T(spark, d, "lineitem"), "l_orderkey", list(_CH))
    j = T(spark, d, "orders").select("o_orderkey").join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return tidy(j, "o_orderkey", "n_children", " ".join(f"{c}_{k}" for c in _CH for k in ("min", "max", "range", "std", "mean_abs")))


@query("select l_suppkey, " + ", ".join(f"round({a}(l_extendedprice) filter (where l_linestatus = '{f}'), 4) + 0.0 as {f}_{k}" for f in "FO" for k, a in (("min", "min"), ("max", "max"), ("mean", "avg"))) + " from lineitem group by 1")
def child_cond_aggs(spark, d):
    return tidy(C.conditioned(T(spark, d, "lineitem"), "l_suppkey", "l_linestatus", ["F", "O"], "l_extendedprice"), "l_suppkey", "", "F_min F_max F_mean O_min O_max O_mean", 4)


@query("select concat_ws('-', least(l_returnflag, l_linestatus), greatest(l_returnflag, l_linestatus)) as pair, count(*) as n, round(avg(l_quantity), 6) + 0.0 as mean from lineitem where l_discount > 0.02 group by 1")
def pair_cond_means(spark, d):
    return tidy(C.pair_means(T(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", F.col("l_discount") > 0.02), "pair", "n", "mean")


@query("select l_orderkey, count(*) filter (where l_quantity > 25) as large, count(*) filter (where l_discount > 0.05) as cheap, count(*) filter (where l_tax > 0.04) as taxed from lineitem group by 1")
def child_counts(spark, d):
    return T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("large"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"), F.count_if(F.col("l_tax") > 0.04).alias("taxed"))


_AX = ("l_discount", "l_tax", "l_linenumber")


@query("""with g as (select l_orderkey, count(*) as n_children, sum(l_quantity) as w, sum(l_quantity * l_discount) as a, sum(l_quantity * l_tax) as b, sum(l_quantity * l_linenumber) as c, sum(l_quantity * l_discount ** 2) as aa, sum(l_quantity * l_tax ** 2) as bb, sum(l_quantity * l_linenumber ** 2) as cc from lineitem group by 1)
select l_orderkey, n_children, round(sqrt(round(greatest((aa + bb + cc - (a * a + b * b + c * c) / w) / w, 0), 9)), 5) + 0.0 as gyration, round(2 * (aa + bb + cc - (a * a + b * b + c * c) / w), 8) + 0.0 as trace from g""")
def moment_tensor(spark, d):
    m = C.moment_tensor(T(spark, d, "lineitem"), "l_orderkey", "l_quantity", _AX)
    return m.select("l_orderkey", "n_children", F.round(F.sqrt(F.round(F.col("gyration") ** 2, 9)), 5).alias("gyration"), F.round("trace", 8).alias("trace"))


@query()
def moment_eigenvalues(spark, d):
    return tidy(C.moment_tensor(T(spark, d, "lineitem"), "l_orderkey", "l_quantity", _AX), "l_orderkey", "", "trace low middle high")
