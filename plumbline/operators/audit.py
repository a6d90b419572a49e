"""Scans, sinks, audits and validations of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers and blank strings become NULL, which averages and sums skip."""
    fix = {"double": lambda c: F.when(~F.isnan(c), F.col(c)), "float": lambda c: F.when(~F.isnan(c), F.col(c)), "string": lambda c: F.when(F.trim(c) != "", F.col(c))}
    return df.select(*[fix[t](c).alias(c) if t in fix else F.col(c) for c, t in df.dtypes])


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A typed table from CSV, JSON, ORC or Parquet; blanks and NaN become NULL."""
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}), **options)
    return nan_to_null((reader.schema(schema) if schema else reader).load(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = [], mode: str = "overwrite") -> None:
    writer = df.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def glob_concat(spark: SparkSession, pattern: str, parts: dict[str, str], fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Many files as one table; ``parts`` names columns and the patterns that find their value in the file's name."""
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}))
    df = (reader.schema(schema) if schema else reader).load(pattern)
    name = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(name, p, 1).cast("int").alias(c) for c, p in parts.items()])


def _long(df: DataFrame, cols: list[str], exprs: dict[str, callable]) -> DataFrame:
    """One aggregation pass over all columns, then a row for each."""
    aggs = [f(c).alias(f"{c}__{k}") for c in cols for k, f in exprs.items()]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in exprs]) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, share of nulls, distinct values, lowest, highest, and the mean of numbers."""
    cols = columns or df.columns
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] in ("int", "bigint", "double", "float")
    return _long(df, cols, {
        "n": lambda c: F.count(F.lit(1)),
        "null_share": lambda c: F.avg(F.col(c).isNull().cast("double")),
        "n_distinct": lambda c: F.countDistinct(c),
        "lowest": lambda c: F.min(F.col(c).cast("double")) if numeric(c) else F.lit(None).cast("double"),
        "highest": lambda c: F.max(F.col(c).cast("double")) if numeric(c) else F.lit(None).cast("double"),
        "mean": lambda c: F.avg(F.col(c).cast("double")) if numeric(c) else F.lit(None).cast("double"),
    })


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the share of nulls and whether it is always, never or partly null."""
    r = _long(df, columns, {"null_share": lambda c: F.avg(F.col(c).isNull().cast("double"))})
    return r.withColumn("kind", F.when(F.col("null_share") == 1, "always").when(F.col("null_share") == 0, "never").otherwise("partly"))


def drop_always_null(df: DataFrame) -> DataFrame:
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if filled[c]])


def compare_columns(a: DataFrame, b: DataFrame, key: list[str], value: str, tol: float) -> DataFrame:
    """Shared keys, equal values within ``tol``, the largest difference, and keys of one side only."""
    j = a.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_ib")), key, "full")
    both = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    diff = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(
        F.count_if(both).alias("shared"), F.count_if(both & (diff <= tol)).alias("identical"), F.max(F.when(both, diff)).alias("max_diff"),
        F.count_if(F.col("_ib").isNull()).alias("only_a"), F.count_if(F.col("_ia").isNull()).alias("only_b"))


def cell_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``key, column, a, b`` for every cell in which two tables of one layout differ."""
    cols = [c for c in a.columns if c not in key]
    long = lambda d, out: d.select(*key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(key, cols, "column", out)
    return long(a, "a").join(long(b, "b"), [*key, "column"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


def validated_join(left: DataFrame, right: DataFrame, on: list[str], lossless: bool = True) -> DataFrame:
    """Inner join m:1 that raises an error within the plan where the right side repeats a key or lacks one."""
    r = right.withColumn("_copies", F.lit(1))
    one = r.groupBy(*on).agg(*[F.first(c).alias(c) for c in right.columns if c not in on], F.count(F.lit(1)).alias("_copies"))
    j = left.join(one, on, "left")
    wrong = F.when(F.col("_copies") > 1, F.raise_error(F.lit("the right side repeats a key")).cast("int"))
    lost = F.when(F.col("_copies").isNull(), F.raise_error(F.lit("a row has no match")).cast("int")) if lossless else F.lit(None).cast("int")
    return j.withColumn("_ok", F.coalesce(wrong, lost, F.lit(0))).where("_ok = 0").drop("_ok", "_copies") if lossless else j.where("_copies = 1").drop("_copies")


def alignment(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Counts of keys on both sides, on the left and on the right only."""
    j = a.select(*key).distinct().withColumn("_a", F.lit(1)).join(b.select(*key).distinct().withColumn("_b", F.lit(1)), key, "full")
    side = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return j.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def expect_counts(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """Counts by group beside the expected ones (``keys, expected``), groups of either side alone included."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(expected, keys, "full").withColumn("ok", F.col("n").eqNullSafe(F.col("expected")))


def completeness(pred: DataFrame, expected: DataFrame, by: str, key: list[str], value: str) -> DataFrame:
    """Per ``by``: expected keys without a prediction, predicted keys not expected, repeated keys, null predictions.

    What is missing is the number of expected keys less those found, so no grid of keys and groups is made. A null in a key matches nothing.
    """
    keys = expected.select(*key).distinct()
    got = pred.groupBy(by, *key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(value).isNull()).alias("_null"))
    j = got.join(keys.withColumn("_e", F.lit(1)), key, "left").crossJoin(keys.agg(F.count(F.lit(1)).alias("_of")))
    return j.groupBy(by).agg(
        (F.max("_of") - F.count("_e")).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"),
        F.count_if(F.col("_n") > 1).alias("repeated"), F.coalesce(F.sum("_null"), F.lit(0)).alias("nulls"))


def table_fingerprint(df: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One content hash of a table's rows, whatever their order and partitions: row digests are hashed in fixed buckets."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = df.select(row.alias("h")).withColumn("b", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    per = rows.groupBy("b", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat("h", F.lit(":"), F.col("n"))))), 256).alias("h"), F.sum("n").alias("n"))
    return per.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])), 256).alias("fingerprint"))


def examples(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """``column, examples``: the first ``n`` distinct values of each column as strings, in their order; none where all are null.

    All columns go through one long form: values combine before they are shuffled, and each task hands on ``n`` of a column at most.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    values = long.where("value is not null").distinct()
    first = values.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("_n") <= n)
    found = first.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("examples"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select("column", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def null_rows(df: DataFrame, columns: list[str], bar: float = 0.1) -> DataFrame:
    """``n, mean_rate, max_rate, above``: the share of nulls in a row on average and at most, and how many rows are above ``bar``."""
    rate = sum(F.col(c).isNull().cast("double") for c in columns) / len(columns)
    r = df.select(rate.alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_rate"), F.max("r").alias("max_rate"), F.count_if(F.col("r") > bar).alias("above"))


#: Modulus (a prime) and bases of the two polynomial hashes of a sequence.
MODULUS = 2**31 - 1
BASES = (1_000_003, 998_244_353)


def ordered_fingerprint(df: DataFrame, order: list, columns: list[str], ranges: int | None = None) -> DataFrame:
    """``n, fingerprint``: a hash of the rows' contents in the order given, which tells two orders of the same rows apart.

    The sequence h1, h2, ... of row digests has the polynomial hash sum(h_i base^(n - i)) modulo a prime, for two bases. It is associative: a
    range of the order gives its own hash and length, and two neighbours combine as left * base^(length of right) + right. So rows are
    range-partitioned and sorted once, each task folds its range, and one small row for each range remains; the result is the same for any
    ranges. Rows that tie in the order are put in the order of their digests. Nulls differ from empty strings; an empty table has n = 0.
    """
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    part = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    by = [*[F.col(c) if isinstance(c, str) else c for c in order], F.col("__digest_a"), F.col("__digest_b")]
    rows = df.withColumns({"__digest_a": part(1), "__digest_b": part(8)})
    rows = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    dealt = rows.sortWithinPartitions(*by).select(F.col("__digest_a").alias("_h0"), F.col("__digest_b").alias("_h1"))

    def fold(batches):
        import pandas as pd
        from pyspark import TaskContext

        n, sums = 0, [0, 0]
        for b in batches:
            n += len(b)
            for k, base in enumerate(BASES):
                s = sums[k]
                for h in b[f"_h{k}"].tolist():
                    s = (s * base + h) % MODULUS
                sums[k] = s
        if n:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "n": [n], "h0": [sums[0]], "h1": [sums[1]]})

    n, sums = 0, [0, 0]
    for r in sorted(dealt.mapInPandas(fold, "at int, n long, h0 long, h1 long").collect(), key=lambda r: r["at"]):  # a row for each range
        sums = [(s * pow(base, r["n"], MODULUS) + r[f"h{k}"]) % MODULUS for k, (s, base) in enumerate(zip(sums, BASES))]
        n += r["n"]
    return df.sparkSession.createDataFrame([(n, f"{sums[0]:08x}{sums[1]:08x}")], "n long, fingerprint string")


def last_rows(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the one that is last by ``order``, and among equals by all other columns (nulls first)."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    by = F.struct(*[F.col(c) for c in dict.fromkeys([*(order or []), *others])])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("_last")).select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys; of new rows that repeat a key the last one by ``order``.

    Null keys match each other.
    """
    last = last_rows(new, keys, order)
    match = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    return old.alias("o").join(last.select(*keys).alias("n"), match, "left_anti").unionByName(last)


def provenance_union(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """All sources with their name; a key of several sources stays once, from the first name, with the number of its sources."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("origin", F.lit(k)) for k, d in sources.items()])
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), "origin").alias("_s")
    return rows.groupBy(*keys).agg(best, F.countDistinct("origin").alias("n_origins")).select(*keys, "_s.*", "n_origins")


def coverage_grid(df: DataFrame, arm: str, units: list[str]) -> DataFrame:
    """Per arm how many design units it has, and whether all arms have as many."""
    g = df.groupBy(arm).agg(F.countDistinct(F.struct(*units)).alias("n_units"))
    span = g.agg(F.max("n_units").alias("_hi"))
    return g.crossJoin(span).withColumn("complete", F.col("n_units") == F.col("_hi")).drop("_hi")


def contains_literal(col: Column | str, text: str) -> Column:
    return F.contains(F.col(col) if isinstance(col, str) else col, F.lit(text))


def normalise_text(col: Column | str) -> Column:
    """Dashes, quotes and ligatures to plain ones, white space collapsed."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.translate(c, "‐‑‒–—−‘’“” ", "------''\"\" ")
    for bad, good in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def canonical_key(col: Column | str) -> Column:
    """A key for texts that differ in case and white space only."""
    return F.md5(F.lower(normalise_text(col)))


def canonical_key_by(df: DataFrame, col: str, normaliser, out: str = "key") -> DataFrame:
    """A key from a user's function, called once for each distinct value (vectorised); null where it fails."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return normaliser(v)
            except Exception:  # a value that can't be read has no key, and is reported as such
                return None

        return values.map(one)

    keys = df.select(col).distinct().withColumn(out, run(F.col(col)))
    return df.join(keys, df[col].eqNullSafe(keys[col]), "left").select(df["*"], keys[out])
