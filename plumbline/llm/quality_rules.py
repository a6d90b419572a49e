"""Quality rules for documents, and verdicts on their hosts from shrunken failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, boxed, let, table
from plumbline.sources.storage import materialise

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host goes if the shrunken rate of one of its rules is above this.
MAX_HOST_RATE = 0.5
#: Pseudo-documents of the prior, at least and at most.
PRIOR_WEIGHT = (1.0, 1000.0)
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window found twice or more; windows are compared by 64-bit hashes within one text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: F.get(s, i - 1)["h"].eqNullSafe(e["h"]) | F.get(s, i + 1)["h"].eqNullSafe(e["h"]))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["sum"] + p + WINDOW - F.greatest(p, a["end"])).alias("sum"))
        return F.aggregate(let(pairs, positions), start, step, lambda a: a["sum"])

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(windows, count))


def text_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    whole = F.coalesce(text, F.lit(""))

    def measures(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
        counted = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            counted.alias("lines"),
        )

    return let(F.array_remove(F.split(whole, f"[{SPACE}]+", -1), ""), measures)


def _with_rules(measured: DataFrame) -> DataFrame:
    """``measured`` with ``q`` in place of ``m``: the measures of a text, a boolean for each rule, and ``base_failed``.

    Null texts have no word; empty texts likewise. Nothing is sampled or cut.
    """
    few = F.col("m.n_words") < MIN_WORDS
    repeats = F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * MAX_REPEAT_PERCENT
    q = F.struct(
        *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")],
        F.col("m.lines.dup").cast("long").alias("n_dup_lines"),
        few.alias("few_words"),
        repeats.alias("repeats"),
        (F.col("m.n_symbols") * 100 > F.col("m.word_chars") * MAX_SYMBOL_PERCENT).alias("symbols"),
        (F.col("m.lines.dup") * 100 > F.col("m.lines.n") * MAX_DUP_LINE_PERCENT).alias("dup_lines"),
        (few | repeats).alias("base_failed"),
    )
    return measured.withColumn("q", q).drop("m")


def host_verdicts(measured: DataFrame) -> DataFrame:
    """``host, n_docs, rate_<rule>..., host_ok`` from rows of ``host`` and its documents' measures ``q``.

    For each rule the hosts' failure rates are shrunk to the overall rate with a beta prior, whose weight
    comes from the rates' spread by the method of moments. One row for each host reaches the last step; the
    counts combine before any shuffle, so a host with a third of all documents is no hot spot. Documents
    without a host form one host (null).
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(f"q.{r}")).alias(f"k_{r}") for r in RULES]
    )
    hosts = materialise(hosts, "hosts")
    means = hosts.agg(*[(F.sum(f"k_{r}") / F.sum("n_docs")).alias(f"m_{r}") for r in RULES])
    spread = hosts.crossJoin(means).agg(
        *[F.max(f"m_{r}").alias(f"m_{r}") for r in RULES],
        *[(F.sum(F.col("n_docs") * F.pow(F.col(f"k_{r}") / F.col("n_docs") - F.col(f"m_{r}"), 2)) / F.sum("n_docs")).alias(f"v_{r}") for r in RULES],
    )
    low, high = map(F.lit, PRIOR_WEIGHT)
    weight = lambda r: F.greatest(low, F.least(high, F.coalesce(F.try_divide(F.col(f"m_{r}") * (1 - F.col(f"m_{r}")), F.col(f"v_{r}")) - 1, high)))
    prior = spread.select(*[f"m_{r}" for r in RULES], *[weight(r).alias(f"w_{r}") for r in RULES])
    rates = hosts.crossJoin(prior).select(
        "host", "n_docs", *[((F.col(f"k_{r}") + F.col(f"m_{r}") * F.col(f"w_{r}")) / (F.col("n_docs") + F.col(f"w_{r}"))).alias(f"rate_{r}") for r in RULES]
    )
    return rates.withColumn("host_ok", F.greatest(*[f"rate_{r}" for r in RULES]) <= MAX_HOST_RATE)


def _judged(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``measured`` with ``kept``; only the hosts that fail are joined, so documents of hosts in good standing match no row."""
    failing = verdicts.where(~F.col("host_ok")).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    joined = measured.join(failing, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    return joined.withColumn("kept", ~F.col("q.base_failed") & F.col("bad").isNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: its id, measures, ``base_failed`` and ``kept``.

    A document stays if it passes the base rules (enough words, few repeated windows) and no rule fails on
    too much of its host. Null ids and repeated rows pass through; null and empty texts have no word and fail; columns of
    other names are left aside; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text_metrics(F.col(text_col)).alias("m"))
    measured = materialise(_with_rules(slim), "quality")
    return _judged(measured, host_verdicts(measured)).select("id", "q.*", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns, whatever their names.

    The texts are measured twice (for the hosts, then to filter), which costs less than shuffling them by id. Null and
    empty texts go, repeated rows all stay or all go, and an empty table gives an empty result.
    """
    host, m = F.col(host_col), text_metrics(F.col(text_col))
    verdicts = materialise(host_verdicts(_with_rules(docs.select(host.alias("host"), m.alias("m")))), "host-verdicts")
    return _judged(_with_rules(boxed(docs, host=host, m=m)), verdicts).where("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP9_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (
  select doc_id, i, words[i:i + 4] as w from d, lateral (select unnest(range(1, len(words) - 3)) as i) t),
twice as (
  select doc_id, w from win group by doc_id, w having count(*) > 1),
covered as (
  select doc_id, count(distinct p) as n
  from (select win.doc_id, unnest(range(i, i + 5)) as p from win join twice on win.doc_id = twice.doc_id and win.w = twice.w)
  group by doc_id),
m as (
  select d.doc_id, d.source, cast(len(words) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
         cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from d left join covered c on c.doc_id = d.doc_id),
r as (
  select *, n_words < 10 as few_words, n_repeat_words * 100 > n_words * 20 as repeats,
         n_symbols * 100 > word_chars * 10 as symbols, n_dup_lines * 100 > n_lines * 30 as dup_lines from m),
h as (
  select source, count(*)::double as n, unnest([count(*) filter (where few_words), count(*) filter (where repeats), count(*) filter (where symbols), count(*) filter (where dup_lines)])::double as k, unnest([1, 2, 3, 4]) as rule
  from r group by source),
mean as (select rule, sum(k) / sum(n) as m from h group by rule),
prior as (
  select h.rule, any_value(mean.m) as m, sum(n * (k / n - mean.m) ** 2) / sum(n) as v from h join mean on h.rule = mean.rule group by h.rule),
weight as (
  select rule, m, greatest(1.0, least(1000.0, case when v = 0 then 1000.0 else m * (1 - m) / v - 1 end)) as w from prior),
verdict as (
  select source, max((k + m * w) / (n + w)) <= 0.5 as ok from h join weight on h.rule = weight.rule group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words or repeats as base_failed,
       not (few_words or repeats) and ok as kept
from r join verdict on r.source is not distinct from verdict.source
"""
