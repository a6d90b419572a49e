"""Ranked lexical search: documents cut to the items' vocabulary, equal bags of words scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, terms
from plumbline.sources.storage import materialise

TOP = 20
#: Distinct (item, term) pairs that one pass broadcasts; more items are searched in several passes.
PASS_TERMS = 400_000
#: (class, item) products that are summed at once.
PRODUCTS = 1 << 21
#: No id: after all others among equal scores.
_LAST = np.iinfo(np.int64).max


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term, qtf``: the terms of each item with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1)):
                n = Counter(t for part in terms(text.as_py()) for t in part)
                words = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([item] * len(n), pa.int64()), words, pa.array(list(n.values()), pa.int64())], ["item", "term", "qtf"])

    one = items.groupBy(F.col(id_col).cast("long").alias("item")).agg(F.min(text_col).alias("text"))
    return one.mapInArrow(run, "item long, term string, qtf long")


def _bags(docs: DataFrame, vocab: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, bag`` of each row with a term: how many terms it has, and its terms of the vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    entry = pa.struct([("term", pa.int32()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            ids, sizes, ends, words, tfs = [], [], [0], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                n, bag = 0, Counter()
                for part in terms(text.as_py()):
                    n += len(part)
                    bag.update(map(number, part))
                bag.pop(None, None)
                if n:
                    ids.append(doc)
                    sizes.append(n)
                    own = sorted(bag.items())
                    words += [t for t, _ in own]
                    tfs += [k for _, k in own]
                    ends.append(len(words))
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.int32()), pa.array(tfs, pa.int64())], fields=list(entry))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["id", "n", "bag"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, n long, bag array<struct<term:int,tf:bigint>>")


def _length_part(n: Column, total: int, tokens: int) -> Column:
    """``m`` of a document: 75 and a quarter of its length in per cent of the mean."""
    return F.lit(75) + F.expr(f"(25 * n * {total}L) div {tokens}L")


class _Postings:
    """Items by term: the items ``item`` from ``starts[t]`` to ``starts[t + 1]`` hold term ``t``, with its weight times its repeats."""

    def __init__(self, term: np.ndarray, item: np.ndarray, weight: np.ndarray, n_terms: int, n_items: int):
        at = np.argsort(term, kind="stable")
        self.item, self.weight, self.n_items = item[at], weight[at], n_items
        self.starts = np.searchsorted(term[at], np.arange(n_terms + 1))

    def scores(self, row: np.ndarray, term: np.ndarray, gain: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums of weight times gain, a row for each class and a column for each item."""
        out = np.zeros(n_rows * self.n_items, np.int64)
        sizes = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS)))
            k = np.repeat(np.arange(at, to), sizes[at:to])
            posting = np.arange(len(k)) - np.repeat(ends[at:to] - sizes[at:to] - (ends[at - 1] if at else 0), sizes[at:to]) + self.starts[term[k]]
            np.add.at(out, row[k] * self.n_items + self.item[posting], self.weight[posting] * gain[k])
            at = to
        return out.reshape(n_rows, self.n_items)


def _best(score: np.ndarray, rep: np.ndarray, name: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column the ``top`` rows with the highest score, equal ones by ``rep``."""
    at = np.argsort(rep, kind="stable")
    score, rep, name = score[at], rep[at], name[at]
    keep = np.argsort(-score, axis=0, kind="stable")[:top]
    return np.take_along_axis(score, keep, axis=0), rep[keep], name[keep]


def _top_classes(classes: DataFrame, postings: _Postings, top: int) -> DataFrame:
    """``pos, score, rep, class_id``: of each task's classes the ``top`` of each item, by score and smallest id."""
    shared = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        width = max(1, (1 << 22) // max(1, p.n_items))
        held = (np.zeros((0, p.n_items), np.int64), np.zeros((0, p.n_items), np.int64), np.zeros((0, p.n_items), np.int64))
        for whole in batches:
            for a in range(0, whole.num_rows, width):
                b = whole.slice(a, width)
                bags = b.column("bag")
                sizes = np.diff(bags.offsets.to_numpy())
                flat = bags.flatten()
                row = np.repeat(np.arange(b.num_rows), sizes)
                m = b.column("m").to_numpy()[row]
                tf = flat.field("tf").to_numpy()
                s = p.scores(row, flat.field("term").to_numpy(), 1_000_000_000 * tf // (1000 * tf + 12 * m), b.num_rows)
                rep = b.column("rep").fill_null(_LAST).to_numpy()
                s, r, c = _best(s, rep, b.column("class_id").to_numpy(), top)
                s, r, c = (np.concatenate([x, y]) for x, y in zip(held, (s, r, c)))
                keep = np.lexsort((r, -s), axis=0)[:top]
                held = tuple(np.take_along_axis(x, keep, axis=0) for x in (s, r, c))
        s, r, c = held
        k, pos = np.nonzero(s > 0)
        yield pa.record_batch([pa.array(pos.astype(np.int32)), pa.array(s[k, pos]), pa.array(r[k, pos]), pa.array(c[k, pos])], ["pos", "score", "rep", "class_id"])

    found = classes.select("m", "bag", "rep", "class_id").mapInArrow(run, "pos int, score long, rep long, class_id long")
    order = Window.partitionBy("pos").orderBy(F.desc("score"), "rep", "class_id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).select("pos", "score", "class_id")


def _search_pass(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame | None:
    """One pass: ``items`` (of bounded size, see PASS_TERMS) against all documents."""
    wanted = items.toArrow()
    if not wanted.num_rows:
        return None
    asked = wanted["item"].to_pylist()
    names = sorted(set(asked), key=lambda x: (x is None, x))
    at = {x: k for k, x in enumerate(names)}
    item = np.array([at[x] for x in asked], np.int64)
    words = wanted["term"].to_pylist()
    vocab = {w: k for k, w in enumerate(sorted(set(words)))}
    term = np.array([vocab[w] for w in words], np.int64)

    bags = materialise(_bags(docs, {w.encode(): k for w, k in vocab.items()}, id_col, text_col), "search-bags")
    total, tokens = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return None
    key = ["h", "m", "bag"]
    rows = bags.where(F.size("bag") > 0).withColumn("m", _length_part(F.col("n"), total, tokens)).select("id", "m", "bag", F.xxhash64("m", "bag").alias("h"))
    classes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("rep")).withColumn("class_id", F.monotonically_increasing_id())
    classes = materialise(classes, "search-classes")  # from here on a class keeps its number

    df = np.zeros(len(vocab), np.int64)
    counted = classes.select(F.explode("bag.term").alias("term"), "size").groupBy("term").agg(F.sum("size").alias("df")).toPandas()
    df[counted["term"].to_numpy(np.int64)] = counted["df"].to_numpy()
    weight = np.array([floor(1000 * log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    postings = _Postings(term, item, weight[term] * wanted["qtf"].to_numpy(), len(vocab), len(names))

    best = materialise(_top_classes(classes, postings, top), "search-best")
    chosen = materialise(classes.join(best.select("class_id").distinct(), "class_id").select("class_id", *key), "search-chosen")
    # At most `top` classes an item and so a bounded set of hashes; the bags themselves are compared below.
    hashes = chosen.select("h").distinct()
    first = Window.partitionBy(*key).orderBy(F.col("id").asc_nulls_last())
    members = rows.join(F.broadcast(hashes), "h", "left_semi").withColumn("k", F.row_number().over(first)).where(F.col("k") <= top)
    members = members.join(chosen, key).select("class_id", "id")
    order = Window.partitionBy("pos").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = best.join(members, "class_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    given = docs.sparkSession.createDataFrame(list(enumerate(names)), "pos int, item_id long")
    return ranked.join(F.broadcast(given), "pos").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above zero, equal ones by id.

    Documents keep only the terms that items hold. Documents of the same terms, occurrences and length part form a class (found by
    hash, held against the bags themselves), which is scored once; of the classes of an item the best by score and smallest id
    hold all its best documents, and give their smallest ids. A group of copies is one class, and no task sees all its members.

    The items go through in passes of about ``pass_terms`` (item, term) pairs, so that what is broadcast has a bound whatever the
    number of items; each pass reads all texts. Null and empty texts have no term and count nowhere. Repeated rows
    are documents of their own; rows without an id come after those with one among equal scores. Of rows that repeat an item's id the
    smallest text counts; an item without terms gets no row. Very long texts are split in pieces. Other columns are left aside.
    Empty tables give an empty result.
    """
    asked = materialise(_item_terms(items, item_col, item_text_col), "search-items")
    passes = max(1, -(-asked.count() // pass_terms))
    own = lambda k: asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
    found = [_search_pass(docs, own(k), doc_col, text_col, top) for k in range(passes)]
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with t as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
tf as (select doc_id, term, count(*) as tf from t group by doc_id, term),
len as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
whole as (select count(*) as docs, cast(sum(n) as bigint) as terms from len),
m as (select doc_id, 75 + (25 * n * docs) // terms as m from len, whole),
q as (
  select item_id, term, count(*) as qtf
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
  group by item_id, term),
w as (
  select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as w
  from (select term, count(*) as df from tf where term in (select term from q) group by term), whole),
s as (
  select item_id, doc_id, cast(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from q join w using (term) join tf using (term) join m using (doc_id) group by item_id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
"""
