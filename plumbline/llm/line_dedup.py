"""Line dedup over range-partitioned line hashes; the outcome is a keep bitmap for each document, not text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import boxed, let, table
from plumbline.sources.storage import materialise, release

MIN_CHARS = 40
MIN_DOCS = 5
#: Rows of one line hash that are streamed in one piece; a line with more is cut into runs by document.
RUN = 1000
_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z (and only these) lower-cased."""
    stripped = F.btrim(line, F.lit(_STRIP))
    plain = F.octet_length(stripped) == F.length(stripped)
    return F.when(plain, F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _tag(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.hash(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``id, tag, n_dropped, dropped``: run-length keep bitmaps of the documents that lose a line.

    ``dropped`` lists runs of cleared bits as ``struct<start, length>`` over line numbers from 0; all other bits
    are set, and a document that is not listed keeps every line.

    Lines become hashes of their keys (128 bits). A hash with fewer rows than ``min_docs`` can't be common and stays behind
    (counts combine before the shuffle). The others are range-partitioned by (hash, run), with a secondary sort by
    document (largest first) and position, and streamed: the first row of a run is the occurrence that stays, and each
    change of the document counts one. A run holds all rows of a hash, or, where there are more than RUN, those of some of
    its documents; the firsts and counts of these few hashes' runs are settled in a table of one row for each run.
    So a line that a third of all documents hold is spread over many partitions.
    """
    key = line_key(F.col("line"))
    lines = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .where("id is not null")
        .select("id", _tag(F.col("text")).alias("tag"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "tag", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second half"), "key").alias("h2"),
            "id",
            F.shiftleft(F.col("tag").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("slot"),
        )
    )
    lines = materialise(lines, "line-hashes")
    often = materialise(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs), "line-counts")
    run = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / RUN)).cast("int")
    order = [F.col("h1"), F.col("h2"), F.col("run"), F.col("id").desc(), F.col("slot")]
    ranged = lines.join(often, ["h1", "h2"]).withColumn("run", run).repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    stream = Window.partitionBy("h1", "h2", "run").orderBy(F.col("id").desc(), "slot")
    changes = F.when(F.lag("id").over(stream).eqNullSafe(F.col("id")), 0).otherwise(1)
    streamed = (
        ranged.withColumn("keeper", F.first("id").over(stream)).withColumn("new", changes)
        .withColumn("docs", F.sum("new").over(stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("h1", "h2", "n", "run", "id", "slot", "keeper", "docs")
    )
    streamed = materialise(streamed, "line-runs")
    release(lines)
    release(often)
    cut = streamed.where(F.col("n") > RUN)
    runs = cut.groupBy("h1", "h2", "run").agg(F.max("keeper").alias("keeper"), F.max("docs").alias("docs"))
    settled = materialise(runs.groupBy("h1", "h2").agg(F.max("keeper").alias("keeper"), F.sum("docs").alias("docs")), "line-firsts")
    placed = streamed.where(F.col("n") <= RUN).select("id", "slot", "keeper", "docs").union(cut.drop("keeper", "docs").join(settled, ["h1", "h2"]).select("id", "slot", "keeper", "docs"))
    gone = placed.where((F.col("docs") >= min_docs) & (F.col("id") != F.col("keeper")))
    by_doc = gone.groupBy("id", F.shiftright("slot", 32).cast("int").alias("tag")).agg(
        F.sort_array(F.collect_set(F.col("slot").bitwiseAND(0xFFFFFFFF).cast("int"))).alias("p")
    )
    starts = F.filter("p", lambda x, i: ~F.get("p", i - 1).eqNullSafe(x - 1))
    ends = F.filter("p", lambda x, i: ~F.get("p", i + 1).eqNullSafe(x + 1))
    runs = F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), (z - a + 1).alias("length")))
    return by_doc.select("id", "tag", F.size("p").alias("n_dropped"), runs.alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """What a bitmap leaves of a text, joined by newlines; the text itself where ``dropped`` is null."""
    lines = _lines(text)

    def piece(all_lines: Column, k: Column) -> Column:
        before = F.get(dropped, k - 1)
        start = F.coalesce(before["start"] + before["length"], F.lit(0))
        end = F.coalesce(F.get(dropped, k)["start"], F.size(all_lines))
        return F.slice(all_lines, start + 1, end - start)

    whole = let(lines, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda k: piece(x, k))))
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(whole, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with common lines cut from the text: each stays only in the largest id that holds it.

    Columns of any other name pass through. Null texts count as one empty line and become empty; empty texts and
    tables stay as they are. Rows that repeat an id are one document, each cut by its own bitmap. Rows
    without an id keep their lines and don't count. A line repeated within the keeper stays there each time.
    """
    done = _with_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    own = F.col("row")
    return done.select(*[(kept_text(own[c], F.col("dropped")) if c == text_col else own[c]).alias(c) for c in docs.columns])


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row, n_dropped, dropped``: each row with its bitmap, null where no line goes."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).select(F.col("id").alias("map_id"), F.col("tag").alias("map_tag"), "n_dropped", "dropped")
    rows = boxed(docs, id=F.col(id_col).cast("long"), tag=_tag(F.col(text_col)))
    return rows.join(maps, (F.col("id") == F.col("map_id")) & (F.col("tag") == F.col("map_tag")), "left").select("row", "n_dropped", "dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the digest of what stays, for all documents."""
    done = _with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return done.select(
        "row.doc_id",
        F.size(_lines(F.col("row.text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("row.text"), F.col("dropped")), 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
with lines as (
  select doc_id, t.pos as pos, t.line as line,
         translate(trim(t.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from documents, lateral (select unnest(string_split(coalesce(text, ''), chr(10))) as line,
                                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos) t),
common as (
  select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (
  select l.doc_id, l.pos, l.line, coalesce(c.keeper <> l.doc_id, false) as gone from lines l left join common c on l.key = c.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
