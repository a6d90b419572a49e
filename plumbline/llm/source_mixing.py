"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import boxed, hashable, named, table
from plumbline.sources.storage import materialise

BLOCK_DOCS = 32
#: Slots of a cycle: where the weights have no exact cycle of at most LONGEST slots, PERIOD or as many as the smallest weight needs.
PERIOD, LONGEST = 10_000, 200_000
TEMPERATURE = 0.5
#: Hash buckets by which documents are ranked within their source: rows of a bucket, and most buckets.
BUCKET_ROWS, BUCKETS = 4096, 1 << 16


def shares(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the proportion of the weights (as fractions with denominators up to a million)."""
    exact = {s: Fraction(w).limit_denominator(1_000_000) or Fraction(1, 1_000_000) for s, w in weights.items()}
    scale = lcm(1, *(f.denominator for f in exact.values()))
    whole = {s: int(f * scale) for s, f in exact.items()}
    common = gcd(0, *whole.values())
    return {s: n // common for s, n in whole.items()}


def schedule(weights: dict[str | None, float], period: int = PERIOD, longest: int = LONGEST) -> list[str | None]:
    """The source of each slot of one cycle.

    A source with share w of the weights releases its block k at floor(k / w) and has it due at ceil((k + 1) / w).
    Earliest deadline first meets every deadline, since the shares sum to one: at each slot of the cycle each source is
    less than one block from its target, in exact arithmetic. Weights whose common denominator is at most
    ``longest`` get a cycle after which every source stands exactly at its target, so this holds for any number of cycles.
    Other weights get ``period`` slots, or more if the smallest weight needs them for its first block; then each further
    cycle adds less than one block of deviation, a share of less than one in ``period``. More sources than ``longest`` are an error:
    what the driver makes has a row for each source and slot.
    """
    share = shares(weights)
    if not share:
        return []
    if len(share) > longest:
        raise ValueError(f"{len(share)} sources don't fit a cycle of {longest} slots; group them first")
    total = sum(share.values())
    slots = total if total <= longest else max(period, -(-total // min(share.values())))
    names = list(share)
    release = defaultdict(list, {0: [(i, 0) for i in range(len(names))]})
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(slots):
        for i, k in release.pop(slot, ()):
            heapq.heappush(ready, (-(-(k + 1) * total // share[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        out.append(names[i])
        release[max(slot + 1, (k + 1) * total // share[names[i]])].append((i, k + 1))
    return out


def tempered_weights(docs: DataFrame, source_col: str = "source", temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Target weights from the sources' counts, raised to ``temperature`` (1: as they are, 0: all alike).

    One row for each source comes to the driver, as a table of target weights would.
    """
    counts = docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["s"]: float(r["n"]) ** temperature for r in sorted(counts, key=lambda r: (r["s"] is not None, r["s"]))}


def _cycle_table(spark: SparkSession, slots: list[str | None]) -> DataFrame:
    """``s, k, slot, q``: the slot of block k of each source's q blocks in a cycle; a row for each slot, whatever the data."""
    names = list(dict.fromkeys(slots))
    number, quota, turn = {s: i for i, s in enumerate(names)}, Counter(slots), Counter()
    order = []
    for s in slots:
        order.append(f"{number[s]} {turn[s]} {quota[s]}")
        turn[s] += 1
    parts = F.split("x", " ")
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(order)), ",")).alias("slot", "x"))
    rows = rows.select("slot", *[F.get(parts, F.lit(n)).cast("int").alias(c) for n, c in enumerate(("i", "k", "q"))])
    named = spark.range(1).select(F.posexplode(F.array(*[F.lit(s).cast("string") for s in names])).alias("i", "s"))
    return materialise(rows.join(named, "i").select("s", "k", "slot", "q"), "mix-cycle")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """``docs`` with ``mix_slot`` (the block's slot, from 0) and ``mix_offset`` (the place within its block).

    Sorting by these two gives the mixed stream. Each source's documents are put in hash order and cut into blocks
    of ``block_docs``; block b takes slot (b div q) D + slot of (b mod q) of the cycle of D slots, q of them its source's
    (:func:`schedule`). All rows come out: where a source runs dry its later slots stay empty, and the others keep
    theirs. Up to there each source is less than one block from its target.

    Ranks within a source come from counts of (source, hash bucket) and a row number within a bucket,
    so that a source with a third of all rows is spread over all tasks. Sources that ``weights`` doesn't name
    (null is one like any other) get the smallest weight given. Rows that repeat an id are ordered by their other columns,
    so a task that runs again deals the same slots; rows without an id are ranked by their other columns. Null and empty
    texts and columns of any name pass through (own columns named ``mix_slot`` or ``mix_offset`` give way); an empty
    table gives an empty result.
    """
    n = docs.count()
    buckets = min(BUCKETS, max(64, 1 << (n // BUCKET_ROWS).bit_length()))
    given = tempered_weights(docs, source_col, temperature)
    if weights is not None:
        given = {s: weights.get(s, min(weights.values(), default=1.0)) for s in given}
    slots = schedule(given, period)
    cycle = _cycle_table(docs.sparkSession, slots or [None])
    share = cycle.where("k = 0").select(F.col("s").alias("share_s"), "q")
    ids, rest = F.col(id_col).cast("string"), F.xxhash64(*[hashable(named(f.name), f.dataType) for f in docs.schema])
    rows = boxed(docs, s=F.col(source_col).cast("string"), id=ids, rest=rest, h=F.when(F.col(id_col).isNull(), rest).otherwise(F.xxhash64(ids)))
    rows = rows.withColumn("b", F.pmod("h", F.lit(buckets)))
    sizes = rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("s").alias("size_s"), F.col("b").alias("size_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("s", "b").orderBy("h", "id", "rest")
    ranked = (
        rows.withColumn("r", F.row_number().over(within) - 1)
        .join(offsets, F.col("s").eqNullSafe(F.col("size_s")) & (F.col("b") == F.col("size_b")))
        .join(share, F.col("s").eqNullSafe(F.col("share_s")))
        .select("row", "s", "q", (F.col("ahead") + F.col("r")).alias("rank"))
        .withColumn("block", F.floor(F.col("rank") / block_docs))
    )
    turns = cycle.select(F.col("s").alias("turn_s"), "k", "slot")
    placed = ranked.join(turns, F.col("s").eqNullSafe(F.col("turn_s")) & (F.pmod("block", "q") == F.col("k")))
    slot = F.floor(F.col("block") / F.col("q")) * len(slots) + F.col("slot")
    added = {"mix_slot": slot.cast("long"), "mix_offset": (F.col("rank") % block_docs).cast("int")}
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *[v.alias(c) for c, v in added.items()])


def mixed_stream(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` with their own columns in mixed order: files and partitions follow the schedule."""
    own = boxed(docs, **{id_col: F.col(id_col), source_col: F.col(source_col)})
    return mix(own, id_col, source_col, **options).orderBy("mix_slot", "mix_offset").select("row.*")


def zipf_weights(docs: DataFrame, source_col: str = "source") -> dict[str | None, float]:
    """Uneven target weights for the registered query: one over its place for each source, by name."""
    names = [r["s"] for r in docs.select(F.col(source_col).alias("s")).distinct().collect()]
    return {s: 1 / (k + 1) for k, s in enumerate(sorted(names, key=lambda s: (s is not None, s)))}


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their slot and offset in a mix to uneven weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, weights=zipf_weights(docs))
