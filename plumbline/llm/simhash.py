"""SimHash near-duplicates through an inverted index on byte positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_words, boxed, table
from plumbline.operators.graph import connected_components
from plumbline.sources.storage import materialise

SHINGLE = 3
DISTANCE = 3
#: Fingerprints of one posting list that a task compares at once; longer lists are dealt in pairs of blocks.
BLOCK = 1024

# Two fingerprints that differ in at most three bits share at least five of their eight positional bytes.
# Any five of eight positions hold one of these 14 sets of four: either half, or two positions
# of each half that belong to the same perfect matching of both halves.
_MATCHINGS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
POSITION_SETS = ((0, 1, 2, 3), (4, 5, 6, 7)) + tuple(
    (*low, *(p + 4 for p in high)) for pairs in _MATCHINGS for low in pairs for high in pairs
)
SHARED_BYTES = 8 - DISTANCE


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text; zero where there is no word."""
    from xxhash import xxh64_intdigest

    words = ascii_words(text)
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)))] or [b" ".join(words)]
    n = len(grams)
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp``: a fingerprint for each row. A null text counts as an empty one (fingerprint zero)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": [simhash(t, shingle) for t in b["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links that connect all that links within DISTANCE connect: each pop marks what it reaches once."""
    fps = left if same else np.concatenate([left, right])
    side = np.zeros(len(fps), bool)
    side[len(left):] = True
    free = np.ones(len(fps), bool)
    out = []
    for start in range(len(fps)):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(free if same else free & (side != side[i]))
            if not len(rest):
                continue
            x = fps[rest] ^ fps[i]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            x, rest = x[shared >= SHARED_BYTES], rest[shared >= SHARED_BYTES]
            near = rest[np.bitwise_count(x) <= DISTANCE]
            free[near] = False
            todo += near.tolist()
            out += [(int(fps[i].view("<i8")), int(v)) for v in fps[near].view("<i8")]
    return out


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``q, key, i, j``: the links of each block pair; a list that a batch cuts waits for the next."""

    def of(group: pd.DataFrame) -> list[tuple[int, int]]:
        fps, block = group["fp"].to_numpy().view("<u8"), group["block"].to_numpy()
        i, j = group["i"].iat[0], group["j"].iat[0]
        return _forest(fps[block == i], fps[block == j], i == j)

    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        keys = b[["q", "key", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)]
        found = [e for a, z in zip(cuts, cuts[1:]) for e in of(b.iloc[a:z])]
        rest = b.iloc[cuts[-1]:] if len(b) else None
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    if rest is not None and len(rest):
        yield pd.DataFrame(of(rest), columns=["a", "b"], dtype="int64")


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between fingerprints of the column ``fp`` (each once) at three or fewer differing bits.

    The inverted index has a posting for each of 14 sets of four positional bytes. Fingerprints of one
    posting list tally their shared positional bytes; five or more make a candidate, whose bits
    are then compared. Lists longer than ``block`` are dealt as pairs of blocks to separate tasks. Within
    a block pair only links that join two parts come out (a spanning forest), so that a
    list never yields all its pairs, while the components stay exact.
    """
    sets = [F.struct(F.lit(q).cast("int").alias("q"), F.col("fp").bitwiseAND(_mask(p)).alias("key")) for q, p in enumerate(POSITION_SETS)]
    index = distinct.select("fp", F.explode(F.array(*sets)).alias("p")).select("fp", "p.q", "p.key")
    sizes = index.groupBy("q", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (
        index.join(sizes, ["q", "key"])
        .withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("q", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    )
    lists = dealt.repartition("q", "key", "i", "j").sortWithinPartitions("q", "key", "i", "j")
    return lists.mapInPandas(_link, "a long, b long")


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp, component`` for each row: the smallest id reachable over links of three or fewer bits.

    Equal fingerprints are one node, named by its smallest id, so groups of exact copies of any size cost one
    posting. Null or empty texts share fingerprint zero. A row without an id keeps its fingerprint and gets
    the component of its fingerprint's other rows (null if they have no id either). Repeated rows each
    come out. An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = materialise(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    links = fingerprint_links(reps.where("rep is not null").select("fp"))
    edges = (
        links.distinct()
        .join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a")
        .join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b")
        .select("u", "v")
    )
    comp = connected_components(edges, "u", "v")
    named = reps.join(comp, reps["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(named, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each near-duplicate group keeps the smallest id, with all their columns.

    Rows that repeat the kept id (equal or not) count as one document and all stay. Rows without an id are no
    document's copy: they stay too. Columns of any name pass through; an empty table gives an empty result.
    """
    near = near_duplicates(docs, id_col, text_col)
    keep = near.where("id = component").select(F.col("id").alias("kept")).distinct()
    rows = boxed(docs, id=F.col(id_col).cast("long"))
    return rows.join(keep, F.col("id") == F.col("kept"), "left_semi").union(rows.where("id is null")).select("row.*")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
