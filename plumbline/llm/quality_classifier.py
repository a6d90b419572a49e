"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

THRESHOLD = 0.7
#: Words whose hashes a worker remembers before it starts anew.
MEMO = 500_000
_SHAPE = bytes(
    (97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c) for c in range(256)
)


@dataclass(frozen=True)
class Options:
    """``train_rows`` bounds the labelled rows that are learnt from (chosen by a hash of their id); all rows are scored."""

    dims: int = 1 << 18
    train_rows: int = 40_000
    shards: int = 8
    epochs: int = 2
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4


class _Hashes(dict):
    """Of a word: 32 bits of its hash above 32 bits of the hash of its shape (runs of letters and digits collapsed)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        shape = word.translate(_SHAPE)
        for c in (b"a", b"A", b"0"):
            while c + c in shape:
                shape = shape.replace(c + c, c)
        self[word] = value = crc32(word) << 32 | crc32(shape)
        return value


_hashes = _Hashes()


def features(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all texts' features one after the other, and how many each text has.

    Features are the words, pairs of neighbours, and the same of the words' shapes. Index 0 is the constant
    that each text has once, empty ones too.
    """
    words = [t.encode("utf-8").split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), np.uint64, count=int(counts.sum()))
    word, shape = (flat >> np.uint64(32)), flat & np.uint64(0xFFFFFFFF)
    last = np.zeros(len(flat), bool)
    ends = np.cumsum(counts)
    last[ends[counts > 0] - 1] = True
    doc = np.repeat(np.arange(len(texts)), counts)
    pair = ~last[:-1] if len(flat) else last
    mul = np.uint64(0x9E3779B97F4A7C15)

    def bucket(h: np.ndarray, salt: int) -> np.ndarray:
        return 1 + ((h + np.uint64(salt)) * mul >> np.uint64(40)).astype(np.int64) % (dims - 1)

    def both(h: np.ndarray) -> np.ndarray:
        return (h[:-1] * np.uint64(0x100000001B3) ^ h[1:])[pair]

    parts = [bucket(word, 1), bucket(shape, 2), bucket(both(word), 3), bucket(both(shape), 4)]
    docs = [doc, doc, doc[:-1][pair], doc[:-1][pair]]
    parts.append(np.zeros(len(texts), np.int64))
    docs.append(np.arange(len(texts)))
    sizes = sum(np.bincount(d, minlength=len(texts)) for d in docs)
    at = np.argsort(np.concatenate(docs), kind="stable")
    return np.concatenate(parts)[at], sizes


def _ftrl(texts: list[str | None], labels: np.ndarray, o: Options) -> np.ndarray:
    """Weights after ``epochs`` passes in the order given; a feature's value is its count over the root of the text's number of features, however long the text."""
    z, n = np.zeros(o.dims), np.zeros(o.dims)
    idx, sizes = features(texts, o.dims)
    ends = np.cumsum(sizes)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= o.l1, 0.0, (np.sign(zi) * o.l1 - zi) / ((o.beta + np.sqrt(n[i])) / o.alpha + o.l2))

    for _ in range(o.epochs):
        for end, size, y in zip(ends, sizes, labels):
            i, c = np.unique(idx[end - size : end], return_counts=True)
            x = c / np.sqrt(size)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / o.alpha * w
            n[i] += g * g
    return weights(slice(None))


def train(labelled: DataFrame, options: Options = Options()) -> np.ndarray:
    """Weights from ``id, text, label``: each shard of the rows runs FTRL by itself, the shards' weights are averaged.

    Rows are dealt to the shards by a hash of their id. What comes to the driver has one row for each
    dimension at most. Without any row all weights are zero.
    """
    out = np.zeros(options.dims)

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_o=[crc32(str(i).encode()) for i in rows["id"]]).sort_values(["_o", "id"])
        w = _ftrl(rows["text"].tolist(), rows["label"].to_numpy(float), options)
        used = np.flatnonzero(w)
        return pd.DataFrame({"i": used, "w": w[used]})

    dealt = labelled.select("id", "text", "label", F.pmod(F.xxhash64("id"), F.lit(options.shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInPandas(shard, "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).toPandas()
    out[found["i"].to_numpy(np.int64)] = found["w"].to_numpy() / options.shards
    return out


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: the probability of label 1 for each row, from its text alone. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            parts = []
            for at in range(0, len(b), 500):
                idx, sizes = features(b["text"].iloc[at : at + 500].tolist(), len(w))
                sums = np.add.reduceat(w[idx], np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.float64)
                parts.append(1 / (1 + np.exp(-np.clip(sums / np.sqrt(sizes), -35, 35))))
            yield pd.DataFrame({"id": b["id"], "score": np.concatenate(parts) if parts else np.zeros(0)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, score double")


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", options: Options = Options()) -> DataFrame:
    """``id, text, label`` of at most about ``options.train_rows`` labelled rows outside the held-out quarter.

    Rows without a label or id are left out; an id with several labels counts with the largest. The ids chosen
    are bounded by the option, so they are broadcast and no text is shuffled before the shards.
    """
    own = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    n = own.count()
    limit = int((1 << 30) * min(1.0, options.train_rows / max(n, 1)))
    own = own.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < limit)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labelled rows that aren't held out. Null and empty texts get the score of no feature; long texts are scored whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return score(docs, weights).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
