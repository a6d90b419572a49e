"""Toxicity: a factorization machine over hashed terms, which learns pairs of terms beside the terms themselves."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, terms
from plumbline.llm.quality_classifier import held_out, training_rows
from plumbline.sources.storage import materialise

THRESHOLD = 0.3
#: Lengths of the word beginnings that are features beside the word, in code points.
STEMS = (4, 5, 6, 7)
#: Words whose features a worker remembers before it starts anew.
MEMO = 300_000
#: Texts that are worked on at once.
TEXTS = 200


@dataclass(frozen=True)
class Options:
    """``train_rows`` bounds the labelled rows that are learnt from (chosen by a hash of their id); all rows are scored.

    A fifth of them serves to calibrate the scores. ``factors`` is the length of a term's vector; the score of a pair
    of terms is the product of their vectors.
    """

    dims: int = 1 << 18
    factors: int = 4
    train_rows: int = 20_000
    shards: int = 4
    rounds: int = 4
    batch: int = 16
    rate: float = 0.3
    spread: float = 0.05
    start: float = -2.0


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


class _Stems(dict):
    """Of a word: the buckets of itself and of its beginnings; 0 stands for none."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        text = word.decode("utf-8", "replace")
        own = [1 + crc32(word) % (self.dims - 1)]
        own += [1 + crc32(b"^" + text[:k].encode("utf-8", "replace")) % (self.dims - 1) if len(text) > k else 0 for k in STEMS]
        self[word] = value = tuple(own)
        return value


_memos: dict[int, _Stems] = {}


def features(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, feature, value`` of all texts in the order of the rows, each feature once a row.

    Features are the lower-cased words and the beginnings of longer ones, hashed. A value is the
    logarithm of the feature's occurrences, scaled so that a text's values have length one: long texts weigh as short ones. Null and empty texts have no
    feature.
    """
    memo = _memos.setdefault(dims, _Stems(dims))
    width = 1 + len(STEMS)
    sizes, counts, parts = [], [], []
    for text in texts:
        n = Counter()
        for words in terms(text):
            n.update(words)
        sizes.append(len(n))
        counts.append(np.fromiter(n.values(), np.int64, len(n)))
        parts.append(np.fromiter(chain.from_iterable(map(memo.__getitem__, n)), np.int64, len(n) * width))
    key = np.repeat(np.arange(len(texts)), sizes).repeat(width) * dims + np.concatenate([*parts, np.zeros(0, np.int64)])
    many = np.concatenate([*counts, np.zeros(0, np.int64)]).repeat(width)
    own = key % dims > 0
    key, back = np.unique(key[own], return_inverse=True)
    value = np.log2(1 + np.bincount(back, many[own], len(key)))
    row = key // dims
    return row, key % dims, value / np.sqrt(np.bincount(row, value * value, len(texts)))[row]


def _forward(m: Model, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by row: the machine's output, the vectors' sums, and each feature's own vector times its value."""
    own = m.vectors[feature] * value[:, None]
    sums = np.stack([np.bincount(row, own[:, k], n) for k in range(own.shape[1])], axis=1)
    pairs = ((sums * sums).sum(axis=1) - np.bincount(row, (own * own).sum(axis=1), n)) / 2
    return m.bias + np.bincount(row, m.linear[feature] * value, n) + pairs, sums, own


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _learn(m: Model, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, o: Options) -> Model:
    """One pass of AdaGrad over the texts (features and values of each), on the logistic loss, in the order given."""
    m = Model(m.bias, m.linear.astype(np.float64), m.vectors.astype(np.float64))
    seen, seen_v, seen_bias = np.full(o.dims, 1e-2), np.full((o.dims, o.factors), 1e-1), 1.0
    for a in range(0, len(texts), o.batch):
        part, y = texts[a : a + o.batch], labels[a : a + o.batch]
        feature, value = np.concatenate([f for f, _ in part]), np.concatenate([v for _, v in part])
        row = np.repeat(np.arange(len(part)), [len(f) for f, _ in part])
        z, sums, own = _forward(m, row, feature, value, len(part))
        g = _sigmoid(z) - y
        seen_bias += g.sum() ** 2
        m.bias -= o.rate * g.sum() / np.sqrt(seen_bias)
        at, back = np.unique(feature, return_inverse=True)
        slope = g[row] * value
        step = np.bincount(back, slope, len(at))
        seen[at] += step * step
        m.linear[at] -= o.rate * step / np.sqrt(seen[at])
        turn = slope[:, None] * (sums[row] - own)
        step = np.stack([np.bincount(back, turn[:, k], len(at)) for k in range(o.factors)], axis=1)
        seen_v[at] += step * step
        m.vectors[at] -= o.rate * step / np.sqrt(seen_v[at])
    return m


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make outputs probabilities (Platt's smoothed targets, Newton steps halved until they help)."""
    if not len(z):
        return 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], axis=1)
    loss = lambda a: np.logaddexp(0, x @ a).sum() - target @ (x @ a)
    for _ in range(100):
        p = _sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def train(labelled: DataFrame, options: Options = Options()) -> Model:
    """A model from ``id, text, label``.

    In each round every shard of the rows makes a pass from the same parameters, and its changes are averaged. The rows are
    bounded by ``options.train_rows`` (see :func:`training_rows`), and what comes to the driver has one row for each bucket
    at most. Without rows the score is the same for all texts.
    """
    o, sc = options, labelled.sparkSession.sparkContext
    start = np.random.default_rng(0)
    m = Model(o.start, np.zeros(o.dims), o.spread * (start.random((o.dims, o.factors)) - 0.5))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), TEXTS):
                part = b.iloc[a : a + TEXTS]
                row, feature, value = features(part["text"].tolist(), o.dims)
                cuts = np.searchsorted(row, np.arange(1, len(part)))
                yield pd.DataFrame({"id": part["id"], "shard": part["shard"], "label": part["label"], "feature": np.split(feature, cuts), "value": np.split(value, cuts)})

    # A fifth of the ids calibrates, the others are dealt to the shards.
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5))
    dealt = labelled.select("id", "text", F.col("label").cast("double").alias("label"), F.when(part == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(o.shards))).cast("int").alias("shard"))
    rows = materialise(dealt.mapInPandas(extract, "id long, shard int, label double, feature array<long>, value array<double>"), "toxic-rows")

    def one(group: pd.DataFrame, shared) -> pd.DataFrame:
        group = group.assign(_o=[crc32(str(i).encode()) for i in group["id"]]).sort_values(["_o", "id"])
        before: Model = shared.value
        after = _learn(before, list(zip(group["feature"], group["value"])), group["label"].to_numpy(), o)
        moved = np.flatnonzero((after.linear != before.linear) | (after.vectors != before.vectors).any(axis=1))
        whole = np.column_stack([after.linear - before.linear, after.vectors - before.vectors])[moved]
        bias = np.array([[after.bias - before.bias] + [0.0] * o.factors])
        return pd.DataFrame(np.concatenate([bias, whole]), columns=columns).assign(i=[-1, *moved])[["i", *columns]]

    columns = [f"c{k}" for k in range(1 + o.factors)]
    schema = "i long, " + ", ".join(f"{c} double" for c in columns)
    for _ in range(o.rounds):
        shared = sc.broadcast(m)
        moved = rows.where("shard >= 0").groupBy("shard").applyInPandas(lambda group: one(group, shared), schema)  # noqa: B023
        change = moved.groupBy("i").agg(*[(F.sum(c) / o.shards).alias(c) for c in columns]).toPandas()
        shared.unpersist()
        of = change["i"].to_numpy(np.int64)
        by = change[columns].to_numpy()
        m = Model(m.bias + float(by[of < 0, 0].sum()), m.linear.copy(), m.vectors.copy())
        m.linear[of[of >= 0]] += by[of >= 0, 0]
        m.vectors[of[of >= 0]] += by[of >= 0, 1:]

    shared = sc.broadcast(m)

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [len(f) for f in b["feature"]]
            row = np.repeat(np.arange(len(b)), n)
            f, v = (np.concatenate([*b[c], np.zeros(0)]) for c in ("feature", "value"))
            yield pd.DataFrame({"z": _forward(shared.value, row, f.astype(np.int64), v, len(b))[0], "y": b["label"]})

    seen = rows.where("shard < 0").select("label", "feature", "value").mapInPandas(outputs, "z double, y double").toPandas()
    shared.unpersist()
    m.slope, m.shift = _calibrate(seen["z"].to_numpy(), seen["y"].to_numpy())
    return m


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: the probability of label 1 for each row, from its whole text alone.

    Null and empty texts get the score of a text without features; null ids and repeated rows come out as they are; very long texts are split in
    pieces and need memory for their distinct words; other columns are left aside; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.bias, model.linear.astype(np.float32), model.vectors.astype(np.float32), model.slope, model.shift))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for a in range(0, len(b), TEXTS):
                part = b.iloc[a : a + TEXTS]
                z = _forward(m, *features(part["text"].tolist(), len(m.linear)), len(part))[0]
                yield pd.DataFrame({"id": part["id"], "score": _sigmoid(m.slope * z + m.shift)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", Options()))
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
