"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.sources.storage import materialise, release

#: One run in so many loses a code point before it counts.
TYPO_EVERY = 31
#: Distinct words that a task holds before it hands their counts on.
HELD = 300_000
#: Elements of the arrays that a task works on at once.
ELEMENTS = 1 << 20

# In UTF-8 the letters U+00C0 to U+00FF are C3 80 to C3 BF; all other characters beyond ASCII end a run.
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_LETTERS = bytes(c if 97 <= c <= 122 or 128 <= c <= 191 or c == 0xC3 else 32 for c in range(256))

_BASE = 0x9E3779B97F4A7C15
_LANES = 8
_LANE_BITS = 5
_SEGMENT = 2048


@dataclass(frozen=True)
class Options:
    """``filter_bytes`` bounds the filters that are broadcast at once; a larger vocabulary is probed window by window.

    Words of ``long`` code points or more share one shard of the filters and are tested by two blocks, as they have
    more edits and each edit that passes is a long string.
    """

    min_length: int = 7
    min_count: int = 2
    ratio: int = 10
    filter_bytes: int = 32 << 20
    bits_per_word: int = 16
    long: int = 40


def runs(text: str | None) -> list[bytes]:
    """The maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text in UTF-8, A-Z lower-cased."""
    if not text:
        return []
    data = text.encode("utf-8").lower()
    return _OTHER.sub(b" ", data).translate(_LETTERS).split()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` over all runs of all rows, after the typos that the rows' ids seed; a word may come out several times.

    A run of ``h = crc32("<id>:<run>")`` divisible by 31 loses its code point ``h % length``. A null id counts as an empty
    string, a null text has no run. Counts combine within a task before anything is shuffled; words of six bytes or less,
    which can't be long enough, stay behind.
    """

    def emit(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs(text.as_py())).items():
                    h = crc32(word, start)
                    if not h % TYPO_EVERY:
                        s = word.decode()
                        word = (s[: h % len(s)] + s[h % len(s) + 1 :]).encode()
                    if len(word) > 6:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield emit(counts)
                    counts = {}
        yield emit(counts)

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")


# ---- Filters: 256-bit blocks of eight lanes, the shards of all lengths one after the other ----


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    """Descending powers of the base, so that a word's hash is the sum of its codes times these."""
    p = np.full(length, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)[::-1].copy()


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    h = h + np.uint64(0x632BE59BD9B4E019 * (turn + 1) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Layout:
    """Which blocks hold the words of which length: ``counts`` is the number of words by length (the last shard: ``long`` or more)."""

    def __init__(self, counts: dict[int, int], options: Options):
        self.long = options.long
        self.blocks, self.start, at = {}, {}, 0
        for length in sorted(counts):
            turns = 2 if length >= options.long else 1
            self.start[length], self.blocks[length] = at, max(1, -(-counts[length] * turns * options.bits_per_word // 256))
            at += self.blocks[length]
        self.total = at

    def shard(self, length: int) -> int:
        return min(length, self.long)

    def places(self, h: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block and lane seed of each hash, once for each turn."""
        shard = self.shard(length)
        for turn in range(2 if length >= self.long else 1):
            x = _mixed(h, turn)
            block = (x >> np.uint64(32)) * np.uint64(self.blocks[shard]) >> np.uint64(32)
            yield block.astype(np.int64) + self.start[shard], x & np.uint64(0xFFFFFFFF)


def _lane(seed: np.ndarray, lane: int) -> np.ndarray:
    """The bit that a seed sets in a lane."""
    odd = np.uint64(0x47B6137B + 0x1F3D5B7A * lane | 1)
    return np.uint32(1) << ((seed * odd & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - _LANE_BITS)).astype(np.uint32)


def _filter(vocab: DataFrame, layout: Layout, low: int, high: int) -> bytes:
    """Blocks ``low`` to ``high`` filled with the words of ``vocab``; segments are filled by tasks and put together here."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, words in _by_length(b["word"]):
                for at in range(0, len(words), max(1, ELEMENTS // length)):
                    codes = _codes(words[at : at + max(1, ELEMENTS // length)], length)
                    for block, seed in layout.places((codes * _powers(length)).sum(axis=1), length):
                        own = (block >= low) & (block < high)
                        yield pd.DataFrame({"segment": (block[own] - low) // _SEGMENT, "block": block[own] - low, "seed": seed[own].astype(np.int64)})

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_SEGMENT * _LANES, np.uint32)
        block, seed = rows["block"].to_numpy() % _SEGMENT, rows["seed"].to_numpy().astype(np.uint64)
        for lane in range(_LANES):
            np.bitwise_or.at(bits, block * _LANES + lane, _lane(seed, lane))
        return pd.DataFrame({"segment": [rows["segment"].iat[0]], "bits": [bits.tobytes()]})

    placed = vocab.select("word").mapInPandas(place, "segment long, block long, seed long")
    out = np.zeros((-(-(high - low) // _SEGMENT), _SEGMENT * _LANES), np.uint32)
    for r in placed.groupBy("segment").applyInPandas(fill, "segment long, bits binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint32)
    return out.tobytes()


def _by_length(words: pd.Series) -> Iterator[tuple[int, list[str]]]:
    for length, own in words.groupby(words.str.len()):
        yield int(length), own.tolist()


class _Probe:
    """Tells which hashes a window of the filters may hold."""

    def __init__(self, bits: bytes, layout: Layout, low: int, high: int):
        self.bits, self.layout, self.low, self.high = np.frombuffer(bits, np.uint32), layout, low, high

    def reaches(self, length: int) -> bool:
        shard = self.layout.shard(length)
        start = self.layout.start.get(shard)
        return start is not None and start < self.high and start + self.layout.blocks[shard] > self.low

    def hits(self, h: np.ndarray, length: int) -> np.ndarray:
        """Positions in ``h`` that pass all lanes. Of a hash with two blocks, the first says which window it belongs to, and
        a second one outside of that window counts as passed.
        """
        at = np.arange(len(h))
        for turn, (block, seed) in enumerate(self.layout.places(h, length)):
            inside = (block >= self.low) & (block < self.high)
            if turn == 0:
                at = np.flatnonzero(inside)
            test, free = (at, at[:0]) if turn == 0 else (at[inside[at]], at[~inside[at]])
            word = (block - self.low) * _LANES
            for lane in range(_LANES):
                test = test[(self.bits[word[test] + lane] & _lane(seed[test], lane)) != 0]
            at = np.concatenate([test, free])
        return at


def _edits(words: list[str], length: int, letters: np.ndarray, probe: _Probe) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Row numbers and edited words that may be in the vocabulary: each replacement by a larger letter, each deletion.

    The hash of an edit comes from the word's hash, so a string is built only where the filter lets it pass. A
    pair of words is generated from one side alone, and of a run of equal letters only the first is deleted.
    """
    codes, powers = _codes(words, length), _powers(length)
    terms = codes * powers
    whole = terms.sum(axis=1)[:, None]
    rows_at_once = max(1, 4 * ELEMENTS // length)

    def built(hit: np.ndarray, where: np.ndarray, change) -> Iterator[tuple[np.ndarray, list[str]]]:
        row, pos = where // length, where % length
        row, pos = row[hit], pos[hit]
        for a in range(0, len(row), rows_at_once):
            r, p = row[a : a + rows_at_once], pos[a : a + rows_at_once]
            new = change(codes[r].astype(np.uint32), p)
            yield r, np.ascontiguousarray(new).view(f"U{new.shape[1]}").reshape(-1).tolist()

    def replaced(letter: int):
        def change(rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
            rows[np.arange(len(rows)), pos] = letter
            return rows

        return change

    def deleted(rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return rows[np.arange(length)[None, :] != pos[:, None]].reshape(len(rows), length - 1)

    if probe.reaches(length):
        for letter in letters:
            where = np.flatnonzero(codes < letter)
            h = (whole + (letter - codes) * powers).reshape(-1)[where]
            yield from built(probe.hits(h, length), where, replaced(int(letter)))
    if length > 1 and probe.reaches(length - 1):
        shorter = codes[:, :-1] * powers[1:]
        before = np.zeros_like(codes)
        np.cumsum(shorter, axis=1, out=before[:, 1:])
        after = whole - np.cumsum(terms, axis=1)
        first = np.ones(codes.shape, bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        where = np.flatnonzero(first)
        yield from built(probe.hits((before + after).reshape(-1)[where], length - 1), where, deleted)


def _candidates(vocab: DataFrame, layout: Layout, letters: list[int], options: Options) -> list[DataFrame]:
    """``edit, word, n``: edits of the words that a filter lets pass, a table for each window of the filters."""
    sc, window = vocab.sparkSession.sparkContext, max(_SEGMENT, options.filter_bytes // (4 * _LANES))
    alphabet, found = np.array(sorted(letters), np.uint64), []

    def run(batches: Iterator[pd.DataFrame], shared, low: int, high: int) -> Iterator[pd.DataFrame]:
        probe = _Probe(shared.value, layout, low, high)
        for b in batches:
            for length, own in b.groupby(b["word"].str.len()):
                length, words, n = int(length), own["word"].tolist(), own["n"].to_numpy()
                step = max(1, ELEMENTS // length)
                for a in range(0, len(words), step):
                    for row, edits in _edits(words[a : a + step], length, alphabet, probe):
                        yield pd.DataFrame({"edit": edits, "word": [words[a + r] for r in row], "n": n[a + row]})

    for low in range(0, layout.total, window):
        high = min(layout.total, low + window)
        shared = sc.broadcast(_filter(vocab, layout, low, high))
        found.append(materialise(vocab.mapInPandas(partial(run, shared=shared, low=low, high=high), "edit string, word string, n long"), "spelling-edits"))
        shared.unpersist()
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the forms followed to the last. Counts grow at each step, so there is no cycle and few steps."""
    roots = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("via"), F.col("root").alias("further"))
        step = materialise(roots.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        release(roots)
        roots = step
        if not roots.where("moved").head(1):
            return roots.select("word", "root")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word of all texts with its form, its last form and its near words' number.

    A word is a run of letters of ``min_length`` code points or more with ``min_count`` occurrences or more. Two words are
    near if one inserted, deleted or replaced code point parts them. A word's form is its near word of the largest n (ties: the smallest in code-point
    order) if that n is at least ``ratio`` times its own; its root follows forms to the last and is the word
    itself without one.

    The filters have a fixed bound (``Options.filter_bytes``); where the vocabulary needs more, windows of them are
    broadcast one after the other, so no edit is lost. Edits that pass are held against the vocabulary itself by a join.
    A word has no more near words than edits, so no group is unbounded. Null ids count as an empty string in the typos' seed; null and
    empty texts have no word; repeated rows count each time (with the same typos); very long runs are words like others,
    worked on in pieces; other columns are left aside; an empty table gives an empty result.
    """
    counted = word_counts(docs, id_col, text_col).where(F.char_length("word") >= options.min_length)
    vocab = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= options.min_count), "spelling-words")
    sizes = {r[0]: r[1] for r in vocab.groupBy(F.least(F.char_length("word"), F.lit(options.long))).count().collect()}
    letters = [ord(r[0]) for r in vocab.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0]]
    near = vocab.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    links = vocab.select(F.lit(None).cast("string").alias("word"), F.lit(None).cast("struct<less:bigint,near:string>").alias("best")).limit(0)
    for edits in _candidates(vocab, Layout(sizes, options), letters, options):
        pair = edits.join(near, "edit")
        one = F.struct(F.col("word"), F.struct((-F.col("near_n")).alias("less"), F.col("edit").alias("near")).alias("best"))
        other = F.struct(F.col("edit").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")).alias("best"))
        links = links.union(pair.select(F.explode(F.array(one, other)).alias("l")).select("l.*"))
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    grows = -F.col("best.less") >= F.col("n") * options.ratio
    shaped = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(grows, F.col("best.near")).alias("form"), F.when(grows, -F.col("best.less")).alias("form_n")
    )
    shaped = materialise(shaped, "spelling-forms")
    roots = _roots(shaped.where("form is not null"))
    return shaped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over all documents."""
    return variant_groups(table(spark, sf_dir, "documents"))
