"""Byte-level BPE encoding and decoding by DuckDB queries within each partition."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters worked on at once, words of a recursive query, tokens of a decoding query.
SPAN, WORDS, TOKENS = 1_000_000, 20_000, 500_000
#: Words and their bytes in one generation of a worker's memo, which keeps two.
MEMO, HELD = 400_000, 20_000_000
#: A round keeps one row for each unfinished word, and the rounds of a word grow with its length. So the squares of a query's
#: word lengths bound its memory, and words beyond LONGEST bytes, whose time would grow with the square, go through a heap.
SQUARES, LONGEST = 16_000_000, 4_000

# The state of a word is the list of its tokens. In each round the list comes apart into token-position rows, which join the
# merge table as neighbours; the pair of lowest rank (leftmost among equals) becomes one token. A word without a pair comes
# out once more with no spot, which marks its last state, and leaves the recursion.
ENCODE = """
with recursive states(word, tokens, spot) as (
  select word, tokens, 0::bigint from first_states
  union all
  select s.word, case when b.spot is null then tokens else tokens[:(b.spot & 1048575) - 1] || [(b.spot >> 20)::integer] || tokens[(b.spot & 1048575) + 2:] end, b.spot
  from (select word, tokens from states where spot is not null) s
  left join (
    select n.word, min((m.made::bigint << 20) | n.pos) as spot
    from (
      select word, unnest(range(1, len(tokens))) as pos, (unnest(tokens[:-2])::bigint << 32) | unnest(tokens[2:]) as pair
      from states where spot is not null) n
    join merges m on m.pair = n.pair
    group by n.word) b on b.word = s.word
)
select word, tokens from states where spot is null order by word
"""
DECODE = """
select doc, list(v.bytes order by pos) as parts from token_rows t join vocab v on v.token = t.token group by doc
"""


class Codec:
    """One DuckDB connection of a worker with the vocabulary and merge tables."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.whole = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.made = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array(self.made.keys(), pa.int64()), "made": pa.array(self.made.values(), pa.int32())})
        vocab = pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", rows)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (little-endian, four bytes each) by the recursive query.

        A batch that meets the connection's memory limit is halved and tried again; a word that does so alone goes through the heap.
        """
        import duckdb

        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        tokens = pa.array(self.byte[np.frombuffer(b"".join(words), np.uint8)])
        self.db.register("first_states", pa.table({"word": np.arange(len(words)), "tokens": pa.ListArray.from_arrays(pa.array(ends), tokens)}))
        try:
            out = self.db.sql(ENCODE).to_arrow_table()["tokens"].combine_chunks()
        except duckdb.OutOfMemoryException:
            out = None
        finally:
            self.db.unregister("first_states")
        if out is None:
            half = len(words) // 2
            return self._contract(words[:half]) + self._contract(words[half:]) if half else [self._contract_long(words[0])]
        data, cuts = out.values.to_numpy().astype("<u4").tobytes(), (out.offsets.to_numpy() * 4).tolist()
        return [data[a:z] for a, z in zip(cuts, cuts[1:])]

    def _contract_long(self, word: bytes) -> bytes:
        """Ids of one word of any length: the pair of lowest rank (leftmost among equals) first, from a heap of live pairs."""
        token = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        made = self.made.get
        heap = [(r, k) for k in range(n - 1) if (r := made(token[k] << 32 | token[k + 1])) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            z = after[k]
            if z >= n or token[k] < 0 or made(token[k] << 32 | token[z]) != r:
                continue  # one side has merged since
            token[k], token[z] = r, -1
            after[k] = y = after[z]
            if y < n:
                prior[y] = k
                if (q := made(r << 32 | token[y])) is not None:
                    heappush(heap, (q, k))
            if (x := prior[k]) >= 0 and (q := made(token[x] << 32 | r)) is not None:
                heappush(heap, (q, x))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def recall(self, words: set[str]) -> None:
        """Have the ids (little-endian, four bytes each) of all ``words`` in the memo; at most a generation of them.

        A full memo becomes the older generation, from which words that come again move back: frequent words stay.
        """
        if len(self.memo) + len(words) > MEMO or self.held + sum(map(len, words)) > HELD:
            self.memo, self.older, self.held = {}, self.memo, 0
        new = words - self.memo.keys()
        self.held += sum(map(len, new))
        again = new & self.older.keys()
        self.memo.update(zip(again, map(self.older.__getitem__, again)))
        self._learn(new - again)

    def _learn(self, words: set[str]) -> None:
        todo, raw, squares = [], [], 0
        for w in words:
            b = w.encode("utf-8")
            if (whole := self.whole.get(b)) is not None:
                self.memo[w] = whole.to_bytes(4, "little")
            elif len(b) > LONGEST:
                self.memo[w] = self._contract_long(b)
            else:
                if todo and (squares + len(b) ** 2 > SQUARES or len(todo) >= WORDS):
                    self.memo.update(zip(todo, self._contract(raw)))
                    todo, raw, squares = [], [], 0
                todo.append(w)
                raw.append(b)
                squares += len(b) ** 2
        if todo:
            self.memo.update(zip(todo, self._contract(raw)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian and four bytes each."""
        pieces = [self.split(t) for t in texts]
        distinct = set().union(*pieces)
        if len(distinct) > MEMO // 2:  # rather text by text than beyond the memo
            return [b"".join(self._ids(p)) for p in pieces]
        self.recall(distinct)
        get = self.memo.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), MEMO // 4):
            part = pieces[at : at + MEMO // 4]
            self.recall(set(part))
            yield from map(self.memo.__getitem__, part)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for, by an ordered aggregation; long lists go through in parts."""
        cut = [(k, x[at : at + 4 * TOKENS]) for k, x in enumerate(ids) for at in range(0, len(x), 4 * TOKENS)]
        out: list[list[bytes]] = [[] for _ in ids]
        at = 0
        while at < len(cut):
            end, n = at, 0
            while end < len(cut) and (end == at or n + len(cut[end][1]) // 4 <= TOKENS):
                n += len(cut[end][1]) // 4
                end += 1
            for (k, _), data in zip(cut[at:end], self._bytes([x for _, x in cut[at:end]])):
                out[k].append(data)
            at = end
        return [b"".join(x) for x in out]

    def _bytes(self, part: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids by one query; lists that meet the memory limit are halved."""
        import duckdb

        sizes = [len(x) // 4 for x in part]
        rows = {"doc": np.repeat(np.arange(len(part)), sizes), "pos": np.arange(sum(sizes)), "token": np.frombuffer(b"".join(part), "<i4")}
        self.db.register("token_rows", pa.table(rows))
        try:
            found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        except duckdb.OutOfMemoryException:
            if sum(sizes) < 2:
                raise
            found = None
        finally:
            self.db.unregister("token_rows")
        if found is None:
            half = len(part) // 2
            if half:
                return self._bytes(part[:half]) + self._bytes(part[half:])
            middle = sizes[0] // 2 * 4
            return [b"".join(self._bytes([part[0][:middle]]) + self._bytes([part[0][middle:]]))]
        out = [b""] * len(part)
        if len(found):
            lists = found["parts"].chunk(0)
            ends, cuts = np.frombuffer(lists.values.buffers()[1], np.int32), lists.offsets.to_numpy()
            data = memoryview(lists.values.buffers()[2])
            for d, a, z in zip(found["doc"].to_pylist(), cuts, cuts[1:]):
                out[d] = bytes(data[ends[a] : ends[z]])
        return out


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _spans(texts: list[str]) -> Iterator[slice]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SPAN:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the token ids of each text as bytes (little-endian, four for each). Null and empty texts have none.

    Each match of ``pattern`` is encoded by itself: a match that is a token is that token, all others go through the
    recursive query or, beyond LONGEST bytes, through a heap, once for each distinct match that a worker doesn't
    remember. Special tokens aren't known. Repeated rows and rows without an id each come out, texts of any length come
    out whole, other columns of any name are left aside, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for s in _spans(texts):
                yield pd.DataFrame({"id": b["id"].iloc[s], "ids": codec(path, pattern).encode(texts[s])})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``id, ids, decoded``: the bytes that ``ids`` stand for. Null ids count as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [x or b"" for x in b["ids"]]
            for s in _spans(ids):
                yield pd.DataFrame({"id": b["id"].iloc[s], "ids": ids[s], "decoded": codec(path, pattern).decode(ids[s])})

    return encoded.select("id", "ids").mapInPandas(run, "id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row (and ``place``, the long column ``place_col``, where one is named), as from :func:`encode` and then :func:`decode`.

    Both run in one worker for each task, which has one DuckDB connection, and only digests go back. Null and empty texts
    have no tokens and the digests of no bytes; repeated rows, rows without an id and very long texts come out like any
    other; an empty table gives an empty result.
    """
    from hashlib import sha256

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for s in _spans(texts):
                ids = c.encode(texts[s])
                yield pd.DataFrame(
                    {
                        "doc_id": b["id"].iloc[s],
                        "n_tokens": [len(x) // 4 for x in ids],
                        "ids_sha256": [sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [sha256(x).hexdigest() for x in c.decode(ids)],
                    }
                    | ({"place": b["place"].iloc[s].astype("Int64")} if place_col else {})
                )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.col(place_col).alias("place")] if place_col else []))
    return slim.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", place long" if place_col else ""))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of all documents, and of the bytes that the ids decode to."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
