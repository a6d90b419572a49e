"""Token counts from compiled finite-state transducers, without making the tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Code points worked on at once, and per chunk of the state-map scan.
SPAN, CHUNK = 1 << 20, 128
#: Words and states that a worker keeps before it starts anew.
WORDS, STATES = 700_000, 400_000

# Classes of characters, as the splitting pattern tells them apart. END stands after each text.
SP, WS, LET, NUM, OTH, APO, ONE, R, V, L_, E_, END = range(12)
# States: before any word; in letters, numbers, others; after a leading apostrophe, and after it and r, v or l; after a
# contraction; after white space of one or more characters, the last of which is a space or not.
START, INL, INN, INO, AP, AP_R, AP_V, AP_L, DONE, S1, W1, S2, W2 = range(13)
N_STATES, N_CLASSES = 13, 12


@cache
def split_transducer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``next, here, before``: by class and state, the next state and whether a word starts at this or at the last character.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    nxt = np.zeros((N_CLASSES, N_STATES), np.uint8)
    here, before = np.zeros_like(nxt), np.zeros_like(nxt)
    letters = {LET, ONE, R, V, L_, E_}
    kind = {c: INL for c in letters} | {NUM: INN, OTH: INO, APO: AP, SP: S1, WS: W1, END: START}
    for c in range(N_CLASSES):
        for s in range(N_STATES):
            to, at, last = kind[c], c != END, False
            if s == INL and c in letters or s == INN and c == NUM or s in (INO, AP) and c in (OTH, APO):
                to, at = INO if s == AP else s, False
            elif s == AP and c in (ONE, R, V, L_):
                to, at = {ONE: DONE, R: AP_R, V: AP_V, L_: AP_L}[c], False
            elif s in (AP_R, AP_V, AP_L):
                if c == (L_ if s == AP_L else E_):
                    to, at = DONE, False
                else:  # no contraction: the letter after the apostrophe began a word
                    last = True
                    at = at and c not in letters
            elif s in (S1, S2, W1, W2):
                if c in (SP, WS):
                    to, at = (S2 if c == SP else W2), False
                elif c != END:
                    last = s in (S2, W2)
                    if s in (S1, S2):
                        to, at = (INO if c == APO else to), False
            if s == INO and c == APO:
                to, at = INO, False
            nxt[c, s], here[c, s], before[c, s] = to, at, last
    return nxt, here, before


@cache
def _class_table() -> np.ndarray:
    return np.full(0x110000, 255, np.uint8)


def _classes(codes: np.ndarray) -> np.ndarray:
    """Classes of code points; each is looked up in the Unicode tables when it comes first."""
    import regex

    known = _class_table()
    out = known[codes]
    for c in np.unique(codes[out == 255]).tolist():
        ch = chr(c)
        if ch == " ":
            k = SP
        elif ch == "'":
            k = APO
        elif ch in "stmdrvle":
            k = {"r": R, "v": V, "l": L_, "e": E_}.get(ch, ONE)
        elif regex.match(r"\s", ch):
            k = WS
        elif regex.match(r"\p{L}", ch):
            k = LET
        elif regex.match(r"\p{N}", ch):
            k = NUM
        else:
            k = OTH
        known[c] = k
    return known[codes] if (out == 255).any() else out


def _scan(maps: np.ndarray) -> np.ndarray:
    """Entry state of each chunk from the chunks' state maps, by a parallel prefix composition from START."""
    n = len(maps)
    step = 1
    maps = maps.copy()
    while step < n:  # after this round, maps[i] takes the state before chunk i - 2 step + 1 to the state after chunk i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Positions at which the splitting pattern starts a word, in a row of classes with END after each text."""
    nxt, here, before = split_transducer()
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.intp) * N_STATES
    flat = nxt.ravel()
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (chunks, 1))
    for col in columns:
        maps = flat[col[:, None] + maps]
    state = _scan(maps)
    at, last = np.empty((CHUNK, chunks), bool), np.empty((CHUNK, chunks), bool)
    here_, before_ = here.ravel(), before.ravel()
    for j, col in enumerate(columns):
        k = col + state
        at[j], last[j], state = here_[k], before_[k], flat[k]
    starts = at.T.ravel()
    starts[:-1] |= last.T.ravel()[1:]
    return np.flatnonzero(starts[:n])


class WordTransducer:
    """Byte-pair encoding as a deterministic transducer: a transition is annotated with the tokens that it emits.

    A state is a prefix of words, made when a word first needs it. It knows the last token of the prefix's
    encoding: the one token that ends there and may follow the last token of what stands before it. The number of
    tokens of a prefix is one more than that of the prefix before its last token; a transition emits the difference.
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab = vocab
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.made = {k: vocab[a + b] for k, (a, b) in enumerate(merges)}
        self.text = {i: t for t, i in vocab.items()}
        self.longest = max(map(len, vocab))
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.next: dict[int, int] = {}
        self.last, self.emitted = [-1], [0]

    def encode(self, word: bytes) -> list[int]:
        """Tokens by merging the pair of lowest rank, leftmost first, until none is left."""
        t = [self.vocab[word[k : k + 1]] for k in range(len(word))]
        while len(t) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(t, t[1:])]
            r = min(ranks)
            if r == 1 << 30:
                break
            k = ranks.index(r)
            t[k : k + 2] = [self.made[r]]
        return t

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a (-1: at the start) in an encoding."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= WORDS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.encode(self.text.get(a, b"") + self.text[b]) == ([b] if a < 0 else [a, b])
        return known

    def count(self, word: bytes) -> int:
        if len(self.last) >= STATES:
            self._reset()
        nxt, state, path, total = self.next, 0, [0], 0
        counts = [0]
        for end in range(1, len(word) + 1):
            key = state << 8 | word[end - 1]
            to = nxt.get(key)
            if to is None:
                for start in range(max(0, end - self.longest), end):
                    t = self.vocab.get(word[start:end])
                    if t is not None and self.follows(self.last[path[start]], t):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                to = nxt[key] = len(self.last)
                self.last.append(t)
                self.emitted.append(counts[start] + 1 - total)
            total += self.emitted[to]
            counts.append(total)
            path.append(to)
            state = to
        return total


def _byte_chars() -> dict[str, int]:
    """The vocabulary file's way to write bytes: printable ones as they are, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Counter(dict):
    """Token counts of words, by the transducer where a word is new."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        raw = lambda s: bytes(map(chars.__getitem__, s))
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.special = sorted(special, key=len, reverse=True)
        self.transducer = WordTransducer(vocab, merges)

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = n = self.transducer.count(word.encode("utf-8"))
        return n


@cache
def _counter(path: str) -> _Counter:
    return _Counter(path)


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text; special strings count as the one token that the library makes of them."""
    import regex

    counter = _counter(path)
    special = regex.compile("|".join(map(regex.escape, counter.special))) if counter.special else None
    totals = [0] * len(texts)
    pieces, owner, held = [], [], 0

    def flush() -> None:
        nonlocal pieces, owner, held
        if not pieces:
            return
        big = "\0".join(pieces) + "\0"
        lengths = np.fromiter(map(len, pieces), np.int64, count=len(pieces))
        stops = np.cumsum(lengths + 1) - 1
        classes = _classes(np.frombuffer(big.encode("utf-32-le"), np.uint32))
        classes[stops] = END
        starts = word_starts(classes)
        piece = np.searchsorted(stops, starts)
        ends = np.minimum(np.append(starts[1:], len(big)), stops[piece])
        words = [big[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
        counts = np.fromiter(map(counter.__getitem__, words), np.int64, count=len(words))
        sums = np.bincount(piece, weights=counts, minlength=len(pieces)).astype(np.int64)
        for k, n in zip(owner, sums.tolist()):
            totals[k] += n
        pieces, owner, held = [], [], 0

    for k, t in enumerate(texts):
        parts = [t] if t else []
        if t and special and special.search(t):
            totals[k] += len(special.findall(t))
            parts = [p for p in special.split(t) if p]
        for p in parts:
            pieces.append(p)
            owner.append(k)
            held += len(p)
        if held >= SPAN:
            flush()
    flush()
    return totals


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens`` for each row, over its whole text.

    ``path`` is a byte-level BPE file (tokenizers' JSON) that each worker can read. Texts are cut into chunks
    of characters; each chunk yields the map from the state before it to the state after it, and a
    prefix scan over these maps gives all chunks their entry states, so that very long texts have no serial pass.
    Null and empty texts have no token. Repeated rows and rows without an id each come out; other columns are left aside; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": count_tokens(b["text"].tolist(), path)})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "id long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the 50k byte-level vocabulary. Null texts count as empty; each row comes out, whatever its id; other columns are left aside."""
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
