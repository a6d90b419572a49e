"""Substring dedup with compact windows: Cartesian trees over min-hashes, interval joins across hash functions, verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import ascii_words, table
from plumbline.operators.graph import connected_components
from plumbline.sources.storage import materialise, release

SHINGLE = 5
#: Shortest passage in words; as shingles, the shortest subsequence that a compact window stands for.
PASSAGE = 50
SIMILARITY = 0.8
#: Hash functions, of which two must agree: a passage at a similarity of 0.8 has this with a probability of 0.998.
HASHES = 6
#: Runs of shared shingles that a chain may join, so edits that a passage of one chain may have; longer ones come in parts.
CHAIN = 64
#: Shingles on each side of a place that are searched at a time for moved or repeated parts, in shortest passages.
AROUND = 4
#: Words of a bin in the join of a document's intervals.
BIN = 64
#: Shingles whose windows are built together; a longer document goes alone.
CHUNK = 200_000
#: Cells of a table of starts and places that the exact search fills at a time.
CELLS = 1 << 20
_SEEDS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF for k in range(HASHES))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``shingle`` words (A-Z lower-cased); no shingle where there are fewer words.

    The words' XXH64 are chained by a multiplication a place and mixed, so each word is hashed once, not once a shingle.
    """
    from xxhash import xxh64_intdigest

    words = ascii_words(text)
    n = max(0, len(words) - shingle + 1)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, count=len(words))
    h = each[:n].copy()
    for k in range(1, shingle):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = (hashes ^ np.uint64(_SEEDS[k])) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _reach(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``width`` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = op(values[:-step], values[step:])
        done += step
    return values


def _lows(values: np.ndarray, least: int) -> np.ndarray:
    """Places that hold the minimum of some ``least`` values in a row: only these are centres, or part the ranges of others."""
    if len(values) < least:
        return np.empty(0, np.int64)
    pad = np.zeros(least - 1, np.uint64)
    highest = _reach(np.concatenate([pad, _reach(values, least, np.minimum), pad]), least, np.maximum)
    return np.flatnonzero(highest == values)


def _compact(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows of disjoint ascending ranges of ``values``: left ends, centres, right ends, by tree level."""
    where = _lows(values, least)
    values = np.append(values[where], np.uint64(0))  # a place for the last range's end
    out = [np.empty((3, 0), np.int64)]
    while True:
        keep = hi - lo >= least
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            return tuple(np.concatenate(out, axis=1))
        begin, end = np.searchsorted(where, lo), np.searchsorted(where, hi)
        size = end - begin
        start = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(begin - start, size)
        lowest = np.minimum.reduceat(values, np.stack([begin, end], axis=1).ravel())[::2]
        hit = np.flatnonzero(values[place] == np.repeat(lowest, size))
        at = where[place[hit]]
        first = np.searchsorted(hit, start)
        out.append(np.stack([lo, at[first], hi - 1]))
        last = np.append(first[1:], len(hit)) - 1
        ends = np.append(at[1:], 0)
        ends[last] = hi
        # Before each range's first minimum, and behind each minimum up to the next one or the range's end.
        lo, hi = np.insert(at + 1, first, lo), np.insert(ends, first, at[first])


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(l, c, r)``: every subsequence of at least ``least`` values within l..r and over c has its minimum at c.

    The windows are the nodes of the values' Cartesian tree that span enough values. Where a minimum repeats, the whole
    span comes out once, at its first place, and the parts between go on.
    """
    return list(zip(*(x.tolist() for x in _compact(values, np.array([0]), np.array([len(values)]), least))))


def _chunks(docs: list[int], texts: Iterable[str | None], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents' ids, lengths in shingles and joined shingle hashes, many short documents or one long one at a time."""
    ids, parts, held = [], [], 0
    for doc, text in zip(docs, texts):
        h = shingle_hashes(text)
        if len(h) >= least:
            ids.append(doc)
            parts.append(h)
            held += len(h)
        if held >= CHUNK:
            yield np.array(ids), np.array([len(p) for p in parts]), np.concatenate(parts)
            ids, parts, held = [], [], 0
    if ids:
        yield np.array(ids), np.array([len(p) for p in parts]), np.concatenate(parts)


def window_rows(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``key, doc, l, c, r`` for each compact window of each hash function (which the key's last three bits name)."""
    least = passage - SHINGLE + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, size, h in _chunks(b["doc"].tolist(), b["text"], least):
                end = np.cumsum(size)
                for k in range(HASHES):
                    v = _mixed(h, k)
                    l, c, r = _compact(v, end - size, end, least)
                    at = np.searchsorted(end, c, side="right")
                    base = (end - size)[at]
                    keys = v[c] & ~np.uint64(7) | np.uint64(k)
                    yield pd.DataFrame({"key": keys.view(np.int64), "doc": ids[at], "l": (l - base).astype(np.int32), "c": (c - base).astype(np.int32), "r": (r - base).astype(np.int32)})

    return docs.where("doc is not null").mapInPandas(run, "key long, doc long, l int, c int, r int")


def _best(shared: np.ndarray, lo: int, hi: int, least: int, penalty: int) -> Iterator[tuple[int, int]]:
    """Segments of ``shared`` in lo..hi with the highest sums, a shared shingle counting 1 and another ``-penalty``."""
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        sums = np.concatenate([[0], np.cumsum(np.where(shared[lo:hi], 1, -penalty))])
        end = int((sums - np.minimum.accumulate(sums)).argmax())
        start = int(sums[: end + 1].argmin())
        if end - start >= least:
            yield lo + start, lo + end
            todo += [(lo, lo + start), (lo + end, hi)]


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _dense(before: np.ndarray, shared: np.ndarray, least: int) -> bool:
    """Whether some ``least`` or more shingles of a text can be similar to some of another: four in five must be shared.

    Where the text repeats shingles this says nothing, as a set may be similar while most places aren't shared.
    """
    if len(shared) < least:
        return False
    if (before >= 0).any():
        return True
    sums = np.zeros(len(shared) + 1, np.int64)
    np.where(shared, 1, -4).cumsum(out=sums[1:])
    return bool((sums[least:] >= np.minimum.accumulate(sums[: len(shared) - least + 1])).any())


def matching_passages(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """``(a start, a end, b start, b end)`` of passages of ``least`` or more shingles at a Jaccard similarity of 0.8 or more.

    Segments that lack fewer than one shingle in nine have this similarity if the other side lacks no more; a segment for
    which that isn't so is cut at every shingle that it lacks. Where this leaves shared shingles of a side uncovered, the
    passages between the ends of its shared runs are compared exactly, so that edits in short passages are bridged as well.
    """
    out = []

    def add(s: int, e: int, penalty: int) -> bool:
        found = [(x, y) for x, y in _best(np.isin(a, b[s:e]), 0, len(a), least, penalty) if _alike(a[x:y], b[s:e])]
        out.extend((x, y, s, e) for x, y in found)
        return bool(found)

    pair = _Pair(a, b)
    shared = pair.shared()
    if not _dense(pair.before_b, shared, least):
        return []
    for s, e in _best(shared, 0, len(b), least, 8):
        if not add(s, e, 8):
            for x, y in _best(shared, s, e, least, len(b)):
                add(x, y, len(a))
    return out + _bridged(pair, least, out)


def _repeats(sorted_values: np.ndarray) -> bool:
    return bool((sorted_values[1:] == sorted_values[:-1]).any())


def _on_diagonals(at: np.ndarray, a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> None:
    """Where b agrees with a on a diagonal of the places given, that is a shingle's partner, on the most frequent one if on several."""
    diagonals, count = np.unique(ca - cb, return_counts=True)
    for d in diagonals[np.argsort(count, kind="stable")].tolist():
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        same = lo + np.flatnonzero(a[lo + d : hi + d] == b[lo:hi])
        at[same] = same + d


def chained_passages(a: np.ndarray, b: np.ndarray, least: int, ca: np.ndarray, cb: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Like :func:`matching_passages`, for the ranges of a pair in which places ``ca`` of a and ``cb`` of b are known to agree.

    The shared runs that stand in one order in both are chained, and each chain is measured exactly, from every run to every
    later one; the longest similar ones come out. Where parts are moved or repeat within a text, the neighbourhoods of all
    places that no passage so found holds are compared by :func:`matching_passages`' exact search.
    """
    if min(len(a), len(b)) < least:
        return []
    order = np.argsort(a, kind="stable")
    ordered = a[order]
    at = np.minimum(np.searchsorted(ordered, b), len(a) - 1)
    shared = ordered[at] == b
    at = np.where(shared, order[at], -1)
    sums = np.append(0, np.cumsum(np.where(shared, 1, -4)))
    dense = (sums[least:] >= np.minimum.accumulate(sums[: len(b) - least + 1])).any()
    repeats = _repeats(ordered) or _repeats(np.sort(b))
    if not dense and not repeats:
        return []
    if repeats:
        _on_diagonals(at, a, b, ca, cb)
    hit = at >= 0
    goes_on = hit[1:] & hit[:-1] & (at[1:] == at[:-1] + 1)
    bs = np.flatnonzero(hit & ~np.append(False, goes_on))
    be = np.flatnonzero(hit & ~np.append(goes_on, False)) + 1
    xs, xe = at[bs], at[be - 1] + 1
    n = len(bs)
    total, turns = np.zeros(n + 1, np.int64), np.zeros(max(n, 1), np.int64)
    (be - bs).cumsum(out=total[1:])
    (xs[1:] < xe[:-1]).cumsum(out=turns[1:])
    last = np.full(n, -1)
    for k in range(0, n, CHAIN):  # from each of CHAIN runs to each of the CHAIN runs that start with it
        p, q = slice(k, k + CHAIN), slice(k, k + 2 * CHAIN)
        la, lb = xe[q] - xs[p, None], be[q] - bs[p, None]
        both = total[1:][q] - total[:-1][p, None]
        good = (la >= least) & (lb >= least) & (both >= SIMILARITY * (la + lb - both)) & (turns[q] == turns[p, None])
        if n > CHAIN:
            ahead = np.arange(good.shape[1]) - np.arange(len(good))[:, None]
            good &= (ahead >= 0) & (ahead < CHAIN)
        last[p] = np.where(good.any(axis=1), k + good.shape[1] - 1 - good[:, ::-1].argmax(axis=1), -1)
    out, reach = [], -1
    for p in np.flatnonzero(last >= 0).tolist():
        if last[p] > reach:
            reach = int(last[p])
            out.append((int(xs[p]), int(xe[reach]), int(bs[p]), int(be[reach])))
    if repeats:
        out = [m for m in out if _alike(a[m[0] : m[1]], b[m[2] : m[3]])]
    elif not turns[-1] and n <= CHAIN:  # all is in one order, so nothing else can be similar
        return out
    return out + _around(a, b, least, sorted(set(zip(ca.tolist(), cb.tolist()))), out)


class _Pair:
    """Two documents' shingles as small numbers, with what the exact search asks of every neighbourhood: found once, cut for each."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        values, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.a, self.b = numbers[: len(a)], numbers[len(a) :]
        self.before_a, self.before_b = _earlier(self.a), _earlier(self.b)
        self.mark = np.zeros(len(values), bool)  # all False between calls

    def cut(self, x: int, y: int, s: int, e: int) -> _Pair:
        part = object.__new__(_Pair)
        part.a, part.b, part.mark = self.a[x:y], self.b[s:e], self.mark
        part.before_a, part.before_b = self.before_a[x:y] - x, self.before_b[s:e] - s  # below 0: not before within the part
        return part

    def turned(self) -> _Pair:
        part = object.__new__(_Pair)
        part.a, part.b, part.mark, part.before_a, part.before_b = self.b, self.a, self.mark, self.before_b, self.before_a
        return part

    def shared(self) -> np.ndarray:
        """Which places of b hold a shingle of a."""
        self.mark[self.a] = True
        out = self.mark[self.b]
        self.mark[self.a] = False
        return out


def _around(a: np.ndarray, b: np.ndarray, least: int, places: list[tuple[int, int]], found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Similar passages around the places that none of ``found`` holds, by the exact search in a neighbourhood of each.

    A place within a shortest passage of one that was searched is not searched again. Where a passage reaches the end of its
    neighbourhood, the place behind it is searched as well, so a longer passage comes in parts.
    """
    out: list[tuple[int, int, int, int]] = []
    searched: dict[tuple[int, int], tuple[int, int]] = {}  # at most one place a cell of the size of a shortest passage
    todo = places[::-1]
    pair = None
    while todo:
        i, k = todo.pop()
        cells = [(i // least + u, k // least + v) for u in (-1, 0, 1) for v in (-1, 0, 1)]
        near = [searched[c] for c in cells if c in searched]
        if any(abs(i - p) < least and abs(k - q) < least for p, q in near) or any(x <= i < y and s <= k < e for m in (found, out) for x, y, s, e in m):
            continue
        searched[i // least, k // least] = i, k
        x, s = max(0, i - AROUND * least), max(0, k - AROUND * least)
        y, e = min(len(a), i + AROUND * least), min(len(b), k + AROUND * least)
        pair = pair or _Pair(a, b)
        for c, d, f, g in _bridged(pair.cut(x, y, s, e), least, []):
            hit = x + c, x + d, s + f, s + g
            out.append(hit)
            if (hit[1] == y or hit[3] == e) and hit[1] < len(a) and hit[3] < len(b):
                todo.append((hit[1], hit[3]))
            if (hit[0] == x or hit[2] == s) and hit[0] and hit[2]:
                todo.append((hit[0] - 1, hit[2] - 1))
    return out


def _bridged(pair: _Pair, least: int, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Similar passages beyond ``found``, by exact comparison between the ends of shared runs of both sides."""
    turned = pair.turned()
    in_b, in_a = pair.shared(), turned.shared()
    if not _dense(pair.before_b, in_b, least) or not _dense(pair.before_a, in_a, least):
        return []
    out = [(x, y, s, e) for s, e, x, y in _edited(pair, in_b, least, [m[2:] for m in found])]
    return out + _edited(turned, in_a, least, [m[:2] for m in [*found, *out]])


def _runs(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(len(shared) + 2, bool)
    edge[1:-1] = shared
    step = (edge[1:] != edge[:-1]).nonzero()[0]
    return step[::2], step[1::2]


def _earlier(values: np.ndarray) -> np.ndarray:
    """The place before each at which its value last stood, or -1."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    out = np.full(len(values), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _distinct(before: np.ndarray, shared: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles from each start to each end (a row a start), and those of them that are shared."""
    both = np.zeros(len(shared) + 1, np.int64)
    shared.cumsum(out=both[1:])
    if (before < starts[0]).all():  # none repeats
        return ends - starts[:, None], both[ends] - both[starts][:, None]
    size = np.empty((2, len(starts), len(ends)), np.int64)
    rows = max(1, CELLS // len(shared))
    for k in range(0, len(starts), rows):
        s = starts[k : k + rows, None]
        new = (before < s) & (np.arange(len(shared)) >= s)
        size[0, k : k + rows] = new.cumsum(axis=1, dtype=np.int32)[:, ends - 1]
        size[1, k : k + rows] = (new & shared).cumsum(axis=1, dtype=np.int32)[:, ends - 1]
    return size[0], size[1]


def _edited(pair: _Pair, shared: np.ndarray, least: int, found: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """``(b start, b end, a start, a end)`` of similar passages whose part in b isn't within one of ``found``.

    From each start of a shared run, the ends of runs are tried from the farthest that leaves enough shingles shared.
    Distinct shingles are counted, so the similarity is exact.
    """
    open_ = shared.copy()
    for s, e in found:
        open_[s:e] = False
    if not open_.any():
        return []
    out, known = [], list(found)
    starts, ends = _runs(shared)
    size, both = _distinct(pair.before_b, shared, starts, ends)
    good = (ends - starts[:, None] >= least) & (both >= SIMILARITY * size)
    for k in good.any(axis=1).nonzero()[0].tolist():
        s = int(starts[k])
        for e in ends[good[k]][::-1].tolist():
            if any(x <= s and e <= y for x, y in known):
                break
            if hit := _partner(pair, s, e, least):
                out.append((s, e, *hit))
                known.append((s, e))
                break
    return out


def _partner(pair: _Pair, s: int, e: int, least: int) -> tuple[int, int] | None:
    """The passage of a that is most similar to b's from s to e, if it is similar enough."""
    passage = pair.b[s:e]
    pair.mark[passage] = True
    inside = pair.mark[pair.a]
    pair.mark[passage] = False
    starts, ends = _runs(inside)
    if not len(starts) or ends[-1] - starts[0] < least:
        return None
    n = int((pair.before_b[s:e] < s).sum())
    size, both = _distinct(pair.before_a, inside, starts, ends)
    union = size + n - both
    good = (ends - starts[:, None] >= least) & (both >= SIMILARITY * union)
    if not good.any():
        return None
    k, m = divmod(int(np.where(good, both / np.maximum(union, 1), 0).argmax()), len(ends))
    return int(starts[k]), int(ends[m])


_MATCHES = "a long, b long, bl int, br int, spans array<int>, key array<long>, c array<int>, open array<boolean>"


def _continuations(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of b's places for another leader, and the place that each belongs to.

    A key says how far b agrees with a to the right or left of a place, and with which shingle it then goes its own way.
    Documents that agree with each other beyond what they share with a have one of these keys in common.
    """
    keys, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in np.unique(ca - cb).tolist():
        lo, hi = max(0, -d), min(len(b), len(a) - d)  # where b has a partner on this diagonal
        differ = lo + np.flatnonzero(a[lo + d : hi + d] != b[lo:hi])
        here = np.flatnonzero(ca - cb == d)
        c = cb[here]
        where = np.searchsorted(differ, c)
        for side, way in ((1, np.append(differ, hi)[where]), (2, np.append(lo - 1, differ)[where])):
            own = (way >= 0) & (way < len(b))
            far, nxt = np.abs(way - c)[own].astype(np.uint64), b[way[own]].astype(np.uint32).astype(np.uint64)
            x = at[here[own]].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (far << np.uint64(2)) + np.uint64(side)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + nxt
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append((x ^ (x >> np.uint64(32))).view(np.int64))
            owner.append(here[own])
    return np.concatenate(keys), np.concatenate(owner)


def _verify(pairs: DataFrame, hashes: DataFrame, passage: int, onward: bool = True) -> DataFrame:
    """Passages of each pair's ranges, and keys under which its places go on, or, unless ``onward``, the places themselves.

    Each document's shingle hashes come once to its pairs as b, cut there to the range in question, and then meet a's.
    """
    least = passage - SHINGLE + 1
    fields = ["a", "b", "al", "bl", "br", "at", "ca", "cb", "a_open", "b_open", "more"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, al, b, bl, at, ca, cb, a_open, b_open, more in zip(*(batch[c] for c in ("ah", "al", "bh", "bl", "at", "ca", "cb", "a_open", "b_open", "more"))):
                a, b, at, ca, cb, b_open = np.asarray(a), np.asarray(b), np.asarray(at), np.asarray(ca) - al, np.asarray(cb) - bl, np.asarray(b_open, bool)
                tried = np.asarray(a_open, bool) | b_open
                found = chained_passages(a, b, least, ca[tried], cb[tried]) if tried.any() else []
                left = b_open.copy()
                for x, y, s, e in found:
                    left &= ~((x <= ca) & (ca < y) & (s <= cb) & (cb < e))
                if onward:
                    here = np.flatnonzero(more)  # elsewhere no third document is left
                    key, owner = _continuations(a, b, ca[here], cb[here], at[here])
                    owner = here[owner]
                else:
                    key, owner = at, np.arange(len(at))
                spans = (np.array(found, np.int32).reshape(-1, 4) + (al, al + SHINGLE - 1, bl, bl + SHINGLE - 1)).astype(np.int32).ravel()
                rows.append((spans, key, (cb + bl)[owner].astype(np.int32), left[owner]))
            yield pd.concat([batch[["a", "b", "bl", "br"]].reset_index(drop=True), pd.DataFrame(rows, columns=["spans", "key", "c", "open"])], axis=1)

    cut = lambda p: F.slice("hashes", F.col(f"{p}l") - F.col("lo") + 1, F.col(f"{p}r") - F.col(f"{p}l") + 1).alias(f"{p}h")
    of_b = pairs.join(hashes.withColumnRenamed("doc", "b"), "b").select(*pairs.columns, cut("b"))
    both = of_b.join(hashes.withColumnRenamed("doc", "a"), "a").select(*fields, "bh", cut("a"))
    return both.mapInPandas(run, _MATCHES)


def _hash_rows(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``doc, lo, hashes``: each text's shingle hashes from the first to the last of its windows in ``hits``.

    They are cut to 32 bits: what is compared is a pair of ranges, not the corpus, and a chance agreement there counts
    as one shingle at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [(shingle_hashes(t)[x : y + 1] >> np.uint64(32)).astype(np.uint32).view(np.int32) for t, x, y in zip(b["text"], b["lo"], b["hi"])]
            yield pd.DataFrame({"doc": b["doc"], "lo": b["lo"], "hashes": cut})

    ranges = hits.groupBy("doc").agg(F.min("l").alias("lo"), F.max("r").alias("hi"))
    return docs.join(ranges, "doc").select("doc", "text", "lo", "hi").mapInPandas(run, "doc long, lo int, hashes array<int>")


def _shared(rows: DataFrame, label: str) -> DataFrame:
    """The rows whose key stands in two or more documents."""
    keys = materialise(rows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key"), "shared-keys")
    out = materialise(rows.join(keys.hint("shuffle_hash"), "key"), label)  # one row a key: the long side needs no sort
    release(keys)
    return out


def _copies(docs: DataFrame) -> DataFrame:
    """``doc, rep``: documents whose whole text is another's, with the smallest of them."""
    ids = docs.where("doc is not null and text is not null").select("doc", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second half"), "text").alias("t2"))
    ids = materialise(ids, "text-hashes")
    reps = materialise(ids.groupBy("t1", "t2").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep < last").drop("last"), "text-firsts")
    return ids.join(reps, ["t1", "t2"]).where("doc <> rep").select("doc", "rep").distinct()


def agreeing_windows(hits: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``key, at, doc, l, c, r, open``: an interval join of each document's windows across hash functions.

    Two windows of different hash functions come out where their intervals share enough shingles for a passage
    and each holds the other's centre: just then a passage exists whose minima both are. ``key`` stands for both min-hashes,
    so documents with a key in common agree on two hash functions over overlapping intervals; ``at`` is the first one's, at
    place c. The join goes by (document, bin), a window's bins against the bin of the other's centre. Open is what has an open window.
    """
    own = [F.col(c) for c in ("doc", "key", "l", "c", "r", "open")]
    wide = hits.select(*own, F.explode(F.sequence(F.floor(F.col("l") / BIN), F.floor(F.col("r") / BIN))).alias("bin"))
    other = hits.select("doc", *[c.alias(f"{n}2") for n, c in zip(("key", "l", "c", "r", "open"), own[1:])], F.floor(F.col("c") / BIN).alias("bin"))
    both = (F.col("key").bitwiseAND(7) < F.col("key2").bitwiseAND(7)) & F.col("c").between(F.col("l2"), F.col("r2")) & F.col("c2").between(F.col("l"), F.col("r"))
    enough = F.least("r", "r2") - F.greatest("l", "l2") >= passage - SHINGLE
    joined = wide.join(other, ["doc", "bin"]).where(both & enough)
    return joined.select(F.xxhash64("key", "key2").alias("key"), F.col("key").alias("at"), "doc", F.greatest("l", "l2").alias("l"), "c", F.least("r", "r2").alias("r"), (F.col("open") | F.col("open2")).alias("open"))


def _led(rows: DataFrame, lead: DataFrame) -> DataFrame:
    """Each row of another document than its key's leader, beside the leader's place."""
    return rows.join(lead.hint("shuffle_hash"), "key").where("doc <> a")


def _pairs(led: DataFrame, place: list[Column]) -> DataFrame:
    """Leader a and document b with the range that their places span in each, and the places."""
    return led.groupBy("a", F.col("doc").alias("b")).agg(
        F.min("a_l").alias("al"), F.max("a_r").alias("ar"), F.min("l").alias("bl"), F.max("r").alias("br"), F.collect_set(F.struct(*place)).alias("places")
    )


def _found(verified: DataFrame) -> DataFrame:
    """``a, b, spans`` of the pairs that match."""
    four = F.transform(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(4)), lambda i: F.struct(*[F.get("spans", i + k).alias(c) for k, c in enumerate(("a_start", "a_end", "b_start", "b_end"))]))
    return verified.where(F.size("spans") > 0).select("a", "b", four.alias("spans"))


def _columns(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "al", "ar", "bl", "br", *[F.col(f"places.{x}").alias(x) for x in ("at", "ca", "cb", "a_open", "b_open", "more")])


def _agree(places: Column, passage: int) -> Column:
    """Whether windows of two hash functions meet in both documents: over enough shingles, each with the other's centre."""

    def meet(x: Column, y: Column) -> Column:
        sides = (x["at"].bitwiseAND(7) < y["at"].bitwiseAND(7),)
        for l, c, r in (("a_l", "ca", "a_r"), ("l", "cb", "r")):
            sides += (x[c].between(y[l], y[r]), y[c].between(x[l], x[r]), F.least(x[r], y[r]) - F.greatest(x[l], y[l]) >= passage - SHINGLE)
        return reduce(Column.__and__, sides)

    return F.exists(places, lambda x: F.exists(places, lambda y: meet(x, y)))


def _first_leaders(hits: DataFrame, hashes: DataFrame, passage: int) -> tuple[DataFrame, DataFrame]:
    """Passages shared with the leaders of single min-hashes, and the windows whose min-hash has an open place afterwards."""
    lead = hits.groupBy("key").agg(F.min(F.struct("doc", "c", "l", "r")).alias("a"))
    lead = materialise(lead.select("key", F.col("a.doc").alias("a"), *[F.col(f"a.{x}").alias(f"a_{x}") for x in ("c", "l", "r")]), "leaders")
    led = _led(hits, lead)
    yes = F.lit(True)
    place = [F.col("key").alias("at"), F.col("a_c").alias("ca"), F.col("c").alias("cb"), "a_l", "a_r", "l", "r", yes.alias("a_open"), yes.alias("b_open"), yes.alias("more")]
    pairs = _pairs(led, place).where(_agree(F.col("places"), passage))
    found = materialise(_verify(_columns(pairs), hashes, passage, False), "verified")
    places = found.select(F.col("b").alias("doc"), F.explode(F.arrays_zip("key", "c", "open")).alias("n"))
    covered = materialise(places.where("not n.open").select("doc", "n.key", "n.c").distinct(), "covered")
    still = materialise(led.select("key", "doc", "c").distinct().join(covered, ["key", "doc", "c"], "left_anti").withColumn("open", F.lit(True)), "uncovered")
    release(covered)
    keys = materialise(still.select("key").distinct(), "open-keys")
    rest = hits.join(keys, "key").join(still, ["key", "doc", "c"], "left").select("key", "doc", "l", "c", "r", F.coalesce("open", F.lit(False)).alias("open"))
    rest = materialise(rest, "open-windows")
    for t in (lead, still, keys):
        release(t)
    return _found(found), rest


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """``a, b, spans``: verified near-duplicate passages of document b in document a (word ranges).

    1. Each text's compact windows of six hash functions become rows of (min-hash, document, interval). Min-hashes of one
       document only drop out. Whole texts that repeat are linked to the smallest of them, which goes on for all.
    2. Each min-hash links its documents to one leader (the smallest), not to each other. Pairs in which two hash functions'
       intervals meet in both documents are compared shingle by shingle; the windows that a match covers are done.
    3. Min-hashes with a window left go on with all their windows. An interval join within each document finds the places at
       which two hash functions agree; each pair of min-hashes has its own leader and is compared in the same way.
    4. Places that no match covers are open and go on to another leader among those that continue alike where they part from
       the first one, until none of three or more is left: a line that very many documents share, but no passage, ends after a
       round or two. Covered places go on with them as long as an open one continues alike, as it may share a passage with a
       document that the leader has matched already.

    Leaders come from aggregations with map-side minima, members from joins that AQE may split: a passage that a third
    of all documents share makes one link a document and no hot task.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    windows = materialise(window_rows(own, passage), "windows")
    hits = _shared(windows, "window-hits")
    release(windows)
    copies = materialise(_copies(own), "copies")
    whole = materialise(hits.join(copies, "doc").groupBy(F.col("rep").alias("a"), F.col("doc").alias("b")).agg((F.max("r") + SHINGLE).alias("n")), "whole-copies")
    spans = F.array(F.struct(F.lit(0).alias("a_start"), F.col("n").alias("a_end"), F.lit(0).alias("b_start"), F.col("n").alias("b_end")))
    rounds = [whole.select("a", "b", spans.alias("spans"))]
    single = _shared(hits.join(copies.select("doc"), "doc", "left_anti"), "single-hits")
    release(hits)
    hashes = materialise(_hash_rows(own, single), "shingle-hashes")
    first, rest = _first_leaders(single, hashes, passage)
    rounds.append(first)
    release(single)
    todo = materialise(agreeing_windows(rest, passage), "agreeing-windows")
    release(rest)
    while True:
        wider, hashes = hashes, materialise(hashes.join(todo.select("doc").distinct(), "doc", "left_semi"), "open-hashes")
        release(wider)
        lead = todo.groupBy("key").agg(F.min(F.struct("doc", "c", "l", "r", "open")).alias("a"), F.max("doc").alias("last"), F.bool_or("open").alias("any"), F.count(F.lit(1)).alias("n")).where("a.doc < last and any")
        lead = materialise(lead.select("key", F.col("a.doc").alias("a"), *[F.col(f"a.{x}").alias(f"a_{x}") for x in ("c", "l", "r", "open")], (F.col("n") > 2).alias("more")), "leaders")
        if lead.isEmpty():
            break
        place = ["at", F.col("a_c").alias("ca"), F.col("c").alias("cb"), "a_open", F.col("open").alias("b_open"), "more"]
        found = materialise(_verify(_columns(_pairs(_led(todo, lead), place)), hashes, passage), "verified")
        release(todo)
        release(lead)
        rounds.append(_found(found))
        going = (
            found.select(F.col("b").alias("doc"), "bl", "br", F.explode(F.arrays_zip("key", "c", "open")).alias("n"))
            .groupBy("n.key", "doc", "n.c").agg(F.min("bl").alias("l"), F.max("br").alias("r"), F.bool_or("n.open").alias("open"))
            .withColumn("at", F.col("key"))
        )
        going = materialise(going, "going")
        keys = materialise(going.where("open").select("key").distinct(), "open-keys")
        todo = materialise(going.join(keys.hint("shuffle_hash"), "key"), "open")
        release(going)
        release(keys)
    for t in (todo, lead, hashes):
        release(t)
    out = _empty(docs, "a long, b long, spans array<struct<a_start:int,a_end:int,b_start:int,b_end:int>>")
    for r in rounds:
        out = out.unionByName(r)
    return out


def _empty(docs: DataFrame, schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([], schema)


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """One row for each row of ``docs``: ``id, class_id, n_links, n_spans, n_dup_words, spans``.

    ``spans`` are the word ranges ``struct<start, end>`` that another document repeats (end left out), overlapping
    ones joined; ``class_id`` is the smallest id reachable over verified links, the own id where there is none; ``n_links``
    counts the own links to leaders and from members. Null, empty and short texts have no span. Rows that repeat an id
    are one document and each get its result; rows without an id have null and no span. An empty table gives an
    empty result.
    """
    found = materialise(repeated_passages(docs, id_col, text_col, passage), "passages")
    flat = found.select("a", "b", F.explode("spans").alias("s"))
    sides = flat.select(F.col("a").alias("id"), F.struct(F.col("s.a_start").alias("start"), F.col("s.a_end").alias("end")).alias("s")).union(
        flat.select(F.col("b").alias("id"), F.struct(F.col("s.b_start").alias("start"), F.col("s.b_end").alias("end")).alias("s"))
    ).distinct()
    place = Window.partitionBy("id").orderBy("s.start", "s.end")
    reach = F.max("s.end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    grouped = sides.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("s.start")).cast("int")).withColumn("g", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("id", "g").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    spans = merged.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("words"))
    links = found.select("a", "b").distinct()
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    comp = connected_components(links, "a", "b")
    per_doc = spans.join(degree, "id").join(comp, spans["id"] == comp["node"]).select(F.col("id").alias("_id"), "spans", "words", "n", "component")
    own = docs.select(F.col(id_col).cast("long").alias("id"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return own.join(per_doc, own["id"] == per_doc["_id"], "left").select(
        "id",
        F.coalesce("component", "id").alias("class_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("words", F.lit(0)).cast("long").alias("n_dup_words"),
        F.coalesce("spans", empty).alias("spans"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and repeated word ranges of all documents."""
    return substring_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
