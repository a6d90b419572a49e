"""The exact search of substring dedup: numbered once a pair, counted by tables."""

import random

import numpy as np
import pytest

from plumbline.llm import substring_dedup


def test_a_pair_is_numbered_once(monkeypatch):
    """Pieces that both hold in other orders, dense but nowhere similar: each comparison of two passages sorted both again."""
    rng = random.Random(6)
    pieces = [list(range(100 * k, 100 * k + 12)) for k in range(40)]
    a = np.array([x for p in pieces for x in [*p, -p[0] - 1, -p[0] - 2]])
    b = np.array([x for p in rng.sample(pieces, 40) for x in [*p, -p[0] - 50, -p[0] - 51]])
    places = np.array([(i, int(np.flatnonzero(b == a[i])[0])) for i in range(0, len(a), 14)]).T
    calls = []
    for name in ("unique", "isin", "intersect1d"):
        monkeypatch.setattr(np, name, lambda *x, f=getattr(np, name), **y: calls.append(len(x[0])) or f(*x, **y))
    assert substring_dedup.chained_passages(a, b, 46, *places) == []
    assert calls == [len(a) + len(b)]


@pytest.mark.parametrize("cells", [1, 100, 1 << 20])
@pytest.mark.parametrize("kinds", [6, 40, 10**9])
def test_distinct_shingles_equal_sets(monkeypatch, cells, kinds):
    monkeypatch.setattr(substring_dedup, "CELLS", cells)
    rng = random.Random(kinds)
    for _ in range(40):
        v = np.array([rng.randrange(kinds) for _ in range(rng.randrange(1, 60))])
        held = {x for x in v.tolist() if rng.random() < 0.7} | {int(v[0])}
        shared = np.isin(v, [*held])
        starts, ends = substring_dedup._runs(shared)
        size, both = substring_dedup._distinct(substring_dedup._earlier(v), shared, starts, ends)
        for i, s in enumerate(starts.tolist()):
            for k, e in enumerate(ends.tolist()):
                if e > s:
                    assert (size[i, k], both[i, k]) == (len(set(v[s:e].tolist())), len(set(v[s:e].tolist()) & held))


def test_chains_of_many_runs_equal_a_plain_search():
    """More runs than a chain may join, so that they are gone through in several tables."""
    rng = random.Random(4)
    for n in (3, 63, 64, 65, 130, 300):
        a, b = [], []
        for k in range(n):
            run = [1000 * k + x for x in range(rng.randrange(3, 12))]
            a += run + [-(10**6) - 10 * k - x for x in range(rng.randrange(3))]
            b += run + [-(10**7) - 10 * k - x for x in range(rng.randrange(3))]
        a, b = np.array(a), np.array(b)
        first = int(np.flatnonzero(np.isin(b, a))[0])
        got = substring_dedup.chained_passages(a, b, 46, np.array([int(np.flatnonzero(a == b[first])[0])]), np.array([first]))
        assert all(len({*a[x:y]} & {*b[s:e]}) >= 0.8 * len({*a[x:y]} | {*b[s:e]}) and min(y - x, e - s) >= 46 for x, y, s, e in got)
        for (_, y, _, e), (u, _, v, _) in zip(got, got[1:]):
            assert u < y or v < e or y <= u and e <= v
