"""Passages, links and pieces that earlier versions lost."""

import random

import numpy as np
import pytest

from plumbline.llm import bpe_codec, substring_dedup

LEAST = substring_dedup.PASSAGE - substring_dedup.SHINGLE + 1


def passage(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]


def edits(rng, words, kind):
    at = len(words) // 2
    return words[:at] + {"changed": ["other"], "inserted": ["two", "more"], "dropped": []}[kind] + words[at + (kind != "inserted") :]


@pytest.mark.parametrize("size", [52, 60, 80, 89])
@pytest.mark.parametrize("kind", ["changed", "inserted", "dropped"])
def test_an_edit_in_the_middle_is_bridged(size, kind):
    rng = random.Random(size)
    words = passage(rng, size)
    a = substring_dedup.shingle_hashes(" ".join(passage(rng, 40) + words + passage(rng, 60)))
    b = substring_dedup.shingle_hashes(" ".join(passage(rng, 25) + edits(rng, words, kind) + passage(rng, 30)))
    for x, y in ((a, b), (b, a)):
        found = substring_dedup.matching_passages(x, y, LEAST)
        assert found and all(substring_dedup._alike(x[s:e], y[u:v]) and min(e - s, v - u) >= LEAST for s, e, u, v in found)
        shared = np.isin(y, x)
        assert all(any(u <= p < v for *_, u, v in found) for p in np.flatnonzero(shared))


def test_a_long_exact_run_does_not_hide_an_edited_copy():
    rng = random.Random(3)
    words = passage(rng, 70)
    a = substring_dedup.shingle_hashes(" ".join(words + passage(rng, 50) + edits(rng, words, "changed")))
    b = substring_dedup.shingle_hashes(" ".join(passage(rng, 30) + words))
    found = substring_dedup.matching_passages(a, b, LEAST)
    assert {s for s, *_ in found} >= {0, 120}


def test_passages_agree_with_brute_force():
    rng = random.Random(8)
    hits = 0
    for _ in range(120):
        source = [rng.randrange(10**6) for _ in range(16)]
        copy = list(source)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(3, 13)
            copy[at : at + rng.randrange(2)] = [rng.randrange(10**6) for _ in range(rng.randrange(3))]
        a, b = [-1, -2, *source, -3], [-4, *copy, -5, -6]
        got = substring_dedup.matching_passages(np.array(a), np.array(b), 10)
        tight = [p for p in range(len(b)) if b[p] in set(a)]
        tight_a = [p for p in range(len(a)) if a[p] in set(b)]
        want = any(
            5 * len(x & y) >= 4 * len(x | y)
            for i in tight_a for j in tight_a if j - i >= 9 for x in [set(a[i : j + 1])]
            for k in tight for m in tight if m - k >= 9 for y in [set(b[k : m + 1])]
        )
        hits += want
        assert bool(got) >= want
    assert hits > 20


def long_pieces():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    yield "letters", [letters(5_000)]
    yield "more letters", [letters(50_000)]
    yield "a rule", ["=" * 5_000 + "\n", "=" * 50_001]
    yield "padding", ["a" + " " * 5_000 + "b"]
    yield "unspaced", ["".join(rng.choices("日本語中文字漢語大小上下", k=4_000))]
    yield "cased", ["".join(rng.choices("ABCxyz", k=5_000))]
    yield "many of 60 bytes", [" ".join(letters(60) for _ in range(1_600))]
    yield "many of 300 bytes", [" ".join(letters(300) for _ in range(400))]


@pytest.mark.parametrize("name, texts", list(long_pieces()), ids=[k for k, _ in long_pieces()])
def test_long_pieces_match_the_library(name, texts):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = public_tokenizers.path(bpe_codec.VOCABULARY)
    lib = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    c = bpe_codec.Codec(path, public_tokenizers.PATTERN)
    ids = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [lib.encode_ordinary(t) for t in texts]
    assert c.decode(ids) == [t.encode() for t in texts]


def test_heap_and_query_agree():
    import public_tokenizers

    c = bpe_codec.Codec(public_tokenizers.path(bpe_codec.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(12)
    words = ["".join(rng.choices("aabcdeinst=. é日", k=rng.randrange(2, 90))).encode() for _ in range(300)]
    assert c._contract(words) == [c._contract_long(w) for w in words]


def spans_of(spark, docs):
    return {r["id"]: r for r in substring_dedup.substring_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()}


def test_staggered_quotations_are_all_linked(spark):
    rng = random.Random(21)
    docs, want = [], {}
    for k in range(60):
        source = passage(rng, 70)
        for n, (s, e) in enumerate(((0, 60), (0, 70), (20, 70))):
            docs.append((10 * k + n, passage(rng, 60) + source[s:e] + passage(rng, 60)))
            want[10 * k + n] = 10 * k
    got = spans_of(spark, docs)
    words = dict(docs)
    hashes = {i: substring_dedup.shingle_hashes(" ".join(w)) for i, w in docs}
    for i in want:  # all pairs by brute force
        assert any(substring_dedup.matching_passages(hashes[i], hashes[j], LEAST) for j in range(i - i % 10, i - i % 10 + 3) if j != i)
    assert {i: got[i]["class_id"] for i in want} == want
    assert all(got[10 * k + 2]["spans"] and [words[10 * k + 2][s["start"] : s["end"]] for s in got[10 * k + 2]["spans"]] == [words[10 * k + 2][60:110]] for k in range(60))


def test_near_passages_are_candidates(spark):
    """At a similarity of 0.804, the least that one changed word in 50 leaves; three hash functions missed 1 in 30."""
    rng = random.Random(22)
    docs = []
    for k in range(400):
        words = passage(rng, 50)
        docs += [(10 * k, passage(rng, 60) + words + passage(rng, 60)), (10 * k + 1, passage(rng, 60) + edits(rng, words, "changed") + passage(rng, 60))]
    got = spans_of(spark, docs)
    assert sum(got[10 * k + 1]["class_id"] == 10 * k for k in range(400)) >= 398


@pytest.mark.parametrize("moved", [False, True])
def test_chains_agree_with_brute_force(moved):
    """Pairs with edits, and with parts moved or repeated, against all pairs of passages whose ends the other one holds."""
    rng = random.Random(18 + moved)
    hits = 0
    for _ in range(150):
        source = [rng.randrange(10**6) for _ in range(18)]
        copy = list(source)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(2, 15)
            copy[at : at + rng.randrange(2)] = [rng.randrange(10**6) for _ in range(rng.randrange(3))]
        if moved:
            at = rng.randrange(4, 14)
            copy = copy[at:] + copy[:at] if rng.random() < 0.5 else copy[:at] + copy[at - 3 :]
        a, b = np.array([-1, -2, *source, -3]), np.array([-4, *copy, -5, -6])
        tight, tight_a = np.flatnonzero(np.isin(b, a)).tolist(), np.flatnonzero(np.isin(a, b)).tolist()
        if not tight:
            continue
        ca = np.array([int(np.flatnonzero(a == b[p])[0]) for p in tight])
        got = substring_dedup.chained_passages(a, b, 10, ca, np.array(tight))
        alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
        ends = lambda i, j, k, m, x, y: a[i] in y and a[j] in y and b[k] in x and b[m] in x  # noqa: B023, E731
        assert all(alike(set(a[i:j].tolist()), set(b[k:m].tolist())) and min(j - i, m - k) >= 10 for i, j, k, m in got)
        want = any(
            alike(x, y) and ends(i, j, k, m, x, y)
            for i in tight_a for j in tight_a if j - i >= 9 for x in [set(a[i : j + 1].tolist())]
            for k in tight for m in tight if m - k >= 9 for y in [set(b[k : m + 1].tolist())]
        )
        hits += want
        assert bool(got) >= want
    assert hits > 20


def test_a_chain_does_not_hide_a_moved_passage():
    """A pair that one chain links, with further passages whose parts are moved, one of them longer than a neighbourhood."""
    for size in (46, 80, 600):
        whole = np.arange(10_000, 10_000 + size)
        a = np.concatenate([np.arange(100, 180), np.arange(1000, 1300), whole, np.arange(2000, 2050)])
        b = np.concatenate([np.arange(3000, 3050), whole[size // 2 :], whole[: size // 2], np.arange(4000, 4300), np.arange(100, 180)])
        places = [(i, int(np.flatnonzero(b == a[i])[0])) for i in range(0, len(a), 15) if a[i] in b]
        got = substring_dedup.chained_passages(a, b, 46, *np.array(places).T)
        held_a = {w for x, y, _, _ in got for w in a[x:y].tolist()}
        held_b = {w for _, _, s, e in got for w in b[s:e].tolist()}
        assert held_a & held_b >= {*range(100, 180), *whole.tolist()}
        assert all(len({*a[x:y]} & {*b[s:e]}) >= 0.8 * len({*a[x:y]} | {*b[s:e]}) for x, y, s, e in got)


def test_sparse_windows_equal_all_minima():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, least = int(rng.integers(1, 200)), int(rng.integers(2, 40))
        v = rng.integers(0, int(rng.choice([4, 60, 10**9])), n).astype(np.uint64)
        got = set(substring_dedup.compact_windows(v, least))
        want, todo = set(), [(0, n)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo >= least:
                places = lo + np.flatnonzero(v[lo:hi] == v[lo:hi].min())
                want.add((lo, int(places[0]), hi - 1))
                ends = [lo - 1, *places.tolist(), hi]
                todo += [(p + 1, q) for p, q in zip(ends, ends[1:])]
        assert got == want
