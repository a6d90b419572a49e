"""Queries over whole tables, against NumPy and plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from conftest import SMALL

from plumbline.operators import compare as C
from plumbline.operators.graph import connected_components
from plumbline.plans import catalog
from plumbline.sources import fixtures as X


def adjusted(ps):
    """Benjamini-Hochberg and Holm by definition."""
    known = sorted(p for p in ps if p is not None)
    m, bh, up, step = len(known), {}, 1.0, 0.0
    for k in range(m, 0, -1):
        up = min(up, m * known[k - 1] / k)
        bh[known[k - 1]] = up
    holm = {}
    for k, p in enumerate(known):
        step = max(step, min(1.0, (m - k) * p))
        holm.setdefault(p, step)
    return bh, holm


@pytest.mark.parametrize("buckets", [2, 7])
def test_ranges_adjust_as_defined(spark, buckets):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), k, None if k % 9 == 0 else round(rng.random() ** 3, 2)) for k in range(600)]
    df = spark.createDataFrame(rows, "grp string, k long, p double")
    got = {(r["grp"], r["k"]): (r["p_bh"], r["p_holm"]) for r in C.holm(C.benjamini_hochberg(df, "p", keys=["grp"], buckets=buckets), "p", keys=["grp"], buckets=buckets).collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        bh, holm = adjusted([p for x, _, p in rows if x == g])
        for x, k, p in rows:
            if x == g:
                assert got[g, k] == ((None, None) if p is None else (pytest.approx(bh[p]), pytest.approx(holm[p])))


def test_every_order_is_adjusted(spark):
    groups = defaultdict(dict)
    for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect():
        k = r["o_orderkey"]
        groups[r["o_orderpriority"]][k] = None if k % 7 == 0 else round(int(hashlib.md5(str(k).encode()).hexdigest()[:7], 16) / 268435456, 6)
    for name, at, out in (("bh", 0, "p_bh"), ("holm", 1, "p_holm")):
        got = {(r["grp"], r["k"]): r[out] for r in catalog.QUERIES[name](spark, SMALL).collect()}
        assert len(got) == sum(map(len, groups.values())) and max(k for _, k in got) >= 200
        for g, ps in groups.items():
            want = adjusted(list(ps.values()))[at]
            assert all(got[g, k] == (None if p is None else pytest.approx(want[p], abs=2e-6)) for k, p in ps.items())


def union_find(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + k, 1001 + k) for k in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == union_find(edges)


def test_every_customer_and_supplier_has_a_component(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet").collect()
    edges = [(r["c_custkey"], r["c_nationkey"] + 10**12) for r in read("customer")] + [(r["s_suppkey"] + 2 * 10**12, r["s_nationkey"] + 10**12) for r in read("supplier")]
    got = catalog.QUERIES["coupled_groups"](spark, SMALL).collect()
    assert {r["node"]: r["component"] for r in got} == union_find(edges) and len(got) == len({x for e in edges for x in e})


def test_every_fold_and_repeat_has_its_draws(spark):
    groups = defaultdict(list)
    for r in X.oof(spark, SMALL).collect():
        groups[r["arm"], r["endpoint"], r["repeat_id"], r["fold"]].append(r)
    assert len({k[2:] for k in groups}) == 25
    key = lambda r: (r["arm"], r["endpoint"], r["repeat_id"], r["fold"])
    tau = {key(r): r for r in catalog.QUERIES["kendall"](spark, SMALL).collect()}
    scores = defaultdict(dict)
    for r in catalog.QUERIES["bootstrap_metrics"](spark, SMALL).collect():
        scores[key(r)][r["b"]] = r
    intervals = {key(r): r for r in catalog.QUERIES["bootstrap_ci"](spark, SMALL).collect()}
    ranks = {key(r): r for r in catalog.QUERIES["boot_spearman"](spark, SMALL).collect()}
    assert set(tau) == set(scores) == set(intervals) == set(ranks) == set(groups)
    for k, rows in groups.items():
        assert tau[k]["n"] == len(rows) and len(scores[k]) == 20 == intervals[k]["n"] == ranks[k]["n"] + ranks[k]["degenerate"]
    for k in random.Random(9).sample(sorted(groups), 20):
        rows = sorted(groups[k], key=lambda r: r["unit_id"])
        n = len(rows)
        for b, r in scores[k].items():
            slots = [int(hashlib.md5(":".join(map(str, (*k[1:], b, s))).encode()).hexdigest()[:7], 16) % n for s in range(n)]
            assert r["n"] == n and r["mae"] == pytest.approx(sum(abs(rows[i]["y_pred"] - rows[i]["y_true"]) for i in slots) / n, abs=2e-6)
