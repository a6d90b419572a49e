"""Blends, stackers, grids and upserts against brute force on small tables."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL, same_rows

from plumbline.operators import audit as A
from plumbline.operators import ensemble as I
from plumbline.operators import features as K
from plumbline.operators.graph import connected_components
from plumbline.plans import catalog
from plumbline.streaming import metrics as S

ARMS = ["p", "q", "r", "s"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    rows = []
    for e, n in (("A", 40), ("B", 200)):
        y = rng.normal(size=n)
        arms = {"p": y * 0.7 + rng.normal(size=n) * 0.8, "q": y + rng.normal(size=n), "r": rng.normal(size=n) - 0.3, "s": (y if e == "A" else -y) + rng.normal(size=n) * 0.4}
        rows.append(pd.DataFrame({"endpoint": e, "fold": np.arange(n) % 4, "unit_id": np.arange(n), "y_true": y, "conf_low": y - 0.1, "conf_high": y + 0.1, **arms}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def wide(spark, table):
    return spark.createDataFrame(table)


def st_rae(d, p):
    soft = lambda x: np.maximum(x - d["conf_high"], 0).sum() + np.maximum(d["conf_low"] - x, 0).sum()
    return soft(p) / soft(d["y_true"].mean())


def macro(d, members):
    return np.mean([st_rae(x, x[members].mean(axis=1)) for _, x in d.groupby("endpoint")])


def mae(d, members):
    return (d[members].mean(axis=1) - d["y_true"]).abs().mean()


def brute(loss, steps, replacement=True, arms=ARMS, start=0):
    chosen, best = [], np.inf
    if start > 1:
        chosen = sorted(arms, key=lambda a: loss([a]))[:start]
        best = loss(chosen)
        steps -= 1
    for _ in range(steps):
        score, arm = min(((loss([*chosen, a]), a) for a in arms if replacement or a not in chosen), default=(np.inf, None))
        if arm is None or best - score <= 1e-12:
            break
        chosen, best = [*chosen, arm], score
    return Counter(chosen), best


def counts(df):
    rows = df.collect()
    return Counter({r["arm"]: r["count"] for r in rows if r["count"]}), rows[0]["score"]


@pytest.mark.parametrize("replacement", [True, False])
def test_one_blend_for_all_endpoints_minds_their_mean(wide, table, replacement):
    got = counts(I.greedy_blend(wide.selectExpr("*", "'all' as g"), ["g"], ARMS, 9, metric="st_rae", macro="endpoint", replacement=replacement))
    want = brute(lambda m: macro(table, m), 9, replacement)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])
    pooled = brute(lambda m: mae(table, m), 9, replacement)
    assert not replacement or pooled[0] != want[0]  # pooling all rows would have chosen others


def test_greedy_blend_in_each_group(wide, table):
    got = I.greedy_blend(wide, ["endpoint"], ARMS, 7).toPandas()
    for e, d in table.groupby("endpoint"):
        want, score = brute(lambda m: mae(d, m), 7)  # noqa: B023
        mine = got[got["group"] == e]
        assert Counter({a: c for a, c in zip(mine["arm"], mine["count"]) if c}) == want and mine["score"].iloc[0] == pytest.approx(score)


@pytest.mark.parametrize("metric", ["mae", "st_rae"])
def test_nested_blend_scores_the_held_fold(wide, table, metric):
    got = {(r["group"], r["held"]): r for r in I.nested_blend(wide, ["endpoint"], ARMS, 4, 6, metric=metric).collect()}
    assert len(got) == 8
    loss = {"mae": lambda d, m: mae(d, m), "st_rae": lambda d, m: st_rae(d, d[m].mean(axis=1))}[metric]
    for e, d in table.groupby("endpoint"):
        sets = []
        for k in range(4):
            inner, outer = d[d["fold"] != k], d[d["fold"] == k]
            want, score = brute(lambda m: loss(inner, m), 6)  # noqa: B023
            r = got[e, k]
            assert r["inner_score"] == pytest.approx(score) and r["members"] == "+".join(sorted(want)) and r["held_score"] == pytest.approx(loss(outer, list(want.elements())))
            sets.append(r["members"])
        assert got[e, 0]["same_members"] == max(Counter(sets).values()) / 4


@pytest.mark.parametrize("start", [0, 2])
def test_bags_are_chosen_as_one_by_one(wide, table, start):
    got = {(r["group"], r["arm"]): r["weight"] for r in I.bagged_selection(wide, ["endpoint"], ARMS, 5, 0.75, 5, 3, start).collect()}
    rng = np.random.default_rng(3)
    own = [sorted(set(rng.choice(ARMS, 3, replace=False).tolist())) for _ in range(5)]
    for e, d in table.groupby("endpoint"):
        total = sum((brute(lambda m: mae(d, m), 5, arms=a, start=start)[0] for a in own), Counter())  # noqa: B023
        assert {a: w for (g, a), w in got.items() if g == e} == pytest.approx({a: n / total.total() for a, n in total.items()})
    with pytest.raises(ValueError):
        I.bagged_selection(wide, ["endpoint"], ARMS, start=9)


def test_active_set_equals_all_supports():
    rng = np.random.default_rng(4)
    for _ in range(60):
        k = int(rng.integers(1, 6))
        x = rng.normal(size=(30, k))
        y = x @ rng.normal(size=k) + rng.normal(size=30)
        g, b = x.T @ x / 30, x.T @ y / 30
        for simplex in (False, True):
            best = np.inf if simplex else 0.0
            for n in range(1, k + 1):
                for i in map(list, combinations(range(k), n)):
                    m, rhs = g[np.ix_(i, i)], b[i]
                    if simplex:
                        m, rhs = np.block([[m, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]]), np.append(rhs, 1)
                    w = np.linalg.solve(m, rhs)[:n]
                    if (w >= -1e-9).all():
                        best = min(best, w @ g[np.ix_(i, i)] @ w - 2 * b[i] @ w)
            w = I._nnls(g, b, simplex)
            assert (w >= 0).all() and (not simplex or w.sum() == pytest.approx(1)) and w @ g @ w - 2 * b @ w == pytest.approx(best, abs=1e-8)


def test_stacker_chooses_its_penalty_inside(wide, table):
    got = I.stack(wide, ARMS, "ridge").toPandas()
    for (e, k), mine in got.groupby(["endpoint", "fold"]):
        train = table[(table["endpoint"] == e) & (table["fold"] != k)]

        def fit(d, alpha):
            x, y = d[ARMS].to_numpy(), d["y_true"].to_numpy()
            x, y = x - x.mean(axis=0), y - y.mean()
            return np.linalg.solve(x.T @ x + alpha * np.eye(4), x.T @ y)

        def loss(alpha):
            out = 0
            for f in sorted(set(train["fold"])):
                w, v = fit(train[train["fold"] != f], alpha), train[train["fold"] == f]
                e_ = v["y_true"] - v[ARMS].to_numpy() @ w
                out += ((e_ - e_.mean()) ** 2).sum()
            return out

        alpha = min(I.ALPHAS, key=loss)
        assert mine["alpha"].iloc[0] == alpha
        assert mine.set_index("arm")["coef"][ARMS].to_numpy() == pytest.approx(fit(train, alpha))
    for kind in ("enet", "nnls", "nnridge", "simplex"):
        w = I.stack(wide, ARMS, kind).toPandas()
        assert len(w) == 2 * 4 * 4 and (kind == "enet" or (w["coef"] >= 0).all())


def test_grid_winner_ignores_the_held_fold(spark, table):
    d = table[table["endpoint"] == "B"]
    regs = [0.0, 0.5, 5.0]
    a = K.grid_landscape(spark.createDataFrame(d), ["p", "q", "s"], "y_true", 4, regs).toPandas()
    hurt = d.assign(y_true=d["y_true"].where(d["fold"] != 2, d["y_true"] * -3))
    b = K.grid_landscape(spark.createDataFrame(hurt), ["p", "q", "s"], "y_true", 4, regs).toPandas()
    one = lambda x: x[x["fold"] == 2].sort_values("reg")
    assert one(a)["inner_mae"].to_numpy() == pytest.approx(one(b)["inner_mae"].to_numpy()) and (one(a)["winner"].to_numpy() == one(b)["winner"].to_numpy()).all()
    assert not np.allclose(one(a)["mae"], one(b)["mae"]) and (a.groupby("fold")["winner"].sum() == 1).all()


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "old", 0), (2, "old", 0), (None, "old", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "b", 3), (2, "a", 5), (3, "c", 1), (3, "c", 1), (4, "x", 2), (4, "y", 2), (None, "n", 1)], "k int, v string, t int")
    got = {r["k"]: (r["v"], r["t"]) for r in A.upsert(old, new, ["k"], ["t"]).collect()}
    assert got == {1: ("old", 0), 2: ("a", 5), 3: ("c", 1), 4: ("y", 2), None: ("n", 1)}
    assert A.upsert(old, new, ["k"], ["t"]).count() == 5


def test_stream_upsert_goes_on_after_a_restart(spark, tmp_path):
    import uuid

    put = lambda rows, n: spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    name = uuid.uuid4().hex
    schema = "k int, t int, v string"
    put([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], 1)
    run = lambda: {r["k"]: r["v"] for r in S.run_upsert(S.file_stream(spark, str(tmp_path / "in*"), schema), ["k"], "append", ["t"], name).collect()}
    assert run() == {1: "c", 2: "z"}
    put([(2, 9, "new"), (3, 1, "more")], 2)
    assert run() == {1: "c", 2: "new", 3: "more"}
    assert run() == {1: "c", 2: "new", 3: "more"}


@pytest.mark.parametrize("samples", [3, 70])
def test_poisson_draws(spark, samples):
    from pyspark.sql import functions as F

    from plumbline.operators import resample as B

    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").alias("u"), (F.col("id") % 10).cast("double").alias("v"))
    got = B.poisson_bootstrap(df, ["g"], "u", F.col("v"), samples).toPandas()
    assert sorted(zip(got["g"], got["b"])) == [(g, b) for g in (0, 1) for b in range(samples)]
    assert got["mean"].nunique() == 2 * samples
    for g, d in got.groupby("g"):
        assert d["mean"].mean() == pytest.approx(4 + g, abs=0.15) and (samples < 9 or 0.03 < d["mean"].std() < 0.1)
    counts = spark.range(1 << 16).select(B._poisson(F.col("id")).alias("k")).groupBy("k").count().toPandas().set_index("k")["count"] / 65536
    assert counts[0] == pytest.approx(np.exp(-1), abs=1e-4) and counts[3] == pytest.approx(np.exp(-1) / 6, abs=1e-4) and (counts.index * counts).sum() == pytest.approx(1, abs=1e-3)


def test_components_with_a_hub_of_a_third_of_all_nodes(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(10_000, 10_400)] + [(k, 50_000) for k in range(20_000, 23_000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert len(got) == 3000 + 401 + 3001
    assert {got[k] for k in range(3000)} == {0} and {got[k] for k in range(10_000, 10_401)} == {10_000} and {got[k] for k in [*range(20_000, 23_000), 50_000]} == {20_000}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("name", ["bh", "holm", "coupled_groups", "shared_first_step", "shared_second_step", "greedy_first_step", "upsert", "weighted_blend", "stream_upsert"])
def test_twin(spark, oracle, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), oracle(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", ["shared_weights", "forward_set", "nested_blend", "bagged_selection", "stack_nnridge", "grid_landscape", "tabular_forest"])
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
