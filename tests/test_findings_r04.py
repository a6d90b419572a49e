"""Small cases of what the fourth review found."""

import numpy as np
import pytest

from conftest import SMALL, same_rows
from plumbline.operators import features, neighbours, similarity
from plumbline.plans import catalog
from plumbline.sources.storage import scratch


def test_best_offset_is_looked_for_everywhere(spark, oracle):
    """no offset, on a grid or between its points, has a lower error than the one that is returned."""
    best = catalog.QUERIES["offset_opt"](spark, SMALL).collect()
    sql = catalog.ORACLES["offset_opt"]
    p = sql[: sql.index(", z as (")]
    e = lambda o: f"sum(greatest(y_pred + ({o!r}) - conf_high, 0) + greatest(conf_low - y_pred - ({o!r}), 0))"
    off_grid = 0
    for r in best:
        s, q = r["by_st_rae"], r["by_r2"]
        rest = [round(-1 + 0.05 * k, 2) for k in range(41)] + [s - 0.002, s + 0.002]
        cols = [e(s), *map(e, rest), *[f"avg((y_pred + ({o!r}) - y_true) ** 2)" for o in (q, q - 0.002, q + 0.002)]]
        got = oracle(f"{p} select {', '.join(cols)} from p where arm = '{r['arm']}' and endpoint = '{r['endpoint']}'").fetchall()[0]
        assert got[0] <= min(got[1 : len(rest) + 1]) + 1e-3 and got[-3] < min(got[-2:])
        off_grid += got[0] < min(got[1:42]) - 1e-2
    assert len(best) == 12 and off_grid > 6  # the grid's best was worse


@pytest.mark.parametrize("name", ["nn_loo", "nn_size_matched", "nn_summary"])
def test_every_vector_is_a_query(spark, oracle, name):
    """All 500 vectors look for their neighbour, not each twentieth."""
    df = catalog.QUERIES[name](spark, SMALL)
    same_rows(df, oracle(catalog.ORACLES[name]))
    assert "% 20" not in catalog.ORACLES[name]
    assert df.count() == 500 if name == "nn_loo" else {r["n"] for r in df.collect()} == {500}


def test_neighbours_of_another_label(spark, monkeypatch):
    """one search finds the nearest of another label, over many cells of clusters, with copies of a vector under both labels."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(150, 5)), np.ones((40, 5)) + 0.01 * rng.normal(size=(40, 5)), np.ones((30, 5))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = [None if k % 17 == 0 else k % 3 for k in range(len(x))]
    df = spark.createDataFrame([(k, v.tolist(), y) for k, (v, y) in enumerate(zip(x, label))], "id long, v array<double>, label int")
    got = {r["q"]: r for r in neighbours.nearest(df, df, apart="label").collect()}
    assert set(got) == {k for k, y in enumerate(label) if y is not None}
    for k, r in got.items():
        others = [j for j, y in enumerate(label) if y is not None and y != label[k]]
        assert label[r["r"]] in {label[j] for j in others} and r["sim"] == pytest.approx(max(x[k] @ x[j] for j in others), abs=1e-12)


def test_shuffled_values_are_not_broadcast(spark):
    """a row for each part and trial comes from a small file, and went through the driver; sums of one row only may."""
    plan = catalog.QUERIES["permutation_null"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [t" not in plan and "BroadcastHashJoin [k" not in plan and "BroadcastHashJoin [_g" not in plan


@pytest.mark.parametrize("cell,rows", [(8192, 512), (20, 7)])
def test_all_pairs_of_sets_are_tallied(spark, monkeypatch, cell, rows):
    """pairs of any similarity count, those without a common token too; tokens that most sets have and rare ones; copies by their number."""
    for k, v in {"CELL": cell, "ROWS": rows, "COLS": 2 * rows, "ADDED": 1 << 22 if rows > 7 else 200, "MEET": 4}.items():
        monkeypatch.setattr(similarity, k, v)
    rng = np.random.default_rng(2)
    sets = [sorted({f"w{x}" for x in rng.integers(0, 300, rng.integers(1, 20))} | ({"all", "a b", "a", "b"} if k % 4 else set())) for k in range(150)] + [["q r"]] * 5 + [["q", "r"], ["q\\sr"], []]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>")
    want = {}
    for i, x in enumerate(sets[:-1]):
        for y in sets[i + 1 : -1]:
            s = len({*x} & {*y}) / len({*x} | {*y})
            want[s] = want.get(s, 0) + 1
    tally = similarity.jaccard_tally(df, "id", "t")
    assert {r["sim"]: r["pairs"] for r in tally.collect()} == want
    flat = [s for s, n in want.items() for _ in range(n)]
    got = similarity.tally_summary(tally, 16).first()
    assert got["n_pairs"] == len(flat) == 157 * 156 // 2 and got["mean"] == pytest.approx(np.mean(flat)) and got["middle"] == pytest.approx(np.median(flat))
    none = similarity.tally_summary(similarity.jaccard_tally(df.where("id > 157"), "id", "t")).first()
    assert tuple(none) == (0, None, None)


def test_summary_of_all_pairs(spark, oracle):
    """the query and its twin over every pair of documents."""
    df = catalog.QUERIES["jaccard_pairs"](spark, SMALL)
    same_rows(df, oracle(catalog.ORACLES["jaccard_pairs"]))
    n = oracle("select count(*) from documents where regexp_matches(lower(text), '[a-z]')").fetchall()[0][0]
    assert df.first()["n_pairs"] == n * (n - 1) // 2


def test_sets_are_compared_in_rounds(spark, monkeypatch):
    """lists meet and candidates are compared in rounds, whose sets are deleted; links and members are the same, for tokens with spaces too."""
    monkeypatch.setattr(similarity, "POSTINGS", 50)
    monkeypatch.setattr(similarity, "PAIRS", 5)
    monkeypatch.setattr(similarity, "FREQUENT", 9)
    rng = np.random.default_rng(4)
    sets = [sorted({f"x {v}" for v in rng.integers(0, 30, 12)}) for _ in range(40)]
    sets += [s[:-1] for s in sets[:20]] + sets[:5] + [["x", "3"], ["x 3"], ["x 3"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>")
    with scratch() as made:
        linked, members = similarity.jaccard_pairs(df, "id", "t", 0.6)
        rep = {r["id"]: r["rep"] for r in members.collect()}
        got = {(r["a"], r["b"]): r["common"] for r in linked.collect()}
        assert sum("paired-sets" in x._plumbline_path for x in made) > 1 < sum("set-pairs-met" in x._plumbline_path for x in made)
    assert rep == {k: sets.index(s) for k, s in enumerate(sets)}
    share = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    firsts = sorted(set(rep.values()))
    assert got == {(a, b): len({*sets[a]} & {*sets[b]}) for a in firsts for b in firsts if a < b and share(a, b) >= 0.6}


def test_pairs_come_in_rounds(spark, monkeypatch):
    """pairs of cells are worked on in rounds; pairs bring their values and meet no join."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "MEET", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = [None if k % 11 == 0 else float(k % 6) for k in range(120)]
    df = spark.createDataFrame([(k, v.tolist(), z) for k, (v, z) in enumerate(zip(x, y))], "id long, v array<double>, y double")
    with scratch() as made:
        pairs = neighbours.cosine_pairs(df, 0.3, "y")
        assert sum("near-pairs" in t._plumbline_path for t in made) > 2
        assert "Join" not in similarity.valued_cliffs(pairs, 3.0)._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["a"], r["b"]): (r["ya"], r["yb"]) for r in pairs.collect()}
    a, b = np.nonzero(np.triu(x @ x.T >= 0.3, 1))
    assert got == {(i, j): (y[i], y[j]) for i, j in zip(a.tolist(), b.tolist())}


def test_scaled_rows_are_not_computed_again(spark):
    """each pass over the scaled rows reads a written table; it aggregated them anew, and sorted columns without gaps for their medians."""
    df = spark.createDataFrame([(k, float(k), None if k == 3 else float(k * k)) for k in range(9)], "id long, a double, b double").groupBy("id").agg({"a": "avg", "b": "avg"}).toDF("id", "a", "b")
    out = features.impute_scale(df, "id", ["a", "b"])
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: (r["a"], r["b"]) for r in out.collect()}
    a, b = np.arange(9.0), np.arange(9.0) ** 2
    b[3] = np.median(np.delete(b, 3))
    for k in range(9):
        assert got[k] == pytest.approx(((a[k] - a.mean()) / a.std(ddof=1), (b[k] - b.mean()) / b.std(ddof=1)), abs=1e-12)
