"""Distributed forms against the plain definitions that they replace, and values of the queries without SQL twins."""

from hashlib import md5
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from plumbline.operators import audit, compare, features, ranks, resample, similarity, splits
from plumbline.plans import catalog


def filled(sizes, k, repeat, largest_first):
    """Groups one after the other into the fold that holds least."""
    h = {g: md5(f"{g or ''}:{repeat}".encode()).hexdigest() for g in sizes}
    order = sorted(sizes, key=lambda g: (-sizes[g] if largest_first else 0, h[g]))
    load, fold = [0] * k, {}
    for g in order:
        fold[g] = load.index(min(load))
        load[fold[g]] += sizes[g]
    return fold


@pytest.mark.parametrize("largest_first", [True, False])
@pytest.mark.parametrize("k", [1, 3, 5])
def test_group_folds_are_those_of_the_walk(spark, largest_first, k):
    rng = np.random.default_rng(k)
    sizes = {f"g{i}": int(n) for i, n in enumerate([70, 31, 31, 9, *rng.integers(1, 8, 120)])} | {None: 5}
    units = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "grp string")
    got = splits.group_folds(units, "grp", k, 2, largest_first).toPandas()
    for repeat in range(2):
        one = got[got["repeat_id"] == repeat]
        assert dict(zip(one["g"].where(one["g"].notna(), None), one["fold"])) == filled(sizes, k, repeat, largest_first)
        assert dict(zip(one["g"].where(one["g"].notna(), None), one["n"])) == sizes
    assert splits.group_folds(units.limit(0), "grp", k, 2, largest_first).count() == 0


def test_turns_by_counting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        k, size = int(rng.integers(1, 6)), int(rng.integers(1, 9))
        loads = rng.integers(0, 40, k)
        now, got = loads.copy(), np.zeros(k, int)
        for at in range(50):
            fold, before = splits._turns(np.array([at]), np.array([size]), loads[None])
            assert fold[0] == now.argmin() and (before[0] == got).all()
            now[fold[0]] += size
            got[fold[0]] += 1


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_matching_by_all_relabellings(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        gain = rng.integers(0, 9, (k, k)).astype(float)
        assert splits._best_matching(gain) == max(sum(gain[i, p[i]] for i in range(k)) for p in permutations(range(k)))


def test_agreement_without_common_ids(spark):
    a, b = spark.createDataFrame([("u", 0)], "id string, fold int"), spark.createDataFrame([("v", 1)], "id string, fold int")
    assert tuple(splits.partition_agreement(a, b, "id", 2).first()) == (None, None)
    assert tuple(splits.partition_agreement(a, a.withColumn("fold", F.lit(1)), "id", 2).first()) == (0.0, 1.0)


def test_order_number_of_strings(spark):
    rows = [(g, f"u{i * 37 % 500:03d}") for g in ("a", None) for i in range(500)] + [("b", "only")]
    got = ranks.order_number(spark.createDataFrame(rows, "g string, u string"), ["g"], "u", "k").collect()
    want = {(g, u): k + 1 for g in ("a", "b", None) for k, u in enumerate(sorted(u for h, u in rows if h == g))}
    assert {(r["g"], r["u"]): r["k"] for r in got} == want and len(got) == len(rows)


def test_bootstrap_slots_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(f, f"u{i}") for f in (0, 1) for i in range(90 + f)], "fold int, unit_id string")
    whole = sorted(map(tuple, resample.hash_bootstrap(df, ["fold"], "unit_id", 3).collect()))
    monkeypatch.setattr(resample, "SLOTS", 7)
    assert sorted(map(tuple, resample.hash_bootstrap(df, ["fold"], "unit_id", 3).collect())) == whole
    for f in (0, 1):
        assert [sum(r[3] for r in whole if r[0] == f and r[2] == b) for b in range(3)] == [90 + f] * 3


def test_completeness_counts_each_side(spark):
    expected = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u3",)], "u string")
    pred = spark.createDataFrame([("a", "u1", 1.0), ("a", "u1", None), ("a", "u9", 2.0), ("b", "u2", 1.0), ("b", None, 1.0), (None, "u3", 1.0)], "arm string, u string, y double")
    got = {r["arm"]: tuple(r)[1:] for r in audit.completeness(pred, expected, "arm", ["u"], "y").collect()}
    assert got == {"a": (2, 1, 1, 1), "b": (2, 1, 0, 0), None: (2, 0, 0, 0)}


def test_classes_hold_all_pairs(spark):
    words = [f"w{i}" for i in range(12)]
    sets = [words[:10]] * 6 + [words[:9]] * 3 + [words[1:11]] + [words[10:]] * 2 + [[]] * 2
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, tokens array<string>")
    linked, members = similarity.jaccard_pairs(df, "id", "tokens", 0.8)
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = [sim(sets[a], sets[b]) for a in range(12) for b in range(a + 1, 12)]
    want = sorted(round(s, 9) for s in want if s >= 0.8)
    assert sorted(round(r["sim"], 9) for r in similarity.class_pairs(linked, members).collect() for _ in range(r["pairs"])) == want
    got = {r["id"]: (r["rep"], r["members"], r["links"]) for r in similarity.class_links(linked, members).collect()}
    assert got[0] == got[5] == (0, 6, 2) and got[7] == (6, 3, 1) and got[9] == (9, 1, 1) and got[10] == (10, 2, 0) and len(got) == 12


def test_grid_equals_mllib_fits(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame(rng.normal(size=(240, 2)), columns=["p", "q"]).assign(flat=3.0, fold=lambda x: np.arange(len(x)) % 4)
    d["y"] = 40 + 3 * d["p"] - d["q"] + rng.normal(size=len(d))
    df, regs = spark.createDataFrame(d), [0.0, 0.3, 2.0]
    got = features.grid_landscape(df.withColumn("fold", F.col("fold").cast("int")), ["p", "q", "flat"], "y", 4, regs).toPandas().set_index(["reg", "fold"])
    assert len(got) == 12
    for reg in (0.3, 2.0):
        fit = features.fold_regressor(df, ["p", "q", "flat"], "y", 4, "ridge", reg=reg).toPandas()
        mae = (fit["prediction"] - fit["y"]).abs().groupby(fit["fold"]).mean()
        assert got.loc[reg, "mae"].sort_index().to_numpy() == pytest.approx(mae.sort_index().to_numpy(), rel=1e-6)
    side = df.where("fold <> 1").withColumn("fold", (F.col("fold") != 2).cast("int"))
    inner = features.fold_regressor(side, ["p", "q", "flat"], "y", 1, "ridge", reg=0.3).toPandas()
    assert got.loc[(0.3, 1), "inner_mae"] == pytest.approx((inner["prediction"] - inner["y"]).abs().mean(), rel=1e-6)
    with pytest.raises(ValueError):
        features.grid_landscape(df.where("fold < 2"), ["p"], "y", 4, regs)


def test_ridge_query_by_numpy(spark):
    d = catalog.QUERIES["tabular_ridge"](spark, SMALL).toPandas()
    from plumbline.plans.feature_queries import _folded

    x = _folded(spark, SMALL).toPandas().set_index("l_partkey").loc[d["l_partkey"]]
    cols = ["l_quantity", "l_discount", "p_size", "p_retailprice"]
    for k in range(3):
        t, h = x[x["fold"] != k], x[x["fold"] == k]
        a, y = t[cols].to_numpy(float), t["l_extendedprice"].to_numpy(float)
        z = (a - a.mean(0)) / a.std(0)
        w = np.linalg.solve(z.T @ z / len(z) + 0.1 / y.std() * np.eye(4), z.T @ (y - y.mean()) / len(z))
        want = (h[cols].to_numpy(float) - a.mean(0)) / a.std(0) @ w + y.mean()
        assert d.loc[d["fold"] == k, "prediction"].to_numpy() == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_trees_find_planted_steps(spark, kind):
    """Held-out predictions follow a step that no line has, each row is predicted once, and a fold's own labels take no part."""
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"id": range(400), "p": rng.uniform(-1, 1, 400), "q": rng.normal(size=400)}).assign(fold=lambda x: x["id"] % 3)
    d["y"] = np.where(d["p"].abs() > 0.5, 10.0, 0.0) + rng.normal(size=400)
    run = lambda x: features.fold_regressor(spark.createDataFrame(x), ["p", "q"], "y", 3, kind, trees=8, depth=4).toPandas().sort_values("id")
    got = run(d)
    assert list(got["id"]) == list(range(400)) and 1 - ((got["prediction"] - d["y"].to_numpy()) ** 2).sum() / ((d["y"] - d["y"].mean()) ** 2).sum() > {"gbt": 0.8, "forest": 0.7}[kind]  # a forest's node sees one of the two columns
    hurt = run(d.assign(y=d["y"].where(d["fold"] != 1, 500.0)))
    assert hurt["prediction"][hurt["fold"] == 1].to_numpy() == pytest.approx(got["prediction"][got["fold"] == 1].to_numpy())


@pytest.mark.parametrize("name", ["tabular_gbt", "tabular_forest"])
def test_tree_queries_predict_each_row_once(spark, name):
    from plumbline.plans.feature_queries import _folded

    d, rows = catalog.QUERIES[name](spark, SMALL).toPandas(), _folded(spark, SMALL).toPandas()
    assert sorted(zip(d["l_partkey"], d["fold"])) == sorted(zip(rows["l_partkey"], rows["fold"]))
    y = d["l_extendedprice"].astype(float)
    assert d["prediction"].between(y.min(), y.max()).all()


def test_components_query_by_numpy(spark):
    from plumbline.plans.feature_queries import ALL, _block

    x = _block(spark, SMALL).select(*[F.col(c).cast("double") for c in ALL]).toPandas()
    x = x.fillna(x.median()).to_numpy()
    sd = x.std(0, ddof=1)
    e = np.sort(np.linalg.eigvalsh(np.cov(np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0).T)))[::-1]
    got = catalog.QUERIES["pca_pipeline"](spark, SMALL).orderBy("component").toPandas()
    assert got["share"].to_numpy() == pytest.approx(e / e.sum(), abs=1e-9) and got["cumulative"].iloc[-1] == pytest.approx(1)


def test_eigenvalues_query_by_numpy(spark):
    from plumbline.plans.table_queries import _AX

    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").toPandas()
    got = catalog.QUERIES["moment_eigenvalues"](spark, SMALL).toPandas().set_index("l_orderkey")
    assert len(got) == lines["l_orderkey"].nunique()
    for key, g in list(lines.groupby("l_orderkey"))[:100]:
        w, p = g["l_quantity"].to_numpy(float), g[list(_AX)].to_numpy(float)
        p = p - w @ p / w.sum()
        t = (w * (p**2).sum(1)).sum() * np.eye(3) - (p * w[:, None]).T @ p
        assert got.loc[key, ["low", "middle", "high"]].to_numpy(float) == pytest.approx(np.linalg.eigvalsh(t), rel=1e-4, abs=1e-3 * max(1, np.trace(t)))


def test_leaderboard_ties_share_a_letter_with_the_best(spark):
    from plumbline.plans.compare_queries import rows

    board = catalog.QUERIES["leaderboard"](spark, SMALL).toPandas()
    means = rows(spark, SMALL).groupBy("arm").agg(F.avg("value").alias("m")).toPandas().set_index("arm")["m"]
    best = means.idxmin()
    apart = {frozenset((r["arm_a"], r["arm_b"])) for r in compare.tukey(rows(spark, SMALL)).where("p < 0.05").collect()}
    for r in board.itertuples():
        assert r.st_rae == pytest.approx(means[r.arm])
        assert r.tier == ("best" if r.arm == best else "worse" if frozenset((r.arm, best)) in apart else "tied")
