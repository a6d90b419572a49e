"""Identities, invariances, known answers and planted truths."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats_math as S
from plumbline.operators import audit, calibrate, compare, curate, ensemble, graph, metrics, ranks, similarity, splits


def test_distributions():
    assert S.f_sf(4.0, 2, 10) == pytest.approx(0.0530, abs=2e-4)
    assert S.t_sf2(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert S.t_ppf(0.975, 24) == pytest.approx(2.0638986, abs=1e-6)
    assert S.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert S.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=1e-3)
    assert S.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-4)
    assert S.wilcoxon(np.array([1.0, 2, 3, 4, 5]))[1] == pytest.approx(0.0625)
    w, p = S.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01


def test_letters_of_the_known_example(spark):
    means = spark.createDataFrame([("a", 0.30), ("b", 0.30), ("c", 0.37)], "arm string, mean double")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.001), ("b", "c", 0.001)], "arm_a string, arm_b string, p double")
    got = {r["arm"]: r["letters"] for r in compare.letters(means, pairs).collect()}
    assert got["a"] == got["b"] and not set(got["a"]) & set(got["c"])


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.normal(5, 1, n)
    rows = [("m", "E", float(v), float(v - 0.2), float(v + 0.2), float(5 + 0.6 * (v - 5) + rng.normal(0, 0.4))) for v in y]
    return spark.createDataFrame(rows, "arm string, endpoint string, y_true double, conf_low double, conf_high double, y_pred double")


def test_mean_predictor_scores_one_and_r2_identity(spark):
    df = frame(spark)
    m = df.agg(F.avg("y_true")).first()[0]
    assert metrics.score(df.withColumn("y_pred", F.lit(m)), ["arm"]).first()["st_rae"] == pytest.approx(1, abs=1e-12)
    s, d = metrics.score(df, ["arm"]).first(), calibrate.r2_decomposition(df, ["arm"]).first()
    assert s["r2"] == pytest.approx(d["r2"], abs=1e-9)
    assert d["rho"] ** 2 - d["r2"] == pytest.approx(d["scale_loss"] + d["bias_loss"], abs=1e-9)


def test_bucketed_ranks_are_the_plain_ones(spark):
    df = spark.createDataFrame([(i % 2, float((i * 7919) % 50)) for i in range(300)] + [(0, None)], "g int, v double")
    a = sorted((r["g"], r["v"], r["rk"]) for r in ranks.average_rank(df, ["g"], "v", "rk", 1).collect() if r["v"] is not None)
    b = sorted((r["g"], r["v"], r["rk"]) for r in ranks.average_rank(df, ["g"], "v", "rk", 7).collect() if r["v"] is not None)
    assert a == b


def test_spearman_is_unchanged_by_shift_and_scale(spark):
    df = frame(spark)
    one = ranks.spearman(df, ["arm"], "y_true", "y_pred").first()["spearman"]
    two = ranks.spearman(df.withColumn("y_pred", 3 * F.col("y_pred") - 1), ["arm"], "y_true", "y_pred").first()["spearman"]
    assert one == pytest.approx(two, abs=1e-12)


def test_simplex_weights_beat_random_ones(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, 300)
    p = [y * s + rng.normal(0, e, 300) for s, e in ((0.8, 0.5), (0.5, 0.3), (1.0, 1.0))]
    rows = [("E", i % 2, *map(float, (p[0][i], p[1][i], p[2][i], y[i]))) for i in range(300)]
    w = spark.createDataFrame(rows, "endpoint string, fold int, a double, b double, c double, y_true double")
    coef = {(r["fold"], r["arm"]): r["coef"] for r in ensemble.stack(w, ["a", "b", "c"], "simplex").collect()}
    own = np.array([coef[0, k] for k in "abc"])
    assert own.sum() == pytest.approx(1, abs=1e-9) and (own >= 0).all()
    x, t = np.column_stack(p)[1::2], y[1::2]
    loss = lambda v: ((x @ v - t) ** 2).sum()
    assert all(loss(own) <= loss(rng.dirichlet(np.ones(3))) + 1e-9 for _ in range(500))


def test_leader_clusters_follow_the_sequential_walk(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2)) if a < b})
    nb = {i: {i} for i in range(40)}
    for a, b in edges:
        nb[a].add(b)
        nb[b].add(a)
    order, taken, centres = sorted(nb, key=lambda i: (-len(nb[i]), i)), set(), []
    for i in order:
        if i not in taken:
            centres.append(i)
            taken |= nb[i]
    got = {r["id"]: r["centroid"] for r in similarity.leader_clusters(spark.range(40), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert sorted(set(got.values())) == sorted(centres)
    assert all(c in nb[i] for i, c in got.items())


def test_components_of_a_long_path_with_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + k) for k in range(50)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1001 + k] for k in range(50)} == {1000}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_group_folds_keep_groups_whole_and_even(spark):
    units = spark.createDataFrame([(f"g{i % 23}",) for i in range(400)], "grp string")
    f = splits.group_folds(units, "grp", 5, 2, True).toPandas()
    assert (f.groupby(["repeat_id", "g"])["fold"].nunique() == 1).all()
    size = f.groupby(["repeat_id", "fold"])["n"].sum()
    assert size.max() - size.min() <= 20


def test_fingerprint_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    a = audit.table_fingerprint(df, ["id", "v"]).first()
    assert a == audit.table_fingerprint(df.repartition(13), ["id", "v"]).first()
    assert a != audit.table_fingerprint(df.withColumn("v", F.col("v") + 1), ["id", "v"]).first()


def test_validated_join_stops_at_fan_out_and_loss(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert audit.validated_join(left, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"]).count() == 2
    for bad in ([(1, "a"), (1, "b"), (2, "c")], [(1, "a")]):
        with pytest.raises(Exception):
            audit.validated_join(left, spark.createDataFrame(bad, "k int, v string"), ["k"]).collect()


def test_censored_fit_recovers_a_planted_normal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 1, 4000)
    rows = [("e", float(max(v, 4.5)), bool(v < 4.5), 4.5) for v in x]
    r = curate.censored_normal(spark.createDataFrame(rows, "endpoint string, value double, censored boolean, floor double"), ["endpoint"], "value", "censored", "floor").first()
    assert r["mu"] == pytest.approx(5, abs=0.06) and r["sigma"] == pytest.approx(1, abs=0.06) and r["spread"] < 1e-3


def test_population_fit_recovers_planted_truth(spark):
    mu, sg = 5.2, 0.9
    rows = []
    for m, s, rho in ((5.0, 0.5, 0.6), (5.6, 0.7, 0.7), (4.8, 0.9, 0.5)):
        k, b = s / sg, (m - mu) / sg
        rows.append(("e", m, s, rho, 2 * rho * k - k * k - b * b))
    r = calibrate.population_fit(spark.createDataFrame(rows, "endpoint string, mean double, sd double, rho double, r2 double")).first()
    assert r["mean"] == pytest.approx(mu, abs=0.01) and r["sd"] == pytest.approx(sg, abs=0.01)


def test_root_scan_finds_both_roots(spark):
    sd, b = 0.8, 0.5
    mae = sd * math.sqrt(2 / math.pi) * math.exp(-(b**2) / (2 * sd**2)) + b * math.erf(b / (sd * math.sqrt(2)))
    got = sorted(r["bias"] for r in calibrate.root_scan(spark.createDataFrame([("e", sd, mae)], "endpoint string, sd double, mae double")).collect())
    assert got == pytest.approx([-b, b], abs=1e-3)


def test_similarity_join_loses_no_pair(spark):
    rng = np.random.default_rng(9)
    sets = {i: {f"t{j}" for j in rng.integers(0, 12, 8)} for i in range(60)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>")
    linked, members = similarity.jaccard_pairs(df, "id", "tokens", 0.6)
    got = {(r["a"], r["b"]) for r in similarity.expand_pairs(linked, members).collect()}
    assert got == {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
