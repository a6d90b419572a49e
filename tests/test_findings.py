"""Small cases of what the reviews found."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from plumbline.operators import neighbours, ranks, resample, similarity
from plumbline.sources import fixtures


def joins(df):
    """The joins of a frame's plan, as planned before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-*") for line in plan.splitlines() if "Join" in line]


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(8)
    rows = [(arm, k % 2, f"u{k}", float(y), float(y + e)) for arm in ("a", "b") for k, (y, e) in enumerate(zip(rng.integers(0, 12, 90), rng.integers(-3, 4, 90)))]
    df = spark.createDataFrame(rows, "arm string, fold int, unit_id string, y_true double, y_pred double")
    return df.withColumn("conf_low", F.col("y_true") - 1).withColumn("conf_high", F.col("y_true") + 1)


def test_counts_of_draws_are_never_broadcast(folds):
    """They are as many as the table's rows, though the files that their slots are made from are small."""
    counts = resample.draw_counts(folds, ["fold"], "unit_id", 7)
    own = [j for j in joins(counts) if "_k" in j]
    assert own and all(j.startswith("SortMergeJoin") for j in own)
    assert {len(r["times"]) for r in counts.collect()} == {7} and counts.count() <= 90


@pytest.mark.parametrize("limit", [1 << 20, 10])
def test_spearman_of_resamples(spark, folds, limit):
    counts = resample.draw_counts(folds, ["fold"], "unit_id", 7)
    got = {(r["arm"], r["fold"], r["b"]): r["s"] for r in resample.bootstrap_spearman(folds, ["arm", "fold"], counts, ["fold"], 7, limit=limit, ranges=4).collect()}
    long = folds.join(resample.hash_bootstrap(folds, ["fold"], "unit_id", 7), ["fold", "unit_id"]).toPandas()
    long = long.loc[long.index.repeat(long["times"])]
    want = {k: g["y_true"].rank().corr(g["y_pred"].rank()) for k, g in long.groupby(["arm", "fold", "b"])}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(got) == 28


@pytest.mark.parametrize("near", [10_000, 40])
def test_percentiles_without_a_groups_values_in_one_task(spark, monkeypatch, near):
    """one bracket may miss (40), the result stays."""
    monkeypatch.setattr(ranks, "NEAR", near)
    rng = np.random.default_rng(2)
    sides = {"a": rng.normal(size=3000), "b": rng.integers(0, 5, 700) * 1.0, None: rng.exponential(size=41), "one": np.array([2.5]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in sides.items() for x in v] + [("a", None), ("lost", None)], "g string, x double").repartition(7)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    q = ranks.percentiles(df, ["g"], "x", shares, "q")
    assert {r["g"]: r["q"] for r in q.collect()} == {k: pytest.approx(list(np.quantile(v, shares))) for k, v in sides.items()} | {"lost": None}
    if near > 40:
        assert "percentile(" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_of_ranks_are_computed_once(spark):
    """two computations of approximate cuts, or of sums of doubles, need not agree; counts and ranks read one written table."""
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.rand().alias("x"), F.rand().alias("y"))
    got = ranks.average_ranks(df, ["g"], {"x": "rx", "y": "ry"})
    assert not any("rand(" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
    p = got.toPandas()
    assert (p["rx"] == p.groupby("g")["x"].rank()).all() and (p["ry"] == p.groupby("g")["y"].rank()).all()


def test_wide_rows_are_not_gathered(spark):
    """An arm's column is computed in its row, so nothing of the size of all predictions is aggregated."""
    w = fixtures.wide(spark, SMALL)
    assert "pivotfirst" not in w._jdf.queryExecution().optimizedPlan().toString()
    long = w.unpivot(["repeat_id", "fold", "unit_id", "endpoint", "y_true"], [a[0] for a in fixtures.ARMS], "arm", "y_pred").drop("y_true")
    other = fixtures.oof(spark, SMALL).select(*long.columns)
    assert long.exceptAll(other).isEmpty() and other.exceptAll(long).isEmpty()


def test_visits_leave_in_parts(spark, monkeypatch):
    """A part's visits go out in frames of BLOCK rows, not all at once."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(rng.normal(size=(300, 5)))]
    members, clusters = neighbours._clustered(spark.createDataFrame(rows, "id long, v array<double>"))
    frames = []

    class Queries:  # what _visits asks of a frame, to see the frames that its tasks send
        sparkSession, dtypes = spark, members.dtypes

        def select(self, *cols):
            return self

        def mapInPandas(self, run, schema):
            part = members.toPandas().assign(reach=2.0)
            frames.extend(run(iter([part])))

    neighbours._visits(Queries(), clusters, "all")
    assert max(map(len, frames)) <= 16 and sum(map(len, frames)) == 300 * len(clusters.pivots)


def test_sim_join_has_each_member(spark):
    """F16: pairs of all documents follow from the join's rows alone."""
    sets = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], ["d", "c", "b", "a"], ["x"], ["x"], []]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>")
    got = similarity.membership(*similarity.jaccard_pairs(df, "id", "t", 0.8)).collect()
    assert sorted((r["a"], r["b"], r["common"], r["sim"]) for r in got) == [(0, 1, 4, 0.8), (1, 2, 4, 1.0), (1, 3, 4, 1.0), (4, 5, 1, 1.0)]
