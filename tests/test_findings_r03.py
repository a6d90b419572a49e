"""Small cases of what the third review found."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from plumbline.operators import draws, gram, neighbours, similarity
from plumbline.plans import catalog
from plumbline.sources.storage import scratch


@pytest.mark.parametrize("block", [7, 4096])
def test_pairs_are_tallied_in_their_tasks(spark, monkeypatch, block):
    """three numbers leave a pair of cells, and no pair is joined with its vectors."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[11] = v[70]
    y = [None if k % 9 == 0 else float(k % 5) for k in range(90)]
    df = spark.createDataFrame([(k, x.tolist(), z) for k, (x, z) in enumerate(zip(v, y))], "id long, v array<double>, y double")
    a, b = np.nonzero(np.triu(v @ v.T >= 0.4, 1))
    gaps = [abs(y[i] - y[j]) for i, j in zip(a, b) if y[i] is not None and y[j] is not None]
    tally = neighbours.cosine_tally(df, 0.4, "y", 3.0)
    assert tuple(tally.first()) == (len(a), len(gaps), sum(g >= 3 for g in gaps))
    pairs = neighbours.cosine_pairs(df, 0.4)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == set(zip(a.tolist(), b.tolist()))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapCoGroupsInPandas")


def test_a_large_fold_stays_in_one_task():
    """a group of 60 times sf0.1's folds is not ranked by ranges, which send each row's rank in each draw; its draws are made one by one."""
    assert draws.LIMIT >= 1_500_000
    rng = np.random.default_rng(3)
    y = rng.normal(size=150_000)
    g = pd.DataFrame({"g": 1, "u": rng.integers(-(2**62), 2**62, len(y)), "y_true": y, "y_pred": np.round(y + rng.normal(size=len(y)), 1), "conf_low": y - 0.2, "conf_high": y + 0.1})
    tracemalloc.start()
    out = draws._whole(g, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(y) and len(out) == 8  # 64 draws at once took 512 bytes a row for their counts alone
    w = draws.weights(g["u"].to_numpy(), 4, 5)[:, 0].astype(int)
    one = g.loc[g.index.repeat(w)]
    assert out["n"][4] == len(one) and out["spearman"][4] == pytest.approx(one["y_true"].rank().corr(one["y_pred"].rank()), abs=1e-9)


def test_sets_that_only_meet_are_not_candidates(spark):
    """sets that share a rare word but differ in others go by their sketches, before pairs are written."""
    rng = np.random.default_rng(5)
    sets = [sorted({f"a{k % 4}", *(f"w{x}" for x in rng.integers(0, 400, 30))}) for k in range(120)]
    sets += [s[:-1] + ["extra"] for s in sets[:40]] + [["q"], ["q"], []]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>")
    with scratch() as made:
        linked, members = similarity.jaccard_pairs(df, "id", "t", 0.8)
        got = {(r["a"], r["b"]) for r in linked.collect()}
        pairs = next(x for x in made if "set-pairs" in x._plumbline_path).count()
    share = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = {(i, j) for i in range(160) for j in range(i + 1, 160) if share(sets[i], sets[j]) >= 0.8}
    assert got == want and len(want) >= 40 and pairs <= 2 * len(want)


def test_components_make_one_product(spark):
    """F8: no column without gaps becomes long rows for its median, and only products of i <= j are made; the components are numpy's."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 11)) @ rng.normal(size=(11, 11))
    x[::7, 4] = np.nan
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, x array<double>")
    blocks = gram._whole_products(df, "x", 11, np.zeros(11), np.zeros(11), 4).collect()
    assert sorted((r["i"], r["j"]) for r in blocks) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    full = np.where(np.isnan(x), np.nanpercentile(x, 50, axis=0, method="inverted_cdf"), x)
    e = np.sort(np.linalg.eigvalsh(np.corrcoef(full.T)))[::-1]
    curve, _ = gram.components(df, "x", 11, 4)
    assert [r["share"] for r in curve.orderBy("component").collect()] == pytest.approx(list(e / e.sum()), abs=1e-9)


def test_mixing_sets_the_places_of_tokens(spark):
    """the last stage's rows say where the mix put them."""
    import corpus_pipeline
    from plumbline.llm import source_mixing
    from plumbline.sources.storage import materialise

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = materialise(corpus_pipeline.mixing_stage(spark, docs, SMALL), "mixed").withColumnRenamed("n_chars", "place")
    want = [r["doc_id"] for r in source_mixing.mix(docs).orderBy("mix_slot", "mix_offset").collect()]
    got = corpus_pipeline.token_stage(spark, mixed, SMALL).collect()
    assert sorted(r["place"] for r in got) == list(range(len(want)))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["place"])] == want


def test_small_means_do_not_deal_all_rows(spark):
    """What joins a row for each group is a written table, broadcast by its size; no prediction is computed twice in a pass."""
    from plumbline.operators import calibrate, metrics
    from plumbline.sources import fixtures

    p = fixtures.predictions(spark, SMALL)
    for df in (metrics.score(p, ["arm", "endpoint"]), calibrate.sweep(p, ["arm", "endpoint"], [(0.0, 1.0)])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert metrics.score(p, ["arm", "endpoint"])._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_wide_rows_need_no_join(spark):
    """a unit's folds follow from its row; the join sorted five rows a unit in partitions sized by the units alone."""
    from plumbline.sources import fixtures

    for df in (fixtures.wide(spark, SMALL), fixtures.oof(spark, SMALL)):
        assert "Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "").replace("BroadcastNestedLoopJoin", "")
    plan = catalog.QUERIES["rank_invariance"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "_b_ra" in plan  # ranked by ranges


def test_rows_of_recoverability_are_written_once(spark):
    """parts aren't sent through the driver."""
    from plumbline.plans.feature_queries import _block

    assert "BroadcastHashJoin" not in _block(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
