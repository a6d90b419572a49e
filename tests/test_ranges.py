"""Operators for groups of any size and for wide tables, against brute force: tau, draws, offsets, Gram blocks, ordered fingerprints, keyed streams."""

import math
import random
import uuid

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import concordance, draws, gram, offsets
from plumbline.operators import metrics as M
from plumbline.operators import ranks as R
from plumbline.sources import fixtures as X
from plumbline.streaming import metrics as S


# ---- Kendall's tau ----


def tau(pairs):
    s = tx = ty = 0
    for i, (a, b) in enumerate(pairs):
        for c, d in pairs[:i]:
            x, y = (a > c) - (a < c), (b > d) - (b < d)
            s, tx, ty = s + x * y, tx + bool(x), ty + bool(y)
    return s / math.sqrt(tx * ty) if tx and ty else None


@pytest.mark.parametrize("seed", range(6))
def test_inversions_by_pairs(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 5 + 20 * seed, 120), rng.integers(0, 40, 120) / 3
    assert concordance.inversions(x, y) == sum(x[i] < x[j] and y[i] > y[j] for i in range(120) for j in range(120))
    n = rng.integers(1, 9, 120)
    cells = {}
    for a, b, k in zip(x.tolist(), y.tolist(), n.tolist()):
        cells[a, b] = cells.get((a, b), 0) + k
    r, c, k = np.array([(a, b, m) for (a, b), m in cells.items()]).T
    assert concordance.grid_discordant(r, c, k.astype(int)) == sum(m * o for (a, b), m in cells.items() for (d, e), o in cells.items() if a < d and b > e)
    assert concordance.inversions(x[:0], y[:0]) == 0 == concordance.inversions(x[:1], y[:1])


@pytest.mark.parametrize("limit,ranges", [(10**6, 64), (40, 3), (15, 8)])
def test_tau_by_pairs(spark, limit, ranges):
    rng = random.Random(11)
    rows = [("hot" if k % 3 else None, 5.0 if rng.random() < 0.35 else rng.randrange(30) / 7, rng.choice([2.0, rng.random(), -rng.random()])) for k in range(500)]
    rows += [("one side", 1.0, float(k)) for k in range(60)] + [("single", 1.0, 2.0), ("gaps", None, 1.0), ("gaps", 2.0, None), ("rising", 1.0, 1.0), ("rising", 2.0, 2.0)]
    got = {r["g"]: r for r in concordance.kendall_any(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b", "t", limit, ranges).collect()}
    assert set(got) == {"hot", None, "one side", "single", "rising"}
    for g, r in got.items():
        own = [(a, b) for k, a, b in rows if k == g]
        want = tau(own)
        assert r["n"] == len(own) and (r["t"] is None) == (want is None) and (want is None or r["t"] == pytest.approx(want, abs=1e-12))


def test_tau_of_no_rows_and_of_folds(spark):
    empty = spark.createDataFrame([], "g string, a double, b double")
    assert concordance.kendall_any(empty, ["g"], "a", "b").collect() == []
    keys = ["arm", "endpoint", "repeat_id", "fold"]
    rows = X.oof(spark, SMALL).where("repeat_id = 0")
    want = {tuple(r[k] for k in keys): r["kendall"] for r in M.kendall(rows, keys, "y_true", "y_pred").collect()}
    got = {tuple(r[k] for k in keys): r["kendall"] for r in concordance.kendall_any(rows, keys, "y_true", "y_pred", limit=25, ranges=4).collect()}
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def test_no_task_holds_a_large_group(spark, monkeypatch):
    """The counted parts stay below the limit although one value of either column fills a third of the group."""
    sizes = spark.sparkContext.accumulator(0)
    real = concordance.inversions

    def watched(x, y):
        assert len(x) <= 300
        sizes.add(1)
        return real(x, y)

    monkeypatch.setattr(concordance, "inversions", watched)
    rng = random.Random(4)
    rows = [(7.0 if rng.random() < 0.33 else rng.random(), 3.0 if rng.random() < 0.33 else rng.random()) for _ in range(6000)]
    r = concordance.kendall_any(spark.createDataFrame(rows, "a double, b double"), [], "a", "b", "t", 300, 24).first()
    monkeypatch.undo()
    assert r["n"] == 6000 and r["t"] == pytest.approx(M._kendall(np.array([a for a, _ in rows]), np.array([b for _, b in rows])))


# ---- Draws ----


def exploded(spark, rows, keys, samples):
    """Each row as often as Spark's own hash says, scored by the plain operators."""
    b = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b")
    word = F.xxhash64("unit_id", (F.col("b") / 4).cast("long"))
    draw = F.expr("cast(shiftrightunsigned(w, 16 * cast(b % 4 as int)) & 65535 as int)")
    counts = sum((draw >= round(share * 65536)).cast("int") for share in draws.POISSON)
    times = rows.select("*", b).withColumn("w", word).withColumn("t", counts).where("t > 0")
    copies = times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("t"))))
    scores = M.score(copies, [*keys, "b"]).select(*keys, "b", "n", "mae", "st_rae")
    return scores.join(R.spearman(copies, [*keys, "b"], "y_true", "y_pred").drop("n"), [*keys, "b"])


def near(a, b):
    return a == b if a is None or b is None else a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("limit", [10**6, 30])
def test_draws_are_the_exploded_ones(spark, limit):
    rows = X.oof(spark, SMALL).where("repeat_id = 1 and fold < 2 and arm in ('tree', 'naive')")
    keys, samples = ["arm", "endpoint", "fold"], 20
    got = {tuple(r[k] for k in (*keys, "b")): r for r in draws.bootstrap_draws(rows, keys, "unit_id", samples, limit, 5).collect()}
    want = {tuple(r[k] for k in (*keys, "b")): r for r in exploded(spark, rows, keys, samples).collect()}
    assert len(got) == samples * rows.select(*keys).distinct().count() and got.keys() >= want.keys()
    for k, w in want.items():
        assert got[k]["n"] == w["n"] and all(near(got[k][c], w[c]) for c in ("mae", "st_rae", "spearman")), (k, got[k], w)


def test_large_groups_give_the_draws_of_whole_ones(spark):
    rows = X.predictions(spark, SMALL).where("arm = 'deadzone' and endpoint <> 'A'").withColumn("y_true", F.round("y_true", 1))
    whole = {(r["endpoint"], r["b"]): r for r in draws.bootstrap_draws(rows, ["endpoint"], "unit_id", 70).collect()}
    cut = {(r["endpoint"], r["b"]): r for r in draws.bootstrap_draws(rows, ["endpoint"], "unit_id", 70, limit=100, ranges=7).collect()}
    assert whole.keys() == cut.keys() and len(whole) == 140
    assert all(near(whole[k][c], cut[k][c]) for k in whole for c in ("n", "mae", "st_rae", "spearman"))


def test_draws_that_are_undefined(spark):
    rows = [("flat", str(k), 1.0, float(k), 0.5, 1.5) for k in range(6)] + [("one", "u", 1.0, 2.0, 0.0, 3.0), ("gap", "u", None, 1.0, 0.0, 1.0), (None, "u", 1.0, 2.0, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "g string, unit_id string, y_true double, y_pred double, conf_low double, conf_high double")
    got = draws.bootstrap_draws(df, ["g"], "unit_id", 40).collect()
    assert {r["g"] for r in got} == {"flat", "one", None} and len(got) == 120
    assert all(r["spearman"] is None for r in got) and any(r["n"] == 0 and r["mae"] is None for r in got if r["g"] == "one")
    i = {r["g"]: r for r in draws.interval(draws.bootstrap_draws(df, ["g"], "unit_id", 40), ["g"], "mae").collect()}
    assert i["flat"]["low"] <= i["flat"]["mean"] <= i["flat"]["high"] and i["one"]["undefined"] > 0
    assert draws.bootstrap_draws(df.limit(0), ["g"], "unit_id", 40).collect() == []


# ---- Offsets ----


def test_optimum_beats_any_offset(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        y = rng.random() * 4
        rows.append(("a", y, y + rng.random() - 0.2 if k % 3 else 1.0, y - 0.1, y + 0.2))
    rows += [("b", 1.0, 3.0, 0.5, 1.5), ("gap", 1.0, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y_true double, y_pred double, conf_low double, conf_high double")
    soft = lambda g, o: sum(max(0, p + o - hi) + max(0, lo - p - o) for k, _, p, lo, hi in rows if k == g and p is not None)
    mean = sum(r[1] for r in rows[:300]) / 300
    base = sum(max(0, mean - r[4]) + max(0, r[3] - mean) for r in rows[:300])
    curve = {r["offset"]: r["st_rae"] for r in offsets.offset_curve(df, ["g"], -2.0, 2.0, 401).where("g = 'a'").collect()}
    assert len(curve) == 401 and all(v == pytest.approx(soft("a", o) / base, abs=1e-9) for o, v in curve.items())
    best = {r["g"]: r for r in offsets.offset_optimum(df, ["g"]).collect()}
    assert set(best) == {"a", "b"} and best["b"]["low"] == -2.5 and best["b"]["high"] == -1.5 and best["b"]["st_rae"] is None
    a = best["a"]
    assert a["st_rae"] == pytest.approx(soft("a", a["low"]) / base) and a["st_rae"] <= min(curve.values()) + 1e-12
    assert soft("a", a["low"]) == pytest.approx(soft("a", a["high"])) and all(soft("a", a["low"]) <= soft("a", a["low"] + e) + 1e-9 for e in (-0.01, -1e-4, 1e-4, 0.01))
    assert a["r2_offset"] == pytest.approx(sum(r[1] - r[2] for r in rows[:300]) / 300)


def test_middle_breaks_with_a_frequent_value(spark):
    rows = [(0.0, 0.0, -1.0, 1.0)] * 400 + [(0.0, k / 100, -1.0, 1.0) for k in range(301)]
    df = spark.createDataFrame(rows, "y_true double, y_pred double, conf_low double, conf_high double")
    r = offsets.middle_breaks(df, [], accuracy=50).first()
    z = sorted(x for _, p, lo, hi in rows for x in (hi - p, lo - p))
    assert (r["low"], r["high"]) == (z[len(rows) - 1], z[len(rows)])


# ---- Gram blocks ----


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 23))
    x[:, 7] = 2 * x[:, 3] + 1e-3 * rng.normal(size=300)
    x[:, 12] = -x[:, 7] + 1e-3 * rng.normal(size=300)
    x[:, 5] = 4.0
    x[:, 21] = x[:, 20] + 0.4 * rng.normal(size=300)
    rows = [[None if rng.random() < 0.05 and k != 5 else float(v) for k, v in enumerate(r)] for r in x]
    for r in rows:
        r[9] = None
    rows[3] = rows[3][:10]  # a short row
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)] + [(300, None)], "id long, x array<double>")
    full = np.array([[np.nan if v is None else v for v in [*r, *[None] * (23 - len(r))]] for r in rows])
    return frame.repartition(5), full


@pytest.mark.parametrize("block,held", [(23, 10**7), (6, 10**7), (6, 600)])
def test_pairs_by_blocks(wide, monkeypatch, block, held):
    monkeypatch.setattr(gram, "HELD", held)
    frame, x = wide
    got = {(r["a"], r["b"]): r for r in gram.correlation_pairs(gram.gram_blocks(frame, "x", 23, block), 23, 0.0, block=block).collect()}
    for a in range(23):
        for b in range(a + 1, 23):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if {a, b} & {5, 9}:
                assert (a, b) not in got
            else:
                assert got[a, b]["n"] == both.sum() and got[a, b]["rho"] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)
    near = gram.correlation_pairs(gram.gram_blocks(frame, "x", 23, block), 23, 0.95, block=block)
    assert {(r["a"], r["b"]) for r in near.collect()} == {(3, 7), (3, 12), (7, 12)}
    assert gram.keep_earlier(near, 23) == [k for k in range(23) if k not in (7, 12)]


def test_chains_of_collinear_columns(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(0, 20), (1, 21)], "a int, b int")
    kept = []
    near = {(r["a"], r["b"]) for r in pairs.collect()}
    for c in range(23):
        if not any((k, c) in near for k in kept):
            kept.append(c)
    assert gram.keep_earlier(pairs, 23) == kept


@pytest.mark.parametrize("block", [23, 7])
def test_components_by_numpy(wide, block):
    frame, x = wide
    curve, need = gram.components(frame.where("id < 300"), "x", 23, block)
    middle = {r["feature"]: r["middle"] for r in gram.column_moments(frame, "x").collect()}
    filled = np.column_stack([np.where(np.isnan(x[:, k]), middle[k], x[:, k]) for k in range(23) if k != 9])
    sd = filled.std(axis=0)
    z = (filled - filled.mean(axis=0)) / np.where(sd > 1e-9, sd, 1)
    share = np.linalg.svd(z, compute_uv=False) ** 2
    share /= share.sum()
    got = curve.orderBy("component").collect()
    assert [r["share"] for r in got] == pytest.approx(share.tolist(), abs=1e-9)
    assert {r["wanted"]: r["components"] for r in need.collect()} == {t: int(np.searchsorted(np.cumsum(share), t) + 1) for t in (0.9, 0.95, 0.99)}
    k = 3
    own = np.sort(x[~np.isnan(x[:, k]), k])
    assert own[len(own) // 2 - 2] <= middle[k] <= own[len(own) // 2 + 1]


def test_components_of_nothing(spark):
    curve, need = gram.components(spark.createDataFrame([], "x array<double>"), "x", 4)
    assert curve.collect() == [] == need.collect()


# ---- Ordered fingerprints ----


def test_fingerprint_follows_order(spark):
    rows = [(k, f"v{k % 7}", None if k % 5 == 0 else k / 3) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, s string, x double")
    one = A.ordered_fingerprint(df, ["k"], ["s", "x"]).first()
    assert one == A.ordered_fingerprint(df.repartition(9, "s"), ["k"], ["s", "x"]).first() == A.ordered_fingerprint(df.coalesce(1), ["k"], ["s", "x"], ranges=2).first() and one["n"] == 500
    swapped = df.withColumn("k", F.when(F.col("k") == 10, 11).when(F.col("k") == 11, 10).otherwise(F.col("k")))
    assert one["fingerprint"] != A.ordered_fingerprint(swapped, ["k"], ["s", "x"]).first()["fingerprint"]
    assert one["fingerprint"] != A.ordered_fingerprint(df.where("k < 499"), ["k"], ["s", "x"]).first()["fingerprint"]
    assert A.ordered_fingerprint(df, [F.col("k").desc()], ["s", "x"]).first()["fingerprint"] != one["fingerprint"]
    assert A.ordered_fingerprint(df.limit(0), ["k"], ["s", "x"]).first()["n"] == 0


# ---- Keyed streams ----


def test_bucketed_upserts_touch_only_their_buckets(spark, tmp_path):
    schema, name = "row string, t int, _batch string", uuid.uuid4().hex
    want, rng = {}, random.Random(1)

    def run():
        s = S.file_stream(spark, str(tmp_path / "in*"), schema, files_per_trigger=1)
        return {r["row"]: (r["t"], r["_batch"]) for r in S.run_upsert(s, ["row"], "append", ["t"], name, buckets=8, compact_every=3).collect()}

    assert run() == {}
    for turn in range(4):
        for part in range(3):
            rows = [(None if rng.random() < 0.1 else f"k{rng.randrange(40)}", 100 * turn + 10 * part + k, f"b{turn}{part}") for k in range(12)]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{turn}{part}"))
            want |= {k: (t, b) for k, t, b in rows}
        assert run() == want
    assert run() == want
    root = S.upsert_root(spark, name)
    assert S.pending_deltas(spark, root) == [] or len(S.pending_deltas(spark, root)) < 3
    before = S.bucket_bases(spark, root)
    for k in range(3):
        spark.createDataFrame([("k1", 10_000 + k, "last")], schema).coalesce(1).write.parquet(str(tmp_path / f"in9{k}"))
    want["k1"] = (10_002, "last")
    assert run() == want
    after = S.bucket_bases(spark, root)
    pending = S.pending_deltas(spark, root)
    moved = {b for b in after if before.get(b) != after[b]}
    assert len(pending) < 3 and len(moved) <= len(before) and before.keys() <= after.keys()


def test_compaction_rewrites_one_bucket(spark, tmp_path):
    schema, name = "k string, v int", uuid.uuid4().hex
    put = lambda rows, at: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{at}"))
    run = lambda: {r["k"]: r["v"] for r in S.run_upsert(S.file_stream(spark, str(tmp_path / "in*"), schema, 1), ["k"], "append", ["v"], name, buckets=8, compact_every=1).collect()}
    put([(f"k{i}", i) for i in range(60)], 0)
    assert run() == {f"k{i}": i for i in range(60)}
    before = S.bucket_bases(spark, S.upsert_root(spark, name))
    assert len(before) == 8
    put([("k7", 700)], 1)
    assert run() == {f"k{i}": i for i in range(60)} | {"k7": 700}
    after = S.bucket_bases(spark, S.upsert_root(spark, name))
    assert sum(before[b] != after[b] for b in after) == 1 and before.keys() == after.keys()


# ---- Numbers over hash ranges ----


@pytest.mark.parametrize("n,k", [(1, 5), (3, 5), (23, 5), (500, 7)])
def test_folds_and_splits_are_those_of_one_window(spark, n, k):
    from pyspark.sql.window import Window

    from plumbline.operators import splits

    units = spark.range(n).select(F.concat(F.lit("u"), "id").alias("u"))
    got = {(r["u"], r["repeat_id"]): r["fold"] for r in splits.exact_kfold(units, "u", k, 3).collect()}
    rows = units.select("u", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat_id"))
    digest = lambda salt: F.md5(F.concat("u", F.lit(salt), F.col("repeat_id").cast("string")))
    w = Window.partitionBy("repeat_id").orderBy(digest(":k"), "u")
    assert got == {(r["u"], r["repeat_id"]): r["f"] for r in rows.withColumn("f", F.ntile(k).over(w) - 1).collect()}
    folds = splits.exact_kfold(units, "u", k, 3)
    v = Window.partitionBy("repeat_id", "test").orderBy(digest(":v"), "u")
    want = folds.withColumn("test", F.col("fold") == 0).withColumn("split", F.when(F.col("test"), "test").when(F.percent_rank().over(v) < 0.15, "val").otherwise("train"))
    assert sorted(map(tuple, splits.screen_split(folds, "u", 0, 0.15).collect())) == sorted((r["u"], r["repeat_id"], r["split"]) for r in want.collect())
