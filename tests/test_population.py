"""Population solves against planted populations, blends in z space and recoverability on the rows that have the target."""

import math

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import ensemble as I
from plumbline.operators import features as K
from plumbline.operators.population import solve_population

BOARD = "endpoint string, arm string, mean double, sd double, rho double, r2 double, mae double"


def board(mean, label_sd, rho, k, bias):
    """Figures that a submission has on labels of this mean and sd, if its errors are normal."""
    m, s = bias * label_sd, label_sd * math.sqrt(1 - 2 * rho * k + k * k)
    mae = m * math.erf(m / s / math.sqrt(2)) + s * math.sqrt(2 / math.pi) * math.exp(-m * m / 2 / s / s)
    return mean + bias * label_sd, k * label_sd, rho, 2 * rho * k - k * k - bias * bias, mae


def test_planted_population(spark):
    rows = [("A", "low", *board(5.0, 1.0, 0.8, 0.55, 0.3)), ("A", "near", *board(5.0, 1.0, 0.7, 0.45, 0.4)), ("B", "wide", *board(2.0, 9.0, 0.8, 0.5, 0.3))]
    known = spark.createDataFrame([("A", 4.9, 1.1), ("B", 2.0, 1.0)], "endpoint string, mean double, sd double")
    got = {r["arm"]: r for r in solve_population(spark.createDataFrame(rows, BOARD), known, ["endpoint"]).collect()}
    for arm, k, bias, label_sd, mean in (("low", 0.55, 0.3, 1.0, 5.0), ("near", 0.45, 0.4, 1.0, 5.0), ("wide", 0.5, 0.3, 9.0, 2.0)):
        assert got[arm]["roots"] >= 1
        assert [got[arm][c] for c in ("k", "bias", "label_sd", "label_mean")] == pytest.approx([k, bias, label_sd, mean], abs=1e-3)
    assert [got[a]["status"] for a in ("low", "near", "wide")] == ["OK", "OK", "IMPLAUSIBLE"]
    assert got["low"]["mirror_mean"] == pytest.approx(5.6, abs=1e-3)


def test_population_without_an_answer(spark):
    rows = [("A", "no k", 0.0, 1.0, 0.2, 0.5, 0.1), ("A", "no mae", 0.0, 1.0, 0.8, 0.5, 50.0), ("A", "null", None, 1.0, 0.8, 0.5, 0.4), ("A", "nan", 0.0, float("nan"), 0.8, 0.5, 0.4), ("A", "flat", 0.0, 0.0, 0.8, 0.5, 0.4), ("C", "unknown", *board(5.0, 1.0, 0.8, 0.55, 0.3)), (None, "no key", 0.0, 1.0, None, None, None)]
    known = spark.createDataFrame([("A", 0.0, 1.0)], "endpoint string, mean double, sd double")
    got = solve_population(spark.createDataFrame(rows, BOARD), known, ["endpoint"]).collect()
    assert len(got) == len(rows) and {r["status"] for r in got} == {"INFEASIBLE"}
    assert solve_population(spark.createDataFrame([], BOARD), known, ["endpoint"]).count() == 0


def test_blend_in_z_space(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=120)
    t = pd.DataFrame({"endpoint": np.where(np.arange(120) % 3, "A", "B"), "y_true": y, "conf_low": y, "conf_high": y, "p": 5 * y + rng.normal(size=120) * 4 + 7, "q": y * 0.2 + rng.normal(size=120) * 0.1 - 3, "flat": 1.5})
    arms = ["p", "q", "flat"]
    got = I.greedy_blend(spark.createDataFrame(t), ["endpoint"], arms, 10, space="z").toPandas()
    for e, d in t.groupby("endpoint"):
        z = {a: (d[a] - d[a].mean()) / d[a].std(ddof=0) if d[a].nunique() > 1 else d[a] * 0 for a in arms}
        loss = lambda members: float((sum(z[a] for a in members) / len(members) * d["y_true"].std(ddof=0) + d["y_true"].mean() - d["y_true"]).abs().mean())  # noqa: B023, E731
        chosen, best = [], np.inf
        for _ in range(10):
            score, arm = min((loss([*chosen, a]), a) for a in arms)
            if best - score <= 1e-12:
                break
            chosen, best = [*chosen, arm], score
        g = got[got["group"] == e].set_index("arm")
        assert g["count"].to_dict() == {a: chosen.count(a) for a in arms}
        assert g["score"].iloc[0] == pytest.approx(best)
    with pytest.raises(ValueError):
        I.greedy_blend(spark.createDataFrame(t), ["endpoint"], arms, space="log")


def test_recoverability_uses_rows_that_have_the_target(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(size=600), rng.uniform(size=600)
    t = pd.DataFrame({"a": a, "b": b, "same": 1.0, "fold": np.arange(600) % 3, "y": np.where(np.arange(600) % 4 == 0, np.nan, 3 * a + b)})
    df = spark.createDataFrame(t)
    r = K.recoverability(df, ["a", "b", "same"], "y", 3).first()
    assert (r["n"], r["n_pred"]) == (450, 2) and r["linear"] > 0.98 and r["r2"] == max(r["linear"], r["trees"])
    few = K.recoverability(df.limit(90), ["a", "b"], "y", 3).first()
    assert few["n"] < 90 and few["r2"] is None and few["n_pred"] == 0
