"""Blends and stackers over wide out-of-fold tables, and how diverse their members are."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.errors import soft_error
from plumbline.sources.storage import materialise


def complete_wide(wide: DataFrame, arms: list[str]) -> DataFrame:
    """The wide table; the plan raises an error at a row without some arm's prediction."""
    missing = F.greatest(*[F.col(a).isNull() for a in arms])
    return wide.withColumn("_ok", F.when(missing, F.raise_error(F.lit("an arm lacks a prediction")).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")


def subset_scores(wide: DataFrame, arms: list[str], keys: list[str]) -> DataFrame:
    """Mean absolute error of the average of every subset of two or more arms: one aggregation, a column for each subset."""
    subsets = [c for k in range(2, len(arms) + 1) for c in combinations(arms, k)]
    aggs = [F.avg(F.abs(sum((F.col(a) for a in s), F.lit(0.0)) / len(s) - F.col("y_true"))).alias("+".join(s)) for s in subsets]
    g = wide.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit("+".join(s)).alias("subset"), F.col(f"`{'+'.join(s)}`").alias("mae")) for s in subsets])
    return g.select(*keys, F.explode(rows).alias("z")).select(*keys, "z.subset", "z.mae")


def weighted_blend(pred: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, endpoint, y_blend`` from a weight for each (endpoint, arm)."""
    j = pred.join(weights, ["endpoint", "arm"])
    return j.groupBy(*keys, "endpoint").agg((F.sum(F.col("weight") * F.col("y_pred")) / F.sum("weight")).alias("y_blend"))


def _group_key(groups: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in groups])


def _scores(wide: DataFrame, groups: list[str], arms: list[str], state: dict[str, list[float]], metric: str, macro: str | None = None) -> dict[str, list[float]]:
    """Score of adding each arm to each group's blend, and of the blend as it is (infinite if empty), in this order.

    One aggregation over all groups, whose states are joined as a table. A state key may have a suffix behind "#", for several blends of one group. ``st_rae`` is the sum of soft errors over that of
    the group's own mean label; with ``macro`` the scores of the parts that this column names are averaged.
    """
    spark = wide.sparkSession
    rows = [(g, g.split("#")[0], [float(c) for c in counts], float(sum(counts))) for g, counts in state.items()]
    states = spark.createDataFrame(rows, "state string, of string, counts array<double>, size double")
    parts = ["state", *([macro] if macro else [])]
    j = wide.withColumn("of", _group_key(groups)).join(F.broadcast(states), "of")  # a row for each blend, made by the driver
    total = sum((F.get("counts", F.lit(i)) * F.col(a) for i, a in enumerate(arms)), F.lit(0.0))
    j = j.withColumn("total", total)
    blends = {a: (F.col("total") + F.col(a)) / (F.col("size") + 1) for a in arms} | {"as_is": F.try_divide("total", "size")}
    if metric == "mae":
        scored = j.groupBy(*parts).agg(*[F.avg(F.abs(p - F.col("y_true"))).alias(a) for a, p in blends.items()])
    else:
        means = wide.withColumn("of", _group_key(groups)).groupBy("of", *parts[1:]).agg(F.avg("y_true").alias("mean"))
        j = j.join(materialise(means, "means"), ["of", *parts[1:]])  # a row for each group: as a written table its size is known
        base = F.sum(soft_error("mean", "conf_low", "conf_high"))
        scored = j.groupBy(*parts).agg(*[F.try_divide(F.sum(soft_error(p, "conf_low", "conf_high")), base).alias(a) for a, p in blends.items()])
    found = scored.groupBy("state").agg(*[F.avg(a).alias(a) for a in blends]).collect()
    return {r["state"]: [r[a] if r[a] is not None and (a != "as_is" or any(state[r["state"]])) else float("inf") for a in blends] for r in found}


def _select(wide: DataFrame, groups: list[str], arms: list[str], steps: int, gain: float, metric: str, macro: str | None, replacement: bool, start: int, bags: dict[str, set[str]] | None) -> tuple[dict, dict]:
    """States and scores of forward selection in each group (and bag): one aggregation a step for all of them together."""
    columns = dict.fromkeys([*groups, *([macro] if macro else []), "y_true", "conf_low", "conf_high", *arms])
    w = materialise(wide.select(*columns), "blend")
    names = [r[0] for r in w.select(_group_key(groups)).distinct().collect()]
    bags = bags or {"": set(arms)}
    state = {f"{g}#{b}" if b else g: [0] * len(arms) for g in names for b in bags}
    own = {g: bags[g.split("#")[1] if "#" in g else ""] for g in state}
    best = dict.fromkeys(state, float("inf"))
    live = set(state)
    for step in range(steps):
        scores = _scores(w, groups, arms, {g: state[g] for g in live}, metric, macro)
        for g in sorted(live):
            open_ = [k for k, a in enumerate(arms) if a in own[g] and (replacement or not state[g][k])]
            if step == 1 and start > 1:
                best[g] = scores[g][-1]
            if step == 0 and start > 1:
                for k in sorted(open_, key=lambda k: scores[g][k])[:start]:
                    state[g][k] = 1
                continue
            k = min(open_, key=lambda k: scores[g][k], default=None)
            if k is not None and best[g] - scores[g][k] > gain:
                best[g], state[g][k] = scores[g][k], state[g][k] + 1
            else:
                live.discard(g)
        if not live:
            break
    return state, best


def z_space(wide: DataFrame, groups: list[str], arms: list[str]) -> DataFrame:
    """The wide table with each arm brought to the mean and sd (ddof 0) of its group's labels; an arm that is constant there becomes their mean.

    A blend's weights sum to one, so a blend of these columns is the blend of the arms' z scores on the scale of the labels.
    """
    every = [*arms, "y_true"]
    moments = wide.groupBy(_group_key(groups).alias("_of")).agg(*[e for c in every for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = lambda a: F.when(F.col(f"_s_{a}") > 0, (F.col(a) - F.col(f"_m_{a}")) / F.col(f"_s_{a}")).when(F.col(a).isNotNull(), F.lit(0.0))
    j = wide.withColumn("_of", _group_key(groups)).join(materialise(moments, "moments"), "_of")
    return j.select(*[(z(c) * F.col("_s_y_true") + F.col("_m_y_true")).alias(c) if c in arms else F.col(c) for c in wide.columns])


def greedy_blend(
    wide: DataFrame, groups: list[str], arms: list[str], steps: int = 50, gain: float = 1e-12, metric: str = "mae", macro: str | None = None, replacement: bool = True, space: str = "raw"
) -> DataFrame:
    """``group, arm, count, weight, score``: forward selection from the best single arm for each group.

    With ``macro`` one blend is chosen for all parts that this column names (endpoints, say), by the mean of their scores, each
    part weighing the same however many rows it has. Without ``replacement`` an arm is taken once, so the members are a set. The
    table is written once; each step is one aggregation that scores all candidates of all groups at once, and only
    (groups x arms) scores come to the driver. A group stops when no arm gains more than ``gain``. In ``space`` "z" the arms'
    z scores within a group are blended, and read on the scale of its labels.
    """
    if space not in ("raw", "z"):
        raise ValueError(f"no such space: {space}")
    wide = z_space(wide, groups, arms) if space == "z" else wide
    state, best = _select(wide, groups, arms, steps, gain, metric, macro, replacement, 0, None)
    rows = [(g, a, c, c / max(sum(state[g]), 1), best[g]) for g in sorted(state) for a, c in zip(arms, state[g])]
    return wide.sparkSession.createDataFrame(rows, "group string, arm string, count int, weight double, score double")


def nested_blend(wide: DataFrame, groups: list[str], arms: list[str], folds: int, steps: int = 50, gain: float = 1e-12, metric: str = "mae", fold: str = "fold") -> DataFrame:
    """``group, held, inner_score, held_score, members, same_members``: each fold scored by a blend that was chosen without it.

    ``members`` lists the arms chosen; ``same_members`` is the share of a group's folds that chose the group's most frequent list.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold))
    chosen = greedy_blend(wide.withColumn("held", F.explode(others)), [*groups, "held"], arms, steps, gain, metric)
    at = F.split("group", "\\|")
    chosen = chosen.select(F.array_join(F.slice(at, 1, F.size(at) - 1), "|").alias("group"), F.element_at(at, -1).cast("int").alias("held"), "arm", "weight", "score")
    weights = chosen.groupBy("group", "held").agg(F.map_from_entries(F.collect_list(F.struct("arm", "weight"))).alias("w"), F.max("score").alias("inner_score"))
    j = wide.withColumn("group", _group_key(groups)).withColumn("held", F.col(fold).cast("int")).join(weights, ["group", "held"])
    blend = sum((F.element_at("w", F.lit(a)) * F.col(a) for a in arms), F.lit(0.0))
    loss = F.avg(F.abs(blend - F.col("y_true")))
    if metric != "mae":
        j = j.join(j.groupBy("group", "held").agg(F.avg("y_true").alias("mean")), ["group", "held"])
        loss = F.try_divide(F.sum(soft_error(blend, "conf_low", "conf_high")), F.sum(soft_error("mean", "conf_low", "conf_high")))
    members = F.array_join(F.sort_array(F.map_keys(F.map_filter("w", lambda _, x: x > 0))), "+")
    held = j.groupBy("group", "held", "inner_score", members.alias("members")).agg(loss.alias("held_score"))
    often = held.groupBy("group", "members").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg((F.max("n") / F.sum("n")).alias("same_members"))
    return held.join(often, "group").select("group", "held", "inner_score", "held_score", "members", "same_members")


def bagged_selection(
    wide: DataFrame, groups: list[str], arms: list[str], bags: int = 8, share: float = 0.75, steps: int = 10, seed: int = 7, start: int = 0, metric: str = "mae"
) -> DataFrame:
    """``group, arm, weight``: greedy selection over random arm subsets; weights are the pooled counts' shares.

    All bags are chosen together, a bag being one more group. With ``start`` above one each bag begins with its best ``start`` single
    arms. A row that lacks an arm's prediction, or an unknown setting, is an error.
    """
    if not 0 < share <= 1 or bags < 1 or steps < 1 or not 0 <= start <= max(1, round(share * len(arms))):
        raise ValueError("share must be in (0, 1], bags and steps at least 1, start no more than a bag's arms")
    rng = np.random.default_rng(seed)
    k = max(1, round(share * len(arms)))
    own = {str(b + 1): set(rng.choice(arms, k, replace=False).tolist()) for b in range(bags)}
    state, _ = _select(complete_wide(wide, arms), groups, arms, steps, 1e-12, metric, None, True, start, own)
    total: dict[str, np.ndarray] = {}
    for g, counts in state.items():
        total[g.split("#")[0]] = total.get(g.split("#")[0], np.zeros(len(arms))) + counts
    rows = [(g, a, float(c / t.sum())) for g, t in sorted(total.items()) for a, c in zip(arms, t) if c]
    return wide.sparkSession.createDataFrame(rows, "group string, arm string, weight double")


def gram(wide: DataFrame, keys: list[str], arms: list[str], target: str = "y_true") -> DataFrame:
    """Sums of products of all pairs of columns (and a constant) for each group: what least squares needs, in one pass."""
    cols = {"one": F.lit(1.0)} | {a: F.col(a) for a in arms} | {"y": F.col(target)}
    names = list(cols)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return wide.groupBy(*keys).agg(*[F.sum(cols[a] * cols[b]).alias(f"{a}*{b}") for a, b in pairs])


def _nnls(g: np.ndarray, b: np.ndarray, simplex: bool) -> np.ndarray:
    """Least squares with weights of zero or more (summing to one, if ``simplex``) from Gram sums, by an active set."""
    k = len(b)
    w = np.full(k, 1.0 / k) if simplex else np.zeros(k)
    used = np.full(k, simplex)
    for _ in range(30 * k):
        i = np.flatnonzero(used)
        full = np.zeros(k)
        if len(i):
            a = g[np.ix_(i, i)] + 1e-12 * np.eye(len(i))
            if simplex:
                m = np.block([[a, np.ones((len(i), 1))], [np.ones((1, len(i))), np.zeros((1, 1))]])
                full[i] = np.linalg.lstsq(m, np.append(b[i], 1.0), rcond=None)[0][: len(i)]
            else:
                full[i] = np.linalg.lstsq(a, b[i], rcond=None)[0]
        low = i[full[i] < -1e-12]
        if len(low):  # as far towards it as no weight turns negative, and out with the one that stops this
            step = min(w[j] / max(w[j] - full[j], 1e-300) for j in low)
            w = w + step * (full - w)
            out = low[np.argmin(w[low])]
            w[out], used[out] = 0.0, False
            continue
        w = np.maximum(full, 0)
        slope = b - g @ w
        rest = np.flatnonzero(~used)
        level = slope[used].mean() if simplex else 0.0
        if not len(rest) or slope[rest].max() <= level + 1e-10 * (1 + np.abs(b).max()):
            break
        used[rest[np.argmax(slope[rest])]] = True
    return w


#: Penalties that a stacker tries where none is given.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def _moments(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    n, mean = t[0, 0], t[0] / t[0, 0]
    c = t / n - np.outer(mean, mean)
    return c[1:-1, 1:-1], c[1:-1, -1], n


def _coefficients(t: np.ndarray, kind: str, alpha: float) -> np.ndarray:
    """Weights from one Gram matrix (constant, arms, target)."""
    gm, b, n = _moments(t)
    if kind == "ridge":
        return np.linalg.solve(gm + alpha / n * np.eye(len(b)), b)
    if kind == "enet":
        w = np.zeros(len(b))
        for _ in range(2000):
            before = w.copy()
            for j in range(len(b)):
                rest = b[j] - gm[j] @ w + gm[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - 0.5 * alpha / n, 0) / (gm[j, j] + 0.5 * alpha / n + 1e-15)
            if np.abs(w - before).max() < 1e-13:
                break
        return w
    raw, y = t[1:-1, 1:-1] / t[0, 0], t[1:-1, -1] / t[0, 0]
    if kind == "nnridge":
        return _nnls(raw + alpha / n * np.eye(len(y)), y, False)
    return _nnls(raw, y, kind == "simplex")


def _squared(t: np.ndarray, w: np.ndarray, centred: bool) -> float:
    """Sum of squared errors of weights on rows with Gram matrix ``t``; centred: with the rows' own intercept."""
    if centred:
        gm, b, n = _moments(t)
        y = t[-1, -1] / n - (t[0, -1] / n) ** 2
        return float(n * (y - 2 * w @ b + w @ gm @ w))
    return float(t[-1, -1] - 2 * w @ t[1:-1, -1] + w @ t[1:-1, 1:-1] @ w)


def stack(wide: DataFrame, arms: list[str], kind: str, fold: str = "fold", keys: tuple[str, ...] = ("endpoint",), alpha: float | None = None) -> DataFrame:
    """``keys, fold, arm, coef, alpha`` of a stacker learnt from the other folds: ridge, enet, nnls, nnridge or simplex.

    Spark makes the Gram sums of each fold; a fold's complement is the total less the fold, and the solver sees one
    matrix of (arms + 2) squared numbers for each. Where ``alpha`` is None the penalty comes from the grid ALPHAS by an inner
    cross-validation over the remaining folds, each held out once; the held fold itself takes no part.
    """
    g = gram(wide, [*keys, fold], arms)
    names = ["one", *arms, "y"]
    penal = kind in ("ridge", "enet", "nnridge")

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        mats = []
        for _, row in d.iterrows():
            m = np.zeros((len(names), len(names)))
            for i, a in enumerate(names):
                for j in range(i, len(names)):
                    m[i, j] = m[j, i] = row[f"{a}*{names[j]}"]
            mats.append(m)
        total = sum(mats)
        rows = []
        for k, (_, r) in enumerate(d.iterrows()):
            t, chosen = total - mats[k], alpha if alpha is not None else ALPHAS[0]
            if penal and alpha is None and len(mats) > 2:
                inner = lambda x: sum(_squared(m, _coefficients(t - m, kind, x), kind != "nnridge") for i, m in enumerate(mats) if i != k)  # noqa: B023, E731
                chosen = min(ALPHAS, key=inner)
            w = _coefficients(t, kind, chosen)
            rows += [(*[r[x] for x in keys], int(r[fold]), a, float(x), float(chosen) if penal else None) for a, x in zip(arms, w)]
        return pd.DataFrame(rows, columns=[*keys, fold, "arm", "coef", "alpha"])

    return g.groupBy(*keys).applyInPandas(solve, f"{', '.join(f'{k} string' for k in keys)}, {fold} int, arm string, coef double, alpha double")


def ambiguity(wide: DataFrame, arms: list[str], keys: list[str]) -> DataFrame:
    """Squared error of the average, the members' mean squared error, and the ambiguity: the second less the third is the first."""
    mean = sum((F.col(a) for a in arms), F.lit(0.0)) / len(arms)
    e = lambda p: F.avg((p - F.col("y_true")) ** 2)
    members = sum((e(F.col(a)) for a in arms), F.lit(0.0)) / len(arms)
    amb = sum((F.avg((F.col(a) - mean) ** 2) for a in arms), F.lit(0.0)) / len(arms)
    return wide.groupBy(*keys).agg(e(mean).alias("ensemble"), members.alias("members"), amb.alias("ambiguity"))


def pair_ambiguity(wide: DataFrame, arms: list[str], keys: list[str]) -> DataFrame:
    """Mean squared half-difference of every pair of arms, a column of one pass each."""
    pairs = list(combinations(arms, 2))
    g = wide.groupBy(*keys).agg(*[(F.avg((F.col(a) - F.col(b)) ** 2) / 4).alias(f"{a}_{b}") for a, b in pairs])
    return g.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"), F.col(f"{a}_{b}").alias("ambiguity")) for a, b in pairs])).alias("z")).select(*keys, "z.*")
