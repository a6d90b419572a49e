"""Folds, holdouts, training populations, exclusions and weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.errors import clip
from plumbline.operators.ranks import hash_number


def exact_kfold(units: DataFrame, id_col: str, k: int, repeats: int) -> DataFrame:
    """``id, repeat_id, fold``: each repeat a fresh hash shuffle, fold sizes differ by one at most.

    Exact sizes need each unit's number within its repeat, which comes from ranges of the hash; :func:`hash_kfold` needs none.
    """
    r = units.select(id_col).distinct().select(id_col, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_id"))
    digest = F.md5(F.concat(F.col(id_col), F.lit(":k"), F.col("repeat_id").cast("string")))
    r = hash_number(r, ["repeat_id"], digest, id_col, "_at", "_of")
    # The first (n mod k) folds have one unit more than the others.
    return r.withColumn("fold", F.expr(f"cast(if(_at <= (_of % {k}) * (_of div {k} + 1), (_at - 1) div (_of div {k} + 1), _of % {k} + (_at - 1 - (_of % {k}) * (_of div {k} + 1)) div greatest(_of div {k}, 1)) as int)")).drop("_at", "_of")


def hash_kfold(units: DataFrame, id_col: str, k: int, repeats: int) -> DataFrame:
    r = units.select(id_col).distinct().select(id_col, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_id"))
    return r.withColumn("fold", F.pmod(F.xxhash64(id_col, "repeat_id"), F.lit(k)).cast("int"))


def fold_overlap(folds: DataFrame, id_col: str) -> DataFrame:
    """Per pair of repeats the share of units in the same fold: one pivot, no self join."""
    reps = F.sort_array(F.collect_list(F.struct("repeat_id", "fold"))).alias("r")
    g = folds.groupBy(id_col).agg(reps)
    p = g.select(F.explode("r").alias("x"), "r").select("x", F.explode("r").alias("y")).where(F.col("x.repeat_id") < F.col("y.repeat_id"))
    return p.groupBy(F.col("x.repeat_id").alias("ra"), F.col("y.repeat_id").alias("rb")).agg(F.avg((F.col("x.fold") == F.col("y.fold")).cast("double")).alias("share"))


def fold_balance(folds: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Labels per (repeat, fold, endpoint), their share of the endpoint's, and a flag below 15 %."""
    g = folds.join(labels.select(id_col, "endpoint"), id_col).groupBy("repeat_id", "endpoint", "fold").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("repeat_id", "endpoint"))
    return g.withColumn("share", share).withColumn("low", F.col("share") < 0.15)


def _turns(at: np.ndarray, size: np.ndarray, loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of one ``size`` go one after the other to the fold of smallest load (the first of equal ones), from ``loads`` on.

    Returns the fold of group number ``at`` (from 0), and how many groups each fold got before it. Fold f's j-th group comes when its
    load is loads[f] + j size, so the order is that of these numbers: the at-th smallest is found by halving.
    """
    size = size[:, None]
    before = lambda v: -(np.minimum(loads - v[:, None], 0) // size)  # noqa: E731  groups that each fold takes below load v
    low, high = loads.min(axis=1), loads.max(axis=1) + (at + 1) * size[:, 0]
    while (high - low > 1).any():
        mid = (low + high) // 2
        few = before(mid).sum(axis=1) <= at
        low, high = np.where(few, mid, low), np.where(few, high, mid)
    got = before(low)
    due = (loads <= low[:, None]) & ((low[:, None] - loads) % size == 0)
    rank = due.cumsum(axis=1)
    left = (at - got.sum(axis=1))[:, None]
    return (due & (rank == left + 1)).argmax(axis=1), got + (due & (rank <= left))


def _first_loads(counts: DataFrame, k: int) -> DataFrame:
    """``n, loads``: the folds' loads before the first group of each size, from the number of groups of each size, largest first.

    N units have fewer than sqrt(2 N) distinct sizes; these pass through one task as a stream.
    """

    def walk(batches):
        loads = np.zeros(k, np.int64)
        for d in batches:
            starts = []
            for size, c in zip(d["n"], d["c"]):
                starts.append(loads)
                got = _turns(np.array([c]), np.array([size]), loads[None])[1][0]
                loads = loads + size * got
            yield pd.DataFrame({"n": d["n"], "loads": starts})

    return counts.repartition(1).sortWithinPartitions(F.col("n").desc()).mapInPandas(walk, "n long, loads array<long>")


def group_folds(groups: DataFrame, group: str, k: int, repeats: int, largest_first: bool) -> DataFrame:
    """``repeat_id, g, n, fold``: whole groups to the currently smallest fold, in a hash order or the largest first.

    Spark reduces the units to group sizes. Largest first, groups of one size follow each other, so what the folds hold before them depends
    on the sizes alone, and each group finds its fold from its number among the groups of its size, in any task. In a hash order each
    group depends on all before it: one task for each repeat reads them as a sorted stream and holds one batch. Units without a group
    are one group; no unit gives an empty result.
    """
    sizes = groups.groupBy(F.col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_id"), "g", "n")
    digest = F.md5(F.concat(F.coalesce("g", F.lit("")), F.lit(":"), F.col("repeat_id").cast("string")))
    out = "repeat_id int, g string, n long, fold int"
    if largest_first:
        starts = _first_loads(sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")), k)
        numbered = hash_number(rows, ["repeat_id", "n"], digest, "g", "at", "_of").join(starts, "n").select("repeat_id", "g", "n", "at", "loads")

        def place(batches):
            for d in batches:
                if len(d):
                    fold = _turns(d["at"].to_numpy() - 1, d["n"].to_numpy(), np.stack(d["loads"].to_list()))[0]
                    yield d[["repeat_id", "g", "n"]].assign(fold=fold)

        return numbered.mapInPandas(place, out)

    def fill(batches):
        loads: dict[int, np.ndarray] = {}
        for d in batches:
            fold = []
            for repeat, size in zip(d["repeat_id"], d["n"]):
                load = loads.setdefault(repeat, np.zeros(k, np.int64))
                fold.append(int(load.argmin()))
                load[fold[-1]] += size
            yield d[["repeat_id", "g", "n"]].assign(fold=fold)

    return rows.withColumn("h", digest).repartition("repeat_id").sortWithinPartitions("repeat_id", "h", "g").mapInPandas(fill, out)


def split_groups(df: DataFrame, group: str) -> DataFrame:
    """Per repeat: groups that stand in more than one fold."""
    g = df.groupBy("repeat_id", group).agg(F.countDistinct("fold").alias("f"))
    return g.groupBy("repeat_id").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("f") > 1).alias("n_split"))


def _best_matching(gain: np.ndarray) -> float:
    """The largest sum of a square table with one cell from each row and column (Hungarian method with potentials)."""
    n = len(gain)
    cost = gain.max() - gain
    row, col, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)  # place 0 is the start of a path
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at] - 1] - row[owner[at]] - col[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            nearest = int(np.where(done, np.inf, least)[1:].argmin()) + 1
            step = least[nearest]
            np.add.at(row, owner[done], step)
            col[done] -= step
            least[~done] -= step
            at = nearest
        while at:
            owner[at], at = owner[back[at]], back[at]
    return float(sum(gain[owner[j] - 1, j - 1] for j in range(1, n + 1)))


def partition_agreement(a: DataFrame, b: DataFrame, id_col: str, k: int) -> DataFrame:
    """Share of equal folds, and the best share over all relabellings: a matching in the k x k table of counts. Null without common ids."""
    cells = a.select(id_col, F.col("fold").alias("x")).join(b.select(id_col, F.col("fold").alias("y")), id_col).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))

    def match(d: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((k, k))
        table[d["x"], d["y"]] = d["n"]
        return pd.DataFrame({"same_share": [np.trace(table) / table.sum()], "best_share": [_best_matching(table) / table.sum()]})

    found = cells.groupBy().applyInPandas(match, "same_share double, best_share double")
    return found.agg(F.max("same_share").alias("same_share"), F.max("best_share").alias("best_share"))


def screen_split(folds: DataFrame, id_col: str, test_fold: int, val_share: float, salt: str = ":v") -> DataFrame:
    """``id, repeat_id, split``: the fold is the test side; of the rest a share in hash order is for validation."""
    pool = folds.withColumn("_test", F.col("fold") == test_fold)
    digest = F.md5(F.concat(F.col(id_col), F.lit(salt), F.col("repeat_id").cast("string")))
    at = hash_number(pool, ["repeat_id", "_test"], digest, id_col, "_at", "_of")
    share = (F.col("_at") - 1) / F.greatest(F.col("_of") - 1, F.lit(1))
    return at.withColumn("split", F.when(F.col("_test"), "test").when(share < val_share, "val").otherwise("train")).select(id_col, "repeat_id", "split")


def manifest(configs: DataFrame, folds: DataFrame) -> DataFrame:
    """Each config with each (repeat, fold) of a fold table, its number of held-out units, and a seed that all configs of the fold share."""
    parts = folds.groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("n_units"))
    grid = configs.crossJoin(parts)
    seed = F.conv(F.substring(F.md5(F.concat(F.lit("seed:"), F.col("repeat_id").cast("string"), F.lit(":"), F.col("fold").cast("string"))), 1, 7), 16, 10)
    return grid.withColumn("seed", seed.cast("long"))


def outlier_flags(df: DataFrame, keys: list[str], value: str, share: float, strict: bool) -> DataFrame:
    """``df`` with ``flag``: above (strict) or at and above the pooled quantile of each group."""
    edge = df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("_e"))
    j = df.join(edge, keys)
    return j.withColumn("flag", F.col(value) > F.col("_e") if strict else F.col(value) >= F.col("_e")).drop("_e")


def winsorise_by_fold(df: DataFrame, folds: DataFrame, id_col: str, value: str, low: float, high: float) -> DataFrame:
    """``repeat_id, fold, lo, hi`` learnt from the other folds: one aggregation for each held-out fold's complement."""
    j = df.join(folds, id_col)
    held = j.select("repeat_id", "endpoint", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))).alias("fold"), value)
    return held.groupBy("repeat_id", "fold", "endpoint").agg(F.count(value).alias("n_train"), F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))


def kde_weights(df: DataFrame, id_col: str, keys: list[str], value: str, cap: float = 5.0, cells: int = 256) -> DataFrame:
    """Inverse density weights by a Gaussian kernel (Scott's width), mean one, then clipped.

    The values are binned to a grid of ``cells`` per group, the kernel runs over the grid (a table of fixed size), and each row
    reads its cell's density: the work grows with the rows, not with their square.
    """
    st = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    st = st.withColumn("bw", F.col("sd") * F.pow("n", F.lit(-0.2))).withColumn("step", F.greatest((F.col("hi") - F.col("lo")) / cells, F.lit(1e-12)))
    j = df.join(st, keys).withColumn("cell", F.least(F.floor((F.col(value) - F.col("lo")) / F.col("step")), F.lit(cells - 1)).cast("int"))
    grid = j.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("c"), F.first("step").alias("step"), F.first("bw").alias("bw"), F.first("n").alias("n"))
    other = grid.select(*keys, F.col("cell").alias("c2"), F.col("c").alias("k2"))
    z = (F.col("cell") - F.col("c2")) * F.col("step") / F.col("bw")
    dens = grid.join(other, keys).groupBy(*keys, "cell").agg((F.sum(F.col("k2") * F.exp(-0.5 * z * z)) / F.max(F.col("n") * F.col("bw") * np.sqrt(2 * np.pi))).alias("density"))
    w = j.join(dens, [*keys, "cell"]).withColumn("raw", 1 / F.col("density"))
    mean = w.groupBy(*keys).agg(F.avg("raw").alias("m"))
    return w.join(mean, keys).select(id_col, *keys, "density", F.least(F.col("raw") / F.col("m"), F.lit(cap)).alias("weight"))


def dead_zone(df: DataFrame) -> DataFrame:
    """``target``: the prediction clipped to the label's interval."""
    return df.withColumn("target", clip("y_pred", "conf_low", "conf_high"))
