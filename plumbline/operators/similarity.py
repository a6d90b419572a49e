"""Similarity joins, nearest neighbours, cliffs, and clustering on neighbour graphs."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.neighbours import cosine_pairs, cosine_tally, nearest  # noqa: F401
from plumbline.operators.ranks import average_rank, hash_number
from plumbline.sources.storage import materialise, release


def token_set(text: Column | str, chars: int | None = None) -> Column:
    """Distinct lower-case words of letters."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.substring(c, 1, chars) if chars else c
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1))


def set_fingerprint(tokens: Column, bits: int) -> Column:
    """Sorted distinct bit numbers of a token set (md5 based, so that every engine agrees)."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int") % bits)))


#: Sets of one posting list that meet in a task; longer lists are dealt as pairs of blocks.
LIST = 2048
#: Words of 64 bits of a set's sketch.
SKETCH = 4
#: Tokens whose counts go to all tasks; the others are less frequent than any of these.
FREQUENT = 100_000
#: Rounds, at most, in which lists meet, postings that are worth a round, and candidates that are compared in a round (a quarter of the sets where that is more).
ROUNDS, POSTINGS, PAIRS = 4, 500_000, 20_000
#: Sets of a cell at most, and cells, about, into which fewer sets are dealt: each two cells meet in a task.
CELL, CELLS = 8192, 12
#: Pairs of cells that are worked on at once; with more cells, as many as these.
MEET = 24
#: Rows of one side and columns of the other that are counted at once, common tokens that are added at once, and tokens that are counted by a dense product at most.
ROWS, COLS, ADDED, DENSE = 512, 1024, 1 << 22, 2048


def _line(tokens: str) -> Column:
    """A set's tokens in order as one string: a third of an array's bytes where it is shuffled. Spaces within tokens are written differently, so that equal lines are equal sets."""
    plain = lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("\\s"))
    return F.array_join(F.transform(F.array_sort(tokens), plain), " ")


def _words(line: str) -> Column:
    return F.split(line, " ")


def _met(dealt: DataFrame, words: list[str], least: float) -> DataFrame:
    """``a, b``: sets that meet in a posting list and that neither their places, their lengths nor their sketches tell apart."""
    left = dealt.select("t", F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("j"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), *[F.col(w).alias(f"x{w}") for w in words])
    right = dealt.select("t", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("p").alias("py"), *[F.col(w).alias(f"y{w}") for w in words])
    wanted = F.ceil((F.col("nx") + F.col("ny")) * least / (1 + least) - 1e-9)
    met = left.join(right, ["t", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & (F.col("x") != F.col("y")))
    met = met.where((F.least("nx", "ny") >= least * F.greatest("nx", "ny")) & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= wanted))
    apart = sum((F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in words), F.lit(0))
    met = met.where(apart <= F.col("nx") + F.col("ny") - 2 * wanted)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def jaccard_pairs(df: DataFrame, id_col: str, tokens: str, least: float, block: int = LIST) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, common, sim`` of representatives (a < b), and ``id, rep, n`` of all members, whose token sets have a Jaccard similarity of ``least`` or more. Exact.

    Tokens are ordered from rare to frequent (the FREQUENT most frequent by their counts behind all others: any order that all sets share gives the same pairs), and only the first n - ceil(least n) + 1 of a set enter the inverted index:
    two sets of the wanted similarity share one of these. Two sets that meet at positions i and j of a token can share one token more than
    the shorter rest behind it at most, so most of those that meet don't become candidates. Lists of more than ``block`` sets are dealt as pairs of blocks to separate tasks, so a token that a third of all
    sets hold is no hot spot. A set's sketch has a bit for each of 64 SKETCH hash values, set if an odd number of its tokens has it: two sketches differ
    in no more bits than the sets differ in tokens, so most of the pairs that meet go before they are written or joined with their sets.
    The sets are compared last. Equal sets are one node each.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens")).where(F.size(tokens) > 0)
    keyed = rows.select("id", _line("tokens").alias("line")).withColumn("set_key", F.md5("line"))
    keyed = materialise(keyed, "token-lists")  # read three times
    freq = keyed.select(F.explode(_words("line")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")).orderBy(F.desc("f"), "t").limit(FREQUENT)
    freq = materialise(freq, "frequent-tokens")
    # The sets are shuffled once, by their key: the tokens meet a table of fixed size and go back to their sets where they are.
    exploded = keyed.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("line").alias("line")).select("set_key", "rep", F.explode(_words("line")).alias("t"))
    hashed, words = F.xxhash64("t"), [f"w{k}" for k in range(SKETCH)]
    own = [F.bit_xor(F.when(F.pmod(hashed, F.lit(SKETCH)) == k, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(t) div {SKETCH}, 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(words)]
    sets = exploded.join(F.broadcast(freq), "t", "left").groupBy("set_key").agg(F.first("rep").alias("rep"), F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))), lambda x: x["t"]).alias("s"), *own)
    ordered = materialise(sets.withColumn("n", F.size("s")), "token-sets")
    own_key = materialise(keyed.select("id", "set_key"), "set-keys")
    release(keyed)
    prefix = ordered.select("rep", "n", *words, F.posexplode(F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("p", "t")).withColumn("t", F.xxhash64("t"))
    lists = prefix.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    dealt = prefix.join(lists, "t").withColumn("k", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = materialise(dealt, "postings")
    cand = None
    rounds = max(1, min(ROUNDS, dealt.count() // POSTINGS))
    for r in range(rounds):  # one after the other: a round's lists leave the disk before the next
        part = materialise(_met(dealt.where(F.pmod("t", F.lit(rounds)) == r), words, least), "set-pairs-met")
        cand = part if cand is None else cand.union(part)
    cand = materialise(cand.distinct(), "set-pairs")  # a written table's size is known: where it is small, the sets needn't be dealt to join it
    release(dealt)
    linked = None
    rounds = max(1, -(-cand.count() // max(PAIRS, ordered.count() // 4)))
    for k in range(rounds):  # one after the other: a round's sets leave the disk before the next
        now = cand.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k)
        paired = now.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        held = materialise(ordered.join(paired, "rep", "left_semi").select("rep", F.array_join("s", " ").alias("s")), "paired-sets")  # of the other sets none is shuffled
        side = lambda s: held.select(F.col("rep").alias(s), F.col("s").alias(f"s{s}"))  # noqa: B023, E731
        both = now.join(side("a"), "a").join(side("b"), "b").select("a", "b", _words("sa").alias("sa"), _words("sb").alias("sb")).withColumn("common", F.size(F.array_intersect("sa", "sb")))
        sim = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))
        part = materialise(both.select("a", "b", "common", sim.alias("sim")).where(F.col("sim") >= least), "set-links")  # read more than once
        release(held)
        linked = part if linked is None else linked.union(part)
    members = own_key.join(ordered.select("set_key", "rep", "n"), "set_key").select("id", "rep", "n")
    return linked, members


def expand_pairs(linked: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids from pairs of representatives and their members (for small groups of equal sets only)."""
    m = lambda s: members.select(F.col("rep").alias(f"r{s}"), F.col("id").alias(f"i{s}"), F.col("n").alias(f"n{s}"))
    cross = linked.join(m("a"), F.col("a") == F.col("ra")).join(m("b"), F.col("b") == F.col("rb")).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "common", "sim")
    same = m("a").join(m("b"), (F.col("ra") == F.col("rb")) & (F.col("ia") < F.col("ib"))).select(F.col("ia").alias("a"), F.col("ib").alias("b"), F.col("na").alias("common"), F.lit(1.0).alias("sim"))
    return cross.union(same)


def membership(linked: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b, common, sim``: linked pairs of representatives, and each other member ``b`` of a class beside its representative ``a``.

    From these every pair of ids follows: a link holds for all members of both classes, and the members of one class are equal.
    """
    own = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.col("n").alias("common"), F.lit(1.0).alias("sim"))
    return linked.union(own)


def class_pairs(linked: DataFrame, members: DataFrame) -> DataFrame:
    """``sim, pairs``: how many pairs of ids have each similarity, from pairs of representatives and the sizes of their classes.

    A class of m equal sets has m (m - 1) / 2 pairs at one; none is made.
    """
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    m = lambda s: sizes.select(F.col("rep").alias(s), F.col("m").alias(f"m{s}"))
    across = linked.join(m("a"), "a").join(m("b"), "b").select("sim", (F.col("ma") * F.col("mb")).alias("pairs"))
    within = sizes.where("m > 1").select(F.lit(1.0).alias("sim"), F.expr("m * (m - 1) div 2").alias("pairs"))
    return across.union(within).groupBy("sim").agg(F.sum("pairs").alias("pairs"))


def _overlaps(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
    """``sim, pairs``: the Jaccard similarities of two cells' sets (``line``) and the pairs of ids (``m`` to a set) that have them; exact.

    Tokens that many sets of both cells have are counted by a dense product, the others by the sets that meet in them.
    """
    sides = [a] if same else [a, b]
    words = [[x.split(" ") for x in d["line"]] for d in sides]
    code = pd.factorize(np.array(list(chain.from_iterable(chain.from_iterable(words))), dtype=object))[0]
    top, at, held = int(code.max()) + 1, 0, []
    for d, w in zip(sides, words):
        n = np.array([len(x) for x in w])
        own = code[at : at + n.sum()]
        at += n.sum()
        order = np.argsort(n, kind="stable")  # sets of like sizes have few different sums of sizes
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        row = np.repeat(place, n)
        by_row = np.argsort(row, kind="stable")
        held.append((n[order], d["m"].to_numpy(float)[order], own[by_row], row[by_row]))
    (na, ma, ta, ra), (nb, mb, tb, rb) = held[0], held[-1]
    fa, fb = np.bincount(ta, minlength=top), np.bincount(tb, minlength=top)
    cost = fa * fb.astype(np.int64)
    dense = np.argsort(-cost, kind="stable")[:DENSE]
    dense = dense[cost[dense] > len(na) * len(nb) // 128]
    number = np.full(top, -1)
    number[dense] = np.arange(len(dense))
    wide = np.zeros((len(dense), len(nb)), np.float32)
    wide[number[tb[number[tb] >= 0]], rb[number[tb] >= 0]] = 1
    rare = number[tb] < 0
    by_token = np.argsort(tb[rare], kind="stable")
    meets, starts = rb[rare][by_token], np.concatenate([[0], np.cumsum(np.where(number < 0, fb, 0))])
    out = []
    edges = np.searchsorted(ra, np.arange(0, len(na) + ROWS, ROWS))
    for s, (x, y) in zip(range(0, len(na), ROWS), zip(edges, edges[1:])):
        rows, t, r = min(ROWS, len(na) - s), ta[x:y], ra[x:y] - s
        some = np.zeros((rows, len(dense)), np.float32)
        some[r[number[t] >= 0], number[t[number[t] >= 0]]] = 1
        common = (some @ wide).astype(np.int32)
        t, r = t[number[t] < 0], r[number[t] < 0]
        much = starts[t + 1] - starts[t]
        t, r, much = t[much > 0], r[much > 0], much[much > 0]
        upto = np.cumsum(much)
        cut = [0, *np.searchsorted(upto, np.arange(ADDED, upto[-1] if len(upto) else 0, ADDED)).tolist(), len(t)]
        for u, v in zip(cut, cut[1:]):
            k = much[u:v]
            first = np.repeat(starts[t[u:v]] - (np.cumsum(k) - k), k)
            found = np.repeat(r[u:v] * len(nb), k) + meets[first + np.arange(len(first))]
            common += np.bincount(found, minlength=common.size).reshape(common.shape).astype(np.int32)
        for c in range(0, len(nb), COLS):
            part, total = common[:, c : c + COLS], na[s : s + rows, None] + nb[None, c : c + COLS]
            weight = ma[s : s + rows, None] * mb[None, c : c + COLS]
            low, span = int(total.min()), int(np.ptp(total)) + 1
            key = part.astype(np.int64) * span + (total - low)
            if same:
                each = np.arange(s, s + rows)[:, None] < np.arange(c, min(c + COLS, len(nb)))[None, :]
                key, weight = key[each], weight[each]
            key, weight = key.ravel(), weight.ravel()
            if not len(key):
                continue
            if key.max() < ADDED:
                count = np.bincount(key, weights=weight)
                which = np.flatnonzero(count)
                count = count[which]
            else:
                which, back = np.unique(key, return_inverse=True)
                count = np.bincount(back, weights=weight)
            both = which // span
            out.append((both / (which % span + low - both), count))
    if same:
        out.append((np.ones(len(ma)), ma * (ma - 1) / 2))
    sim, back = np.unique(np.concatenate([x for x, _ in out]), return_inverse=True)
    pairs = np.bincount(back, weights=np.concatenate([x for _, x in out])).astype(np.int64)
    return pd.DataFrame({"sim": sim[pairs > 0], "pairs": pairs[pairs > 0]})


def jaccard_tally(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """``sim, pairs``: how many of all pairs of ids have each Jaccard similarity of their token sets, zero included; empty sets have none. Exact.

    Equal sets are one row with their number. Sets are dealt into cells, and each two cells meet in a task, which sends a row for each similarity. A few diagonals
    of pairs of cells are worked on at once: a set goes out about twice then, and what was sent leaves the disk before the next. The work grows with the square of the sets.
    """
    sets = df.where(F.size(tokens) > 0).select(_line(tokens).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("m"))
    sets = materialise(sets, "token-classes")
    spark, n = sets.sparkSession, sets.count()
    if not n:
        return spark.createDataFrame([], "sim double, pairs long")
    cells = max(1, -(-n // max(64, min(CELL, -(-n // CELLS)))))
    placed = sets.withColumn("_s", F.pmod(F.xxhash64("line"), F.lit(cells)).cast("int"))
    tally, now = None, []
    for apart in range(cells):
        now += [(k, k + apart) for k in range(cells - apart)]
        if len(now) < max(MEET, cells) and apart < cells - 1:
            continue
        pairs = F.broadcast(spark.createDataFrame(now, "i int, j int"))
        tasks = len(now)
        side = lambda k: placed.join(pairs, F.col("_s") == F.col(k)).select(*[F.col(c).alias(c) for c in ("line", "m", "i", "j")]).repartition(tasks, "i", "j")  # noqa: B023, E731

        def meet(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _overlaps(a, b, key[0] == key[1]) if len(a) and len(b) else pd.DataFrame({"sim": [], "pairs": []})

        met = side("i").groupBy("i", "j").cogroup(side("j").groupBy("i", "j")).applyInPandas(meet, "sim double, pairs long")
        part = materialise(met.groupBy("sim").agg(F.sum("pairs").alias("pairs")), "set-tally")
        tally, now = part if tally is None else tally.union(part), []
    return materialise(tally.groupBy("sim").agg(F.sum("pairs").alias("pairs")), "set-tally")


def tally_summary(tally: DataFrame, parts: int = 4096) -> DataFrame:
    """``n_pairs, mean, middle`` of a tally of similarities from zero to one; only the values in the part of the middle are put in order."""
    cut = tally.withColumn("_b", F.floor(F.col("sim") * parts))
    whole = tally.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.try_divide(F.sum(F.col("sim") * F.col("pairs")), F.sum("pairs")).alias("mean"))
    sums = cut.groupBy("_b").agg(F.sum("pairs").alias("_n"))  # a row for each part
    below = sums.select("_b", "_n", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_below"))
    low, high = F.expr("(n_pairs - 1) div 2"), F.expr("n_pairs div 2")
    at = lambda p, a, n: (F.col(a) <= p) & (p < F.col(a) + F.col(n))
    near = below.crossJoin(whole).where(at(low, "_below", "_n") | at(high, "_below", "_n"))
    run = cut.join(F.broadcast(near), "_b").withColumn("_at", F.col("_below") + F.sum("pairs").over(Window.partitionBy("_b").orderBy("sim")) - F.col("pairs"))
    middle = run.agg(((F.max(F.when(at(low, "_at", "pairs"), F.col("sim"))) + F.max(F.when(at(high, "_at", "pairs"), F.col("sim")))) / 2).alias("middle"))
    return whole.crossJoin(middle)


def class_links(linked: DataFrame, members: DataFrame) -> DataFrame:
    """``id, rep, members, links``: each id with its class of equal sets, the class's size, and to how many other classes it is linked.

    The links are counted by class before they meet the members, so a class with a third of all ids is read once.
    """
    links = linked.select("a").union(linked.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("members")).join(links, "rep", "left")
    return members.select("id", "rep").join(classes, "rep").select("id", "rep", "members", F.coalesce("links", F.lit(0)).alias("links"))


def unit_vectors(df: DataFrame, id_col: str, vec: str, *extra: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.select(F.col(id_col).alias("id"), *extra, F.transform(vec, lambda x: F.try_divide(x.cast("double"), norm)).alias("v"))


def activity_cliffs(pairs: DataFrame, values: DataFrame, id_col: str, value: str, delta: float) -> DataFrame:
    """:func:`valued_cliffs` of pairs that are joined with their values; for pairs that come without."""
    side = lambda s: values.select(F.col(id_col).alias(s), F.col(value).alias(f"y{s}"))
    return valued_cliffs(pairs.join(side("a"), "a").join(side("b"), "b"), delta)


def valued_cliffs(pairs: DataFrame, delta: float) -> DataFrame:
    """Similar pairs (``a, b, sim, ya, yb``) with their difference, score (difference over distance, infinite for identical ones) and flag."""
    j = pairs.withColumn("delta", F.abs(F.col("ya") - F.col("yb")))
    same = F.col("sim") >= 1 - 1e-12
    return j.select("a", "b", "sim", "delta", F.when(same, F.lit(float("inf"))).otherwise(F.try_divide(F.col("delta"), 1 - F.col("sim"))).alias("score"), (F.col("delta") >= delta).alias("is_cliff"), same.alias("identical"))


def leader_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, centroid``: leader clustering of a neighbour graph (columns ``a, b``).

    The sequential walk takes the open node with most neighbours (smallest id first), and its open neighbours with it. Rounds do
    the same at once: every open node that precedes all its open neighbours becomes a centroid and its neighbours are covered
    (a lexicographic maximal independent set), until none is open; then each node joins its first adjacent centroid.
    """
    sym = materialise(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "graph")
    deg = sym.groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    n = nodes.select("id").distinct().join(deg, F.col("id") == F.col("x"), "left").select("id", F.struct((-F.coalesce("d", F.lit(0))).alias("d"), F.col("id").alias("i")).alias("key"))
    state = materialise(n.withColumn("state", F.lit("open")), "leaders")
    while not state.where("state = 'open'").isEmpty():
        o = state.where("state = 'open'")
        near = sym.join(o.select(F.col("id").alias("y"), F.col("key").alias("ky")), "y").groupBy("x").agg(F.min("ky").alias("first"))
        lead = o.join(near, F.col("id") == F.col("x"), "left").where("first is null or key < first").select(F.col("id").alias("lead"))
        lead = materialise(lead, "new-leaders")
        covered = sym.join(lead, F.col("y") == F.col("lead")).select(F.col("x").alias("cov")).distinct()
        new = state.join(lead, F.col("id") == F.col("lead"), "left").join(covered, F.col("id") == F.col("cov"), "left")
        new = new.select("id", "key", F.when(F.col("lead").isNotNull(), "lead").when((F.col("state") == "open") & F.col("cov").isNotNull(), "covered").otherwise(F.col("state")).alias("state"))
        fresh = materialise(new, "leaders")
        release(state)
        state = fresh
    heads = state.where("state = 'lead'").select(F.col("id").alias("y"), F.col("key").alias("ky"))
    mine = sym.join(heads, "y").groupBy("x").agg(F.min("ky").alias("k"))
    return state.join(mine, F.col("id") == F.col("x"), "left").select("id", F.when(F.col("state") == "lead", F.col("id")).otherwise(F.col("k.i")).alias("centroid"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Number of clusters and members, singleton shares, and the sizes' spread."""
    s = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("members"), F.avg((F.col("n") == 1).cast("double")).alias("singleton_share"), (F.count_if(F.col("n") == 1) / F.sum("n")).alias("singleton_member_share"), F.min("n").alias("smallest"), F.median("n").alias("middle"), F.avg("n").alias("mean"), F.max("n").alias("largest"))


def permutation_null(df: DataFrame, id_col: str, cluster: str, value: str, trials: int) -> DataFrame:
    """Mean within-cluster range against ``trials`` hash shuffles of the values: observed, null mean and sd, p.

    A shuffle joins numbers by id with numbers by md5(id, trial); all trials are one plan, and each is numbered by ranges of its hash.
    Ids are distinct; numeric ones are numbered once for all trials, by ranges too. Both sides of the join have a row for each unit and trial, which Spark
    judges by the size of the units' file: hence the hint, or all of them are broadcast through the driver.
    """
    t = F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("t")
    ids = F.col(id_col).cast("string")
    if dict(df.dtypes)[id_col] in ("smallint", "int", "bigint", "float", "double"):
        slots = average_rank(df.select(id_col, cluster), [], id_col, "k", 64).withColumn("k", F.col("k").cast("long"))
    else:
        slots = df.select(id_col, cluster).withColumn("k", F.row_number().over(Window.orderBy(id_col)).cast("long"))
    slots = slots.select(cluster, "k", t)
    vals = hash_number(df.select(id_col, value, t), ["t"], F.md5(F.concat_ws(":", ids, F.col("t").cast("string"))), id_col, "k", "_of")
    span = lambda d, keys: d.groupBy(*keys, cluster).agg((F.max(value) - F.min(value)).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    null = span(slots.select("t", "k", cluster).join(vals.select("t", "k", value).hint("merge"), ["t", "k"]), ["t"]).groupBy("t").agg(F.avg("s").alias("s"))
    obs = span(df, []).agg(F.avg("s").alias("observed"))
    return null.crossJoin(obs).agg(F.max("observed").alias("observed"), F.avg("s").alias("null_mean"), F.stddev_samp("s").alias("null_sd"), F.avg((F.col("s") >= F.col("observed") - 1e-6).cast("double")).alias("p"))


def analog_holdout(pairs: DataFrame, values: DataFrame, id_col: str, value: str, seeds: int, per_seed: int) -> DataFrame:
    """``seed, id, sim, slot``: the top seeds' most similar candidates; a candidate goes to its most similar seed only."""
    top = values.orderBy(F.col(value).desc(), id_col).limit(seeds).select(F.col(id_col).alias("seed"))
    sym = pairs.select("a", "b", "sim").union(pairs.select("b", "a", "sim"))
    near = sym.join(F.broadcast(top), F.col("a") == F.col("seed")).select("seed", F.col("b").alias("id"), "sim").join(F.broadcast(top.withColumnRenamed("seed", "id")), "id", "left_anti")
    near = near.withColumn("slot", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("sim").desc(), "id"))).where(F.col("slot") <= per_seed)
    return near.withColumn("claim", F.row_number().over(Window.partitionBy("id").orderBy(F.col("sim").desc(), "seed"))).where("claim = 1").drop("claim")
