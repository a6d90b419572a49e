"""Lexical search, toxicity and spelling variants: SQL twin, brute force, planted cases, awkward tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, same_rows

from plumbline.llm import lexical_search, registry, spelling, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- Search ----


def ranked(docs, items, top=20):
    """The contract, word for word, over lists of (id, text)."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, tokens = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        hits = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * total) // tokens
            s = sum(k * int(np.floor(1000 * np.log((2 * total + 2) / (2 * df[t] + 1)))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t, k in asked.items() if t in b)
            if s > 0:
                hits.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(hits)[:top], 1)]
    return out


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_search_is_its_sql(spark, oracle):
    same_rows(registry.QUERIES["op11_lexical_search"](spark, SMALL), oracle(registry.ORACLES["op11_lexical_search"]))


SEARCHED = [(k, f"alpha beta {'gamma ' * (k % 3)}delta{k % 5}") for k in range(60)] + [(100 + k, "alpha beta one copy") for k in range(40)] + [
    (7, None), (8, ""), (9, " .,; "), (200, "Ünï ÜNÏ 日本 alpha" + " filler" * 5000), (201, "rare word here"), (202, "rare word here"), (202, "rare word here"), (None, "rare word here"), (None, "alpha beta one copy")]
ASKED = [(1, "alpha beta"), (2, "rare word rare"), (3, None), (4, "?!"), (5, "delta1 gamma ünï 日本"), (6, "nowhere"), (7, "one copy"), (7, "zz larger text of the same id")]


@pytest.mark.parametrize("pass_terms", [400_000, 3])
def test_search_by_brute_force(spark, pass_terms):
    docs, items = spark.createDataFrame(SEARCHED, "doc_id long, text string"), spark.createDataFrame(ASKED, "item_id long, text string")
    got = tuples(lexical_search.search(docs, items, pass_terms=pass_terms))
    assert got == sorted(ranked(SEARCHED, ASKED[:-1]))
    assert [r[2] for r in got if r[0] == 7] == list(range(100, 120))  # copies: one class, its smallest ids


def test_search_ends_a_tie_of_classes_by_id(spark):
    docs = [(k, f"wanted other{k}") for k in range(50, 0, -1)]  # equal scores, but each with another bag once items hold the rest
    items = [(1, "wanted"), *[(k + 1, f"other{k}") for k in range(1, 51)]]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = tuples(lexical_search.search(*frames))
    assert got == sorted(ranked(docs, items)) and [r[2] for r in got if r[0] == 1] == list(range(1, 21))


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame(SEARCHED, "doc_id long, text string"), spark.createDataFrame(ASKED, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        out = lexical_search.search(d, i)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


# ---- Spelling ----


def variants(docs, min_length=7, min_count=2, ratio=10):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    v = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near, gaps = defaultdict(set), defaultdict(list)
    for w in v:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].append(w)
            if w[:i] + w[i + 1 :] in v:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for own in gaps.values():
        for a in own:
            near[a] |= set(own) - {a}
    form = {}
    for w in v:
        if near[w] and v[f := min(near[w], key=lambda x: (-v[x], x))] >= ratio * v[w]:
            form[w] = f

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), v[w], len(near[w]), v.get(form.get(w))) for w in v)


@pytest.fixture(scope="module")
def misspelt():
    words = ["separate", "necessary", "Straßeën", "beginning", "accommodate", "Été-×÷ÀÁÂÃÄ", "a" * 60, "a" * 61, "b" + "a" * 60]
    docs = []
    for k in range(400):
        typo = words[k % 5]
        typo = typo[: k % 7] + "abcxyzé"[k % 7] + typo[k % 7 + k % 2 :] if k % 9 == 0 else typo
        docs.append((k, f"{typo} {words[k % 4]}, {words[k % 9]}\n{'separete' if k % 40 == 0 else ''} {'seperete' if k in (40, 80) else ''} Ā{words[k % 3]}中{words[4]}"))
    docs += [(401, "seperate " * 130 + "seperete " * 3), (402, "seperxte " * 1500), (406, "grossword " * 400), (407, "grosswore " * 30), (408, "grossyore " * 3), (403, None), (404, ""), (None, "separate necessary " * 40), (405, "short word runs"), (5, docs[5][1])]
    return docs


@pytest.mark.parametrize("options", [spelling.Options(), spelling.Options(filter_bytes=1, long=9), spelling.Options(long=9)])
def test_variants_by_brute_force(spark, misspelt, options):
    got = tuples(spelling.variant_groups(spark.createDataFrame(misspelt, "doc_id long, text string"), options=options))
    want = variants(misspelt)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a form that has a form


def test_variants_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = tuples(registry.QUERIES["op13_spelling_variants"](spark, SMALL))
    assert got == variants(map(tuple, docs.collect())) and len(got) > 500


def test_filters_in_many_windows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_SEGMENT", 16)
    docs = [(k, " ".join(f"word{c}{d}{'xyz' * (k % 4)}ing" for c in "abcdefghij" for d in "klmnop")) for k in range(8)]
    got = tuples(spelling.variant_groups(spark.createDataFrame(docs, "doc_id long, text string"), options=spelling.Options(filter_bytes=16 * 32, long=14)))
    assert got == variants(docs)


def test_variants_without_rows(spark):
    for text in ("", None, "no"):
        assert spelling.variant_groups(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() == []
    assert spelling.variant_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs():
    text = "AbcÉ×ÿDĀe¿f中G1h_\U0001f600i"
    assert [r.decode() for r in spelling.runs(text)] == [r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


# ---- Toxicity ----


def pairs_model(spark, texts):
    rows = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(texts)], "id long, text string, label int")
    return toxicity.train(rows, toxicity.Options(dims=1 << 12, rounds=8, shards=2))


def test_pairs_that_single_terms_cannot_tell(spark):
    """Toxic is an insult with a group or a praise with an object: each word alone stands in as many toxic as clean texts."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(1600):
        first, second = rng.integers(2), rng.integers(2)
        noise = " ".join(f"n{k}" for k in rng.integers(0, 40, 4))
        texts.append((f"{('vile', 'kind')[first]} {('them', 'that')[second]} {noise}", int(first == second)))
    m = pairs_model(spark, texts[:1200])
    fresh = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts[1200:])], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.score(fresh, m).collect()}
    assert np.mean([(got[k] >= 0.5) == y for k, (_, y) in enumerate(texts[1200:])]) > 0.95


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.Model(0.3, rng.normal(size=64), rng.normal(size=(64, 3)))
    texts = ["one two two three elephants", "", None, "elephants elephant elephan one"]
    row, f, v = toxicity.features(texts, 64)
    z = toxicity._forward(m, row, f, v, 4)[0]
    for k in range(4):
        i, x = f[row == k], v[row == k]
        assert len(set(i)) == len(i)
        pairs = sum(m.vectors[i[a]] @ m.vectors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(z[k] - (0.3 + m.linear[i] @ x + pairs)) < 1e-9
    assert not (row == 1).any() and not (row == 2).any()


def test_gradient_step_follows_the_loss():
    """With no steps seen before, one text's update is minus rate times the gradient over its AdaGrad root: checked by differences."""
    o = toxicity.Options(dims=32, factors=2, batch=1)
    rng = np.random.default_rng(2)
    m = toxicity.Model(0.1, rng.normal(size=32), rng.normal(size=(32, 2)))
    f, v = np.array([3, 7, 11]), np.array([0.5, 0.6, 0.62])
    loss = lambda m: np.log1p(np.exp(-toxicity._forward(m, np.zeros(3, int), f, v, 1)[0][0]))  # noqa: E731  label 1
    after = toxicity._learn(m, [(f, v)], np.ones(1), o)
    for i in range(32):
        up, down = (toxicity.Model(m.bias, m.linear.copy(), m.vectors.copy()) for _ in range(2))
        up.linear[i] += 1e-6
        down.linear[i] -= 1e-6
        g = (loss(up) - loss(down)) / 2e-6
        assert abs(after.linear[i] - (m.linear[i] - o.rate * g / np.sqrt(1e-2 + g * g))) < 1e-4
        up.linear[i] = down.linear[i] = m.linear[i]
        up.vectors[i, 1] += 1e-6
        down.vectors[i, 1] -= 1e-6
        g = (loss(up) - loss(down)) / 2e-6
        assert abs(after.vectors[i, 1] - (m.vectors[i, 1] - o.rate * g / np.sqrt(1e-1 + g * g))) < 1e-4


def test_calibration_gives_rates():
    rng = np.random.default_rng(4)
    z = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(3 * z - 1)))).astype(float)
    slope, shift = toxicity._calibrate(z, y)
    assert abs(slope - 3) < 0.2 and abs(shift + 1) < 0.1
    assert toxicity._calibrate(z[:0], y[:0]) == (1.0, 0.0)
    assert all(np.isfinite(toxicity._calibrate(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))))


def test_held_out_toxicity(spark):
    got = registry.QUERIES["op12_toxicity"](spark, SMALL.replace("0.001", "0.1"))
    assert dict(got.dtypes) | {"predicted": "int", "score": "double", "held_out": "boolean", "doc_id": "bigint"} == dict(got.dtypes)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/labels.parquet").collect()}
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in seen) / len(seen) > 0.93
    clean = [p for p, y in seen if not y]
    assert sum(clean) / len(clean) < 0.05


def test_toxicity_of_awkward_rows(spark):
    m = pairs_model(spark, [])
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "long " * 500_000)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as id", "map(1, 2) as m"), m).collect()
    assert sorted(str(r["id"]) for r in got) == ["1", "2", "3", "3", "4", "None"] and len({round(r["score"], 9) for r in got}) <= 4
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), m).collect() == []
