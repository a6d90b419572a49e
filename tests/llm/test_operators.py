"""The corpus operators against brute force, round trips and awkward rows."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from plumbline.llm import bpe_codec, chat_format, line_dedup, ogg_media, quality_classifier, quality_rules, registry, simhash, source_mixing, substring_dedup, token_counts

LONG = "a line that is certainly longer than forty characters, number "
AWKWARD = [(1, None), (2, ""), (3, "one"), (4, "x y\n\n  z"), (5, "Ünï çødé 日本 \U0001f600 text"), (6, "word " * 5000), (6, "word " * 5000), (None, "no id here at all"), (7, "\x00\x07 odd \r\n bytes"), (8, "a b c d e f g h i j k l")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, fp long"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 0, 9, "k", 1) for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def tokenizer_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, oracle, name):
    same_rows(registry.QUERIES[name](spark, SMALL), oracle(registry.ORACLES[name]))


def test_lines_awkward_and_empty(spark, awkward):
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == sorted((i or -1, t or "") for i, t in AWKWARD)
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


def test_lines_stay_in_the_largest_document_only(spark):
    rows = [(i, f"{LONG}A\nown text of document {i}\n {LONG.upper()}a\t") for i in range(6)] + [(9, f"{LONG}A"), (9, f"x\n{LONG}A")]
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r["text"])
    assert got[3] == ["own text of document 3"]
    assert sorted(got[9]) == sorted([f"{LONG}A", f"x\n{LONG}A"])
    four = spark.createDataFrame(rows[:4], "doc_id long, text string")
    assert all(r["text"].count("\n") == 2 for r in line_dedup.dedup_lines(four).collect())


def test_bitmaps_are_runs(spark):
    body = "\n".join(f"{LONG}{k}" for k in range(4))
    rows = [(i, body + f"\nkeep {i}\n" + body) for i in range(6)]
    runs = {r["id"]: [(x["start"], x["length"]) for x in r["dropped"]] for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert runs == {i: [(0, 4), (5, 4)] for i in range(5)}


def test_token_counts_match_the_library(spark, awkward, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path(token_counts.VOCABULARY)
    lib = Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = [*"strvlemd' \n\t a1!é<|", "'re", "'ll", "<|endoftext|>", "  ", "　"]
    cases = [t or "" for _, t in AWKWARD] + list(texts.values())[:80] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    assert token_counts.count_tokens(cases, path) == [len(e.ids) for e in lib.encode_batch(cases, add_special_tokens=False)]
    out = {(r["id"], r["n_bytes"]): r["n_tokens"] for r in token_counts.token_counts(awkward, path).collect()}
    assert out[1, 0] == 0 and out[2, 0] == 0 and token_counts.token_counts(awkward.limit(0), path).count() == 0


def test_chunked_states_equal_one_pass():
    nxt, here, before = token_counts.split_transducer()
    rng = np.random.default_rng(1)
    classes = rng.integers(0, token_counts.N_CLASSES, 5000).astype(np.uint8)
    state, starts = 0, set()
    for i, c in enumerate(classes):
        if here[c, state]:
            starts.add(i)
        if before[c, state]:
            starts.add(i - 1)
        state = nxt[c, state]
    assert set(token_counts.word_starts(classes).tolist()) == starts


def test_mixing_deviates_by_less_than_a_block(spark):
    sizes = {"a": 900, "b": 300, "c": 70, None: 20}
    rows = [(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows + [(1, "a"), (None, "b")], "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    out = source_mixing.mix(df, weights=weights, block_docs=10, period=20).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((r["doc_id"], r["source"]) for r in df.collect())
    assert len({(r["mix_slot"], r["mix_offset"]) for r in out}) == len(out)
    source = {r["mix_slot"]: r["source"] for r in out}
    share = {"a": 10, "b": 6, "c": 3, None: 1}
    until = min(-(-(n // 10) * 20 // share[s]) for s, n in sizes.items()) - 1
    seen = Counter()
    for slot in range(until):
        seen[source[slot]] += 1
        assert all(abs(seen[s] - (slot + 1) * q / 20) < 1 for s, q in share.items())
    assert source_mixing.mix(df.limit(0)).count() == 0
    assert source_mixing.mixed_stream(df).columns == df.columns


def brute_schedule(share, slots):
    """Earliest deadline first over all sources at each slot, with fractions."""
    total, done, out = sum(share.values()), Counter(), []
    for t in range(slots):
        open_ = [(-(-(done[s] + 1) * total // n), i, s) for i, (s, n) in enumerate(share.items()) if done[s] * total // n <= t]
        s = min(open_)[2]
        done[s] += 1
        out.append(s)
    return out


SKEWED = [
    {"a": 1.0}, {"a": 7, "b": 5, "c": 1}, {str(i): 3 for i in range(9)}, {"big": 0.5, **{str(i): 0.025 for i in range(20)}}, {"big": 0.5, **{str(i): 0.5 / 300 for i in range(300)}},
    {str(i): 1 / (i + 1) for i in range(12)}, {str(i): float(i + 1) ** 0.5 for i in range(40)}, {"rare": 1e-5, "most": 1 - 1e-5},
]


@pytest.mark.parametrize("weights", SKEWED, ids=range(len(SKEWED)))
def test_schedule_meets_the_weights(weights):
    share = source_mixing.shares(weights)
    slots = source_mixing.schedule(weights)
    total, given = sum(share.values()), sum(weights.values())
    assert all(abs(n / total - weights[s] / given) < 1e-5 for s, n in share.items())
    assert slots[:3000] == brute_schedule(share, len(slots))[:3000] if len(slots) <= 3000 else slots[:500] == brute_schedule(share, 500)
    seen = Counter()
    for t, s in enumerate(slots):
        seen[s] += 1
        if t % 7 == 0 or t < 500:
            assert all(abs(seen[x] * total - (t + 1) * n) < total for x, n in share.items())
    if len(slots) == total:
        assert seen == share  # every further cycle is alike and adds no deviation
    assert set(slots) == set(weights)


def test_mixing_is_repeatable_with_repeated_ids(spark):
    rows = [(k % 3, f"text {k}", "s") for k in range(300)] + [(None, f"n {k}", None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(repr, source_mixing.mix(x, block_docs=7).collect())) for x in (df, df.repartition(5)))
    assert a == b and len(a) == 600


def test_ogg_round_trip_and_damage(spark, awkward):
    for t in ("", "x", "ab" * 5000, "日本" * 90000):
        payload, n = ogg_media.to_payload(t)
        media = ogg_media.mux(payload, n)
        found, pages, bad = ogg_media.demux(media)
        assert bad == 0 and b"".join(p for s, k, _, p in found if s == ogg_media.SAMPLES and k) == payload and len(payload) % 192 == 0
        assert [g for s, k, g, _ in found if s == ogg_media.SAMPLES][-1] == len(payload)
        assert media[:4] == b"OggS"
        hurt = bytearray(media)
        hurt[len(media) // 2] ^= 1
        assert ogg_media.demux(bytes(hurt))[2] >= 1
        assert ogg_media.demux(media[:-3])[2] >= 1
    assert ogg_media.demux(None) == ([], 0, 0) and ogg_media.demux(b"junk")[2] == 1
    media = ogg_media.to_media(awkward)
    rows = {r["id"]: r for r in ogg_media.read_media(media).collect()}
    assert rows[1]["n_bytes"] == 0 and bytes(rows[1]["payload"]) == b" " * 192 and len(rows) == len({i for i, _ in AWKWARD})
    ends = [r["end_seconds"] for r in ogg_media.packets(media).where("id = 6 and serial = 1").orderBy("packet").collect()]
    assert ends == sorted(ends) and ends[-1] == -(-25000 // 192) * 192 / 8000


def test_ogg_checksum_is_the_bitwise_one():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
        return crc

    for d in (b"", b"a", b"OggS and so on" * 9):
        assert ogg_media.page_checksum(d) == slow(d)


def brute_components(fps, ids):
    par = list(range(len(ids)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            par[b] = a
    return {d: ids[find(k)] for k, d in enumerate(ids)}


def test_simhash_links_by_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {0}
    for b in base:
        x = b
        for _ in range(12):
            x = x ^ np.uint64(1 << int(rng.integers(0, 64))) ^ np.uint64(1 << int(rng.integers(0, 64)))
            fps.add(int(x))
    fps = np.array(sorted(fps), np.uint64)
    for block in (1024, 7):
        links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), block).collect()
        assert all((int(r["a"]) ^ int(r["b"])).bit_count() <= 3 or ((int(r["a"]) ^ int(r["b"])) & (1 << 64) - 1).bit_count() <= 3 for r in links)
        par = {int(x): int(x) for x in fps}

        def find(x):
            while par[x] != x:
                x = par[x]
            return x

        for r in links:
            a, b = sorted((find(r["a"] & (1 << 64) - 1), find(r["b"] & (1 << 64) - 1)))
            par[b] = a
        want = brute_components(fps, [int(x) for x in fps])
        assert {x: find(x) for x in par} == want


def test_simhash_query_and_awkward_rows(spark, texts, awkward):
    ids = sorted(texts)
    fps = np.array([simhash.simhash(texts[i]) for i in ids], np.int64).view(np.uint64)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op5_simhash_near_dedup"](spark, SMALL).collect()}
    want = brute_components(fps, ids)
    assert got == {i: (f"{int(f):016x}", want[i]) for i, f in zip(ids, fps)}
    out = simhash.near_duplicates(awkward).collect()
    comp = {r["id"]: r["component"] for r in out}
    assert len(out) == len(AWKWARD) and comp[1] == comp[2] == 1 and comp[6] == 6
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 6, 7, 8]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_simhash_by_definition():
    import xxhash

    t = "One two THREE four five six"
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.simhash(t) & (1 << 64) - 1 == want and simhash.simhash(" \n") == 0


def test_compact_windows_cover_each_long_subsequence_once():
    rng = np.random.default_rng(2)
    v = rng.permutation(120).astype(np.uint64)
    w = substring_dedup.compact_windows(v, 10)
    for i in range(120):
        for j in range(i + 9, 120):
            c = i + int(v[i : j + 1].argmin())
            assert sum(a <= i and j <= z and m == c for a, m, z in w) == 1


def passage(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_substring_passages_planted(spark, awkward):
    rng = random.Random(6)
    shared, near, short = passage(rng, 70), passage(rng, 120), passage(rng, 30)
    edited = list(near)
    edited[60] = "changed"
    docs = [(i, passage(rng, 80) + (shared if i % 2 else []) + passage(rng, 80) + short) for i in range(1, 9)]
    docs += [(20, passage(rng, 40) + near + passage(rng, 40)), (21, passage(rng, 90) + edited), (30, passage(rng, 300))]
    got = {r["id"]: r for r in substring_dedup.substring_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()}
    words = dict(docs)
    for i in (1, 3, 5, 7):
        assert got[i]["class_id"] == 1 and [words[i][s["start"] : s["end"]] for s in got[i]["spans"]] == [shared]
    for i in (2, 4, 6, 8, 30):
        assert got[i]["n_spans"] == 0 and got[i]["class_id"] == i and got[i]["n_links"] == 0
    assert got[21]["class_id"] == 20 and got[20]["n_dup_words"] >= 110
    out = substring_dedup.substring_duplicates(awkward).collect()
    assert len(out) == len(AWKWARD) and all(r["n_spans"] == 0 for r in out)
    assert substring_dedup.substring_duplicates(awkward.limit(0)).count() == 0


def test_bpe_matches_the_library(spark, texts, awkward):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path(bpe_codec.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cases = [(i, t) for i, t in AWKWARD] + list(texts.items())[:60] + [(99, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab <|endoftext|> zzz​")]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.round_trip(df, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in cases:
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = bpe_codec.decode(bpe_codec.encode(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert Counter(bytes(r["decoded"]) for r in back) == Counter((t or "").encode() for _, t in cases)
    assert bpe_codec.round_trip(awkward.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_chat_reads_back_what_it_formats(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "\\<|part|>\\\\", "<<SYS>> <\\|x", "", None, "ends with <", "| starts", "a\nb\\"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "user", "assistant", "assistant", "assistant", None, "user", "<|role|>"], nasty))]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, "assistant", "first"), (None, 0, "user", "no id")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["t"]] == [(r or "", t or "") for _, _, r, t in rows[:9]]
    assert got[1]["loss"] == "".join(t or "" for _, _, r, t in rows[:9] if r == "assistant")
    assert [(x["role"], x["text"]) for x in got[2]["t"]] == [("assistant", "first"), ("user", "same"), ("user", "same")]
    assert "[INST]" not in got[1]["formatted"] and "</s>" not in got[1]["formatted"] and None in got
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quality_rules_awkward_and_hosts(spark, awkward):
    out = quality_rules.judge(awkward).collect()
    by = {r["id"]: r for r in out}
    assert len(out) == len(AWKWARD) and by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[2]["kept"]
    assert by[6]["n_words"] == 5000 and by[6]["n_repeat_words"] == 5000 and by[6]["base_failed"] and not by[8]["base_failed"]
    assert quality_rules.keep_good(awkward).columns == awkward.columns
    rng = random.Random(3)
    good = lambda k: " ".join(f"{rng.choice('abcdef')}{rng.randrange(999)}" for _ in range(40))
    junk = lambda: " ".join(f"{rng.randrange(999)}###$$$" for _ in range(40))
    rows = [(i, good(i), "good") for i in range(200)] + [(1000 + i, junk(), "bad") for i in range(150)] + [(2000, good(0), "bad"), (2001, good(0), None)]
    kept = {r["id"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {*range(200), 2001}
    assert quality_rules.judge(awkward.limit(0)).count() == 0


def test_classifier_holds_out_and_scores(spark, awkward):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(60))) for i in range(600)]
    docs = spark.createDataFrame(rows + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(600)] + [(1, None), (2, 1)], "doc_id long, quality int")
    train = quality_classifier.training_rows(docs, labels)
    assert all(zlib.crc32(str(r["id"]).encode()) % 4 != 2 for r in train.collect())
    w = quality_classifier.train(train)
    got = {r["id"]: r["score"] for r in quality_classifier.score(docs.where("text is not null"), w).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert quality_classifier.score(awkward, w).count() == len(AWKWARD)
    none = quality_classifier.train(train.limit(0))
    assert not none.any() and quality_classifier.score(awkward.limit(0), none).count() == 0


def test_pipeline_against_its_stages(spark, texts):
    import corpus_pipeline
    import public_tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["id"] for r in quality_rules.judge(docs).where("kept").collect()}
    alive = {i: t for i, t in texts.items() if i in kept}
    keys = defaultdict(set)
    strip, low = " \t\n\x0b\x0c\r", str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t in alive.items():
        for ln in t.split("\n"):
            k = ln.strip(strip).translate(low)
            if len(k) >= 40:
                keys[k].add(i)
    common = {k: max(v) for k, v in keys.items() if len(v) >= 5}
    cut = {i: "\n".join(ln for ln in t.split("\n") if common.get(ln.strip(strip).translate(low), i) == i) for i, t in alive.items()}
    ids = sorted(cut)
    comp = brute_components(np.array([simhash.simhash(cut[i]) for i in ids], np.int64).view(np.uint64), ids)
    want = {i: hashlib.sha256(cut[i].encode()).hexdigest() for i in ids if comp[i] == i}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want
    assert public_tokenizers.PATTERN
