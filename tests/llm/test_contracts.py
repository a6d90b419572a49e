"""The registered queries' columns and digests, columns of clashing names, and the pipeline's stages on awkward tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe_codec, chat_format, line_dedup, ogg_media, quality_classifier, quality_rules, registry, simhash, source_mixing, substring_dedup, token_counts

SHAPES = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_source_mixing": "doc_id bigint, source string, mix_slot bigint, mix_offset int",
    "op4_ogg_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_substring_dedup": "doc_id bigint, class_id bigint, n_links bigint, n_spans bigint, n_dup_words bigint",
    "op7_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def rows(spark):
    """Each query's rows over the smallest tables, computed when first asked for."""
    done = {}

    def of(name):
        if name not in done:
            df = registry.QUERIES[name](spark, SMALL)
            done[name] = (dict(df.dtypes), df.collect())
        return done[name]

    return of


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", SHAPES)
def test_columns_and_one_row_a_document(rows, texts, name):
    types, got = rows(name)
    want = dict(x.split(" ") for x in SHAPES[name].split(", "))
    assert {c: types[c] for c in want} == want
    assert sorted(r["doc_id"] for r in got) == sorted(texts)


def test_digests_of_the_queries(rows, texts):
    for r in rows("op2_token_counts")[1]:
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    for r in rows("op4_ogg_media")[1]:
        raw = texts[r["doc_id"]].encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(full), zlib.crc32(full[-16:])) and r["payload_sha256"] == hashlib.sha256(full).hexdigest()
    for r in rows("op7_byte_bpe")[1]:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    for r in rows("op10_quality_classifier")[1]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)


def test_mixing_query_meets_uneven_weights(spark, rows):
    got = rows("op3_source_mixing")[1]
    n = Counter(r["source"] for r in got)
    weights = source_mixing.zipf_weights(spark.read.parquet(f"{SMALL}/documents.parquet"))
    total, first = sum(weights.values()), {}
    blocks = {(r["source"], r["mix_slot"]) for r in got}
    assert len({s for _, s in blocks}) == len(blocks)
    dry = min((max(slot for x, slot in blocks if x == s) for s in n))
    for s in n:
        first[s] = sorted(slot for x, slot in blocks if x == s)
    for t in range(1, dry + 1):
        assert all(abs(np.searchsorted(first[s], t) - t * weights[s] / total) < 1 for s in n)


#: Names that operators use inside, and the earlier ones.
NAMES = ["row", "id", "h", "b", "s", "n", "q", "rest", "rank", "block", "slot", "k", "host", "kept", "bad", "bad_host", "host_ok", "tag", "map_id", "map_tag", "dropped", "n_dropped", "h1", "h2", "run", "keeper", "docs",
         "pos", "line", "key", "fp", "component", "node", "u", "v", "a", "at", "doc", "l", "c", "r", "spans", "hashes", "open", "media", "payload", "shard", "label", "score", "mix_slot", "mix_offset", "size_s", "turn_s", "share_s",
         "_h", "_rank", "_q", "_kept", "_m", "_s", "_b", "_id", "_host", "__id", "__tag", "__dropped", "class_id", "n_links", "words", "ids", "n_tokens", "n_bytes", "rep", "t1", "t2"]
LINE = "a line that stands in many of the documents and is long enough, number "
AWKWARD = [(1, None), (2, ""), (3, "one"), (5, "Ünï çødé 日本 text"), (6, "w " * 3000), (6, "w " * 3000), (None, "no id here at all but some words to keep it in the run of things today"), (7, "\x00 odd \r\n bytes")]


@pytest.fixture(scope="module")
def plain(spark):
    good = lambda k: " ".join(f"word{(k * 37 + j * j) % 9973}x{j}" for j in range(70))
    shared = " ".join(f"common{j}" for j in range(60))
    docs = AWKWARD + [(10 + k, f"{LINE}1\n{good(k)} {shared if k < 3 else ''}\n{LINE}2") for k in range(9)] + [(40, good(1) + " end"), (41, good(1) + " end")]
    return spark.createDataFrame([(i, t, None if i is None else "w" if i < 10 else "s" if i % 3 else "r") for i, t in docs], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def named(plain):
    assert not {"doc_id", "text", "source"} & set(NAMES)
    typed = {"a.b": "map('x', 1, 'y', cast(doc_id as int))", "nested": "array(named_struct('m', map(doc_id is null, array(map('k', 1.5D))), 'b', cast('z' as binary)))", "own.struct": "named_struct('x.y', map(1, 2), 'd', date'2020-01-01')", "gone": "cast(null as map<string,int>)", "raw": "cast(text as binary)"}
    return plain.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES], *[F.expr(e).alias(c) for c, e in typed.items()])


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


OPERATORS = {
    "bitmaps": line_dedup.keep_bitmaps,
    "token_counts": lambda d: token_counts.token_counts(d, tokenizer(token_counts.VOCABULARY)[0]),
    "media": lambda d: ogg_media.read_media(ogg_media.to_media(d)).drop("media", "payload"),
    "near": simhash.near_duplicates,
    "substring": substring_dedup.substring_duplicates,
    "codec": lambda d: bpe_codec.round_trip(d, *tokenizer(bpe_codec.VOCABULARY)),
    "judge": quality_rules.judge,
    "score": lambda d: quality_classifier.score(d, np.ones(1 << 10)),
}
PASSING = {"lines": line_dedup.dedup_lines, "mixed": source_mixing.mixed_stream, "first": simhash.keep_first, "good": quality_rules.keep_good}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_do_not_depend_on_other_columns(plain, named, name):
    assert sorted(map(repr, OPERATORS[name](named).collect())) == sorted(map(repr, OPERATORS[name](plain).collect()))
    assert OPERATORS[name](named.limit(0)).count() == 0


@pytest.mark.parametrize("name", PASSING)
def test_columns_pass_through(plain, named, name):
    out = PASSING[name](named)
    assert out.columns == named.columns
    got = out.collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in NAMES)
    key = lambda r: repr((r["doc_id"], r["text"], r["source"]))
    assert sorted(map(key, got)) == sorted(map(key, PASSING[name](plain).collect()))
    assert PASSING[name](named.limit(0)).columns == named.columns and PASSING[name](named.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    turns = [(1, k, ("user", "assistant", "assistant", "system")[k % 4], "\U0001f600é</s>" * (k % 7) + f"turn {k} " + "x" * (9000 if k % 1999 == 0 else k % 50)) for k in range(6000)]
    out = chat_format.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    r = out.select("formatted", "loss_mask", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [(x["role"], x["text"]) for x in r["t"]] == [(a, t) for _, _, a, t in turns]
    assert r["loss"] == "".join(t for _, _, a, t in turns if a == "assistant")
    again = "".join(r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss_mask"])
    assert again.replace("\\", "") == r["loss"]


def test_mix_replaces_its_own_columns(named):
    out = source_mixing.mix(named)
    assert Counter(out.columns) == Counter(named.columns) and out.where("mix_offset is null").count() == 0 and out.count() == named.count()


def test_stages_on_awkward_and_empty_tables(spark, plain, named):
    for given in (named, named.limit(0)):
        docs = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == named.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept = Counter(r["doc_id"] for r in docs.collect())
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert Counter(r["doc_id"] for r in out.collect()) == kept
        if given is named:
            assert {1, 2, 3}.isdisjoint(kept) and None in kept and {10, 18} & set(kept)


def test_pipeline_leaves_only_its_last_input(spark):
    import glob

    from plumbline.sources import storage

    root = storage.shared_dir(spark).removeprefix("file:").replace("//", "/") + "/plumbline"
    before = set(glob.glob(f"{root}/*"))
    corpus_pipeline.run(spark, SMALL).count()
    new = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{root}/*")) - before}
    assert new == {"stage-source_mixing"}


def test_batches_beyond_the_memory_limit_are_halved():
    import duckdb
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe_codec.VOCABULARY)
    c = bpe_codec.Codec(path, public_tokenizers.PATTERN)
    words = sorted({f"{a}unusualpiece{b}{'ab' * (b % 50)}" for a in "abcdefghij" for b in range(150)})
    real, sizes = c.db, []

    class Tight:
        """The connection, out of memory for more than 100 words and for one long word, or for more than 60 tokens."""

        def __getattr__(self, name):
            return getattr(real, name)

        def register(self, name, rows):
            self.rows = rows
            sizes.append(len(rows))
            return real.register(name, rows)

        def sql(self, query):
            if query == bpe_codec.ENCODE and (len(self.rows) > 100 or len(self.rows) == 1 and len(self.rows["tokens"][0]) > 100) or query == bpe_codec.DECODE and len(self.rows) > 60:
                raise duckdb.OutOfMemoryException("planted")
            return real.sql(query)

    c.db = Tight()
    lone = "x" + "yzw" * 200
    ids = c.encode([" ".join(words), lone])
    ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.whole, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [ranks.encode_ordinary(" ".join(words)), ranks.encode_ordinary(lone)]
    assert [x.decode() for x in c.decode(ids)] == [" ".join(words), lone] and min(sizes) < 100 < max(sizes)
