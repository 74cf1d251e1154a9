"""Fingerprints, sharding, tokens, language: edge cases and brute force."""

import base64
import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quadweave.llm import bpe, fingerprints, language_id, queries, sharding, textkit, token_counts
from quadweave.llm.shared import documents

SMALL = "/root/testdata/sf0.001"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 60_000 + "x" * 200_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    rows = [
        (1, None, "id", 1), (2, "", "fp", 2), (3, " \n", "text", None), (4, LONG, None, 3), (5, "Same text here", "n", 4), (5, "Same text here", "n", 4),
        (6, "same  TEXT here", "s", 5), (7, "日本語 テキスト 😀", "h", 6), (8, "<|endoftext|> is text", "rank", 7), (None, "no id", "parcel", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, size int")


def texts(spark):
    return {r.doc_id: r.text for r in documents(spark, SMALL).select("doc_id", "text").collect()}


def test_word_hashes_match_words():
    rnd = random.Random(3)
    some = [bytes(rnd.choice(b"abAB \t\n\x0b\x0c\r.") for _ in range(rnd.randrange(0, 50))) for _ in range(300)]
    hashes, at = textkit.hashed_words(some)
    words = [t.lower().split() for t in some]
    assert np.diff(at).tolist() == [len(w) for w in words]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for ws in words for w in ws], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert int(textkit.hashed_words([b"x" * 3_000_000 + b" abc"])[0][1]) == int(textkit.hashed_words([b"abc"])[0][0])


def test_word_hashes_of_long_texts_do_not_depend_on_pieces():
    words = [b"w%d" % (i % 977) for i in range(400_000)]
    long, _ = textkit.hashed_words([b" ".join(words)])
    short, _ = textkit.hashed_words([b" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
    assert (long == short).all()


def test_canonical():
    assert fingerprints.canonical("ＡＢ  ć") == unicodedata.normalize("NFKC", "ab ć").encode()
    assert fingerprints.canonical("Straße") == fingerprints.canonical("STRASSE")
    assert fingerprints.canonical(None) == fingerprints.canonical(" \n\t") == b""


def test_fingerprint_groups(spark, odd):
    got = fingerprints.fingerprint(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {1, 2, 3} in by.values() and {5, 6} in by.values()
    assert {r.group_id for r in got if r.doc_id in (5, 6)} == {5}
    assert fingerprints.fingerprint(odd.limit(0)).isEmpty()


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = [(i, f"Text  {i // 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    short = fingerprints.digests(docs, width=1)
    assert short.select("fp").distinct().count() <= 16
    got = {r.id: (r.fingerprint, r.group_id) for r in fingerprints.resolve(short, docs, width=1).collect()}
    assert all(got[i] == got[i + 1] and got[i][1] == i for i in range(0, 200, 2))
    assert len({f for f, _ in got.values()}) == 100


def test_op1_against_brute_force(spark):
    want = sorted(texts(spark).items())
    got = {r.doc_id: r for r in queries.QUERIES["op1_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(want)
    for (i, t), (_, following) in zip(want, want[1:] + want[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.digest(fingerprints.canonical(t))
        assert r.edited_fingerprint == fingerprints.digest(fingerprints.canonical(edited))
        assert r.near_next == float(fingerprints.canonical(t) == fingerprints.canonical(following))


def test_rows_that_repeat_an_id_keep_their_own_fingerprints(spark, tmp_path):
    rows = [(1, "one"), (2, "two"), (2, "three"), (3, "Two"), (None, "one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_fingerprints"](spark, str(tmp_path)).collect()
    want = {"one": 1, "two": 2, "three": 2, "": None}
    assert sorted((r.fingerprint, r.group_id or 0) for r in got) == sorted((fingerprints.digest(t.lower().encode()), want[t.lower()] or 0) for t in ("one", "two", "three", "Two", "one", ""))
    got = fingerprints.fingerprint(docs).collect()
    assert len(got) == 6 and {(r.doc_id, r.group_id) for r in got} == {(1, 1), (2, 2), (3, 2), (None, 1), (None, None)}


def test_edits_of_odd_rows(spark, odd):
    got = fingerprints.edits(odd).collect()
    assert len(got) == odd.count()
    assert {r.n_chars for r in got if r.id in (1, 2)} == {0}
    assert fingerprints.edits(odd.limit(0)).isEmpty()
    (one,) = fingerprints.edits(odd.where("doc_id = 6")).collect()
    assert one.near_next == 1.0


def test_pack_balances():
    rnd = np.random.default_rng(0)
    items = np.column_stack([rnd.lognormal(5, 1, 4000), rnd.lognormal(3, 1, 4000), np.ones(4000)])
    loads = np.zeros((40, 3))
    np.add.at(loads, sharding.pack(items, 40), items)
    assert (loads.max(0) / loads.mean(0) < 1.02).all()
    assert sharding.pack(np.zeros((0, 3)), 4).tolist() == []


def test_sharding_law(spark):
    got = queries.QUERIES["op4_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    assert len(got) == len(want) and got.shard.between(0, 39).all() and set(got.law) == {"bytes"}
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() <= 1.1 * sizes.mean()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    for r in got.itertuples():
        raw = want[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_sharding_splits_hot_groups_only(spark, odd):
    rows = [(i, "copy") for i in range(900)] + [(1000 + i, f"own {i // 2}") for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, task_groups=50).toPandas()
    counts = got.groupby("shard").doc_id.count()
    assert len(counts) == 4 and counts.max() <= 1.1 * counts.mean()
    places = got.groupby("text_crc32").shard.nunique()
    assert places[zlib.crc32(b"copy")] > 1 and (places.drop(zlib.crc32(b"copy")) == 1).all()
    some = {r.doc_id: r for r in sharding.shard(odd, shards=3).collect()}
    assert sharding.shard(odd, shards=3).count() == odd.count()
    assert (some[1].size, some[1].n_words, some[2].size) == (16, 0, 16) and some[4].size == len(LONG) + 16 and some[None].n_words == 2
    assert sharding.shard(odd.limit(0)).isEmpty()


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_sharding_keeps_equal_texts_together(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    got = sharding.shard(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert (got.groupby("text").shard.nunique() == 1).all()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.05 * sizes.mean()


def test_packing_against_brute_force():
    rnd = random.Random(6)
    items = [[rnd.randrange(1, 900), rnd.randrange(1, 90), 1] for _ in range(300)]
    totals = [sum(c) for c in zip(*items, strict=True)]
    free, want = [[1.0, 1.0, 1.0] for _ in range(7)], {}
    loads = {i: [x / t * 7 for x, t in zip(item, totals, strict=True)] for i, item in enumerate(items)}
    for i in sorted(loads, key=lambda i: (-max(loads[i]), i)):
        dots = [sum(a * b for a, b in zip(f, loads[i], strict=True)) for f in free]
        want[i] = max(range(7), key=lambda s: (round(dots[s], 12), -s))
        free[want[i]] = [a - b for a, b in zip(free[want[i]], loads[i], strict=True)]
    assert sharding.pack(np.array(items, float), 7).tolist() == [want[i] for i in range(300)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "th", "ing", "   ", "\n", "\t", " ", "é", "ß", "日本", "😀", "1", "23", "!!", "...", "'s", "'LL", "<|endoftext|>", "​", "\x00", "́", "aaaaaaaa", "----"]
    for _ in range(n):
        yield "".join(rnd.choice(parts) if rnd.random() < 0.8 else chr(rnd.randrange(160, 0x2FFF)) for _ in range(rnd.randrange(60)))


def test_transducer_equals_merging(reference):
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in [*noise(800), LONG, "a" * 50_000, "=-" * 20_000]:
        ids = c.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert "".join(c.decode_stream(ids, 7)) == t
    rnd = random.Random(5)
    for _ in range(800):
        raw = bytes(rnd.choice(b"abcdeth in\xc3\xa9\xe2") for _ in range(rnd.randrange(1, 90)))
        assert c.machine.encode(raw) == reference._core_bpe.encode_single_piece(raw)
    tiny = bpe.Codec(RANKS, public_tokenizers.PATTERN, cache=60)  # states, pairs and ids are forgotten again and again
    for t in noise(60, 8):
        assert tiny.encode(t) == reference.encode_ordinary(t)


def test_utf8_stream_equals_whole_decoding():
    rnd = random.Random(2)
    for _ in range(500):
        raw = b"".join(rnd.choice([b"a", "é".encode(), "日".encode(), "😀".encode(), b"\xff", b"\xe2\x82", b"\xf0\x9f", b"\xc0", b"\xed\xa0"]) for _ in range(12))
        stream = bpe.Utf8Stream()
        cuts = sorted(rnd.sample(range(len(raw) + 1), min(4, len(raw))))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        assert "".join(stream.feed(p) for p in parts) + stream.close() == raw.decode("utf-8", "replace")


def test_op6_and_op10(spark, reference, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    want = texts(spark)
    six = {r.doc_id: r for r in queries.QUERIES["op6_bpe_codec"](spark, SMALL).collect()}
    ten = {r.doc_id: r for r in queries.QUERIES["op10_token_counts"](spark, SMALL).collect()}
    for i, t in want.items():
        ids = reference.encode_ordinary(t)
        assert (six[i].n_tokens, six[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert six[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (ten[i].n_bytes, ten[i].n_tokens, ten[i].over_limit) == (len(t.encode()), n, n > 1024)
    for r in token_counts.count_tokens(odd, JSON).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)
    back = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())
    assert token_counts.count_tokens(odd.limit(0), JSON).isEmpty() and bpe.round_trip(odd.limit(0), RANKS, public_tokenizers.PATTERN).isEmpty()


def test_whole_tokens_are_proven():
    c = token_counts.counter(JSON)
    for t in list(c.whole)[::997]:
        assert len(c.merged(t)) == 1 and c.split.findall(t) == [t]
    for t in noise(200, 9):
        assert c._plain(t) == sum(len(c.merged(p)) for p in c.split.findall(t))


def test_language_accuracy_and_edges(spark, odd):
    got = queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    held = got.where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.where("score < 0 or score > 1").isEmpty()
    model = language_id.learn(documents(spark, SMALL))
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].rejected and rows[1].score == 0
    assert rows[5].lang_pred in model
    assert language_id.predict(odd.limit(0), model).isEmpty()
    assert language_id.learn(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) == {}
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}
    assert language_id.keep(odd, model).columns == odd.columns


def test_language_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SMALL).select("doc_id", "text").limit(60).collect()]
    rows += [(10_001, "zzz"), (10_002, "q"), (10_003, "12 34")]
    model = language_id.learn(documents(spark, SMALL))
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    kept = {r.doc_id for r in language_id.keep(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        sizes = {}
        for lang, content in sorted(model.items()):
            own = language_id.zstandard.ZstdCompressionDict(content, dict_type=language_id.zstandard.DICT_TYPE_RAWCONTENT)
            params = language_id.zstandard.ZstdCompressionParameters(
                window_log=18, hash_log=13, chain_log=13, search_log=4, min_match=4, target_length=32,
                strategy=language_id.zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            raw = language_id.letters(text)
            sizes[lang] = sum(
                len(language_id.zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(bytes(256) + raw[k : k + 4096])) for k in range(0, len(raw), 4096)
            )
        least, after = sorted(sizes.values())[:2]
        if i == 10_003:
            assert (got[i].lang_pred, got[i].rejected) == ("und", True)
            continue
        assert got[i].lang_pred == min(sizes, key=lambda k: (sizes[k], k))
        assert math.isclose(got[i].margin, (after - least) / after) and got[i].rejected == (got[i].margin <= language_id.MARGIN) == (i not in kept)
    assert got[10_002].rejected  # a tie, however short the text


def test_dictionaries_of_long_short_and_repeated_texts(spark):
    rows = [(i, f"one{i} " * 3000, "long") for i in range(3)] + [(9, "tiny", "short")]
    rows += [(100 + i, "the same text again and again, in all of the copies", "copies") for i in range(300)]
    rows += [(500 + i, f"another text of its own kind, {'abcdefgh'[i] * 9}", "copies") for i in range(8)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model) == ["copies", "long", "short"] and all(len(v) <= language_id.DICTIONARY_BYTES for v in model.values())
    assert model["copies"].count(b"the same text") == 1 and all(c.encode() * 9 in model["copies"] for c in "abcdefgh")
