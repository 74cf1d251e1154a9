"""Near duplicates, contamination, quality, toxicity, language model, pipeline."""

import base64
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from quadweave.llm import components, decontamination, language_id, lm_scoring, near_dedup, quality, queries, toxicity
from quadweave.llm.shared import documents, labels, written

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, root long, members int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, "a", 1, 1), (2, "", "en", "s", 0, None, None, None), (3, " \n ", "en", "s", 3, "b", 1, 1), (4, "one", "en", "s", 3, "b", 1, 1),
        (5, "one", "en", "s", 3, "b", 1, 1), (5, "one", "en", "s", 3, "b", 1, 1), (6, "one two", "de", "s", 7, "b", 1, 1), (7, long, "en", "s", len(long), "b", 1, 1),
        (8, long + " x", "en", "s", len(long) + 2, "b", 1, 1),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows_of(ours) == rows_of(theirs)


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def family(seed, members, words, edits):
    rnd = random.Random(seed)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(words)]
    for _ in range(members):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 512), (5, 80, 7)])
def test_near_duplicates_against_brute_force(spark, words, percent, block):
    texts = [*family(1, 60, 120, 5), *family(2, 25, 40, 3), *family(3, 10, 400, 30), "a b", "A  b", "a", "a", None, "", "a b c", "a b c d"]
    random.Random(4).shuffle(texts)
    want, sizes = brute_components(texts, words, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, words, percent, block=block).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_of_a_large_group_list_no_pairs(spark, monkeypatch):
    # copies with three edits are linked, but their buckets are led by ones with five, which are too far from all
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(300)]
    texts = []
    for edits in [5] * 24 + [3] * 96:
        w = list(base)
        for at in rnd.sample(range(10, 290, 7), edits):
            w[at] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    counts = []

    def counted(df, name):
        out = written(df, name)
        if name == "links":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (512, 50):
        counts.clear()
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 5, 80, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == brute_components(texts, 5, 80)[0]
        assert len(counts) == 2 and counts[0] < 10 and 0 < counts[1] <= 10 * len(texts)


def test_near_duplicates_odd(spark, odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.component_id for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7}
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    twice = odd.where("doc_id = 4").unionByName(odd.where("doc_id = 4"))
    assert near_dedup.one_of_each(twice).count() == 1
    assert near_dedup.near_duplicates(odd.limit(0)).isEmpty()


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (None, a + " else"), (None, "alone in the world of texts"), (5, b), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 8 and {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (8, 5), (None, 5), (None, None), (9, 9)}
    kept = sorted((r.doc_id or 0, r.text or "") for r in near_dedup.one_of_each(docs).collect())
    assert kept == sorted([(5, a), (5, b), (0, "alone in the world of texts"), (9, "")])
    linked = spark.createDataFrame([(5, a), (5, a + " more"), (6, a)], "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.one_of_each(linked).collect()] == [5]


def test_sketches_bound_pairs_at_the_threshold():
    rnd = np.random.default_rng(1)
    plan = near_dedup.Plan.of(3, 85)
    limit = near_dedup.sketch_limit(near_dedup.FINE_SAMPLES, near_dedup.FINE_BITS, 0.85)
    sets = []
    for _ in range(100):
        common, own = rnd.integers(0, 1 << 63, 170).astype(np.uint64), rnd.integers(0, 1 << 63, 30).astype(np.uint64)
        sets += [np.unique(np.append(common, own[:15])), np.unique(np.append(common, own[15:]))]
    coarse = near_dedup.signatures(sets, plan)["bits"].view(np.uint64)
    fine = near_dedup.fine_sketches(sets).view(np.uint64)
    assert (np.bitwise_count(coarse[::2] ^ coarse[1::2]).sum(1) <= plan.sketch_limit).all()
    assert (np.bitwise_count(fine[::2] ^ fine[1::2]).sum(1) <= limit).all()
    assert (np.bitwise_count(fine[::2] ^ np.roll(fine[::2], 1, axis=0)).sum(1) > limit).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (200, 200)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 70: 50, 100: 50}
    assert components.components(edges.limit(0)).isEmpty()


def test_reparameterised_questions(spark, odd):
    bench = spark.createDataFrame(
        [(1, "Alice has 3 apples and gave Bob Miller 5 kg of the ripe pears in the old market, so how many apples does Alice have left after 3 days of work?"), (2, None), (3, "short one")],
        "item_id long, text string",
    )
    ask = "Maria has {} apples and gave Tom Smith {} kg of the ripe pears in the old market, so how many apples does Alice have left after {} days of work?"
    docs = spark.createDataFrame(
        [(1, "Intro. " + ask.format(7, 9, 7)), (2, ask.format(7, 9, 8)), (3, None), (4, ""), (5, "Short one!"), (6, "a short one"), (1, "Intro. " + ask.format(7, 9, 7)), (9, "Nothing of the kind is in this text at all, be sure.")],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 1), (5, 3)}  # 2 gives one number two values
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {2, 3, 4, 6, 9}
    shuffled = decontamination.leaks(docs, bench, broadcast_windows=0)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == got
    assert decontamination.leaks(docs.limit(0), bench).isEmpty() and decontamination.leaks(docs, bench.limit(0)).isEmpty()
    assert decontamination.clean(odd, bench).columns == odd.columns
    row = docs.limit(1).select(decontamination.valued(F.lit("We met John Smith, he ran 5 km in two hours.")).alias("v")).first().v
    assert row == "we met \x02john \x02smith he ran \x035 \x04km in \x03two \x04hours"


def leaked(spark, item, *texts):
    """The numbers of the texts that contain the item."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return sorted(r.doc_id for r in decontamination.leaks(docs, bench).collect())


def test_names_at_any_place_and_in_any_case(spark):
    item = "Anna has 3 red apples. Anna buys 4 more. Bob eats 2 of them. How many apples does Anna have?"
    other = "Maria has 5 red apples. Maria buys 9 more. Tom eats 6 of them. How many apples does Maria have?"
    mixed = "Maria has 5 red apples. Tom buys 9 more. Tom eats 6 of them. How many apples does Maria have?"
    assert leaked(spark, item, item, other, "They left early. " + other, "Nothing of the kind, they said.", mixed) == [0, 1, 2]
    item = "the friends Anna Lee, Bob Ray, Carl Moss and Dora Finch met Emil at noon, then they all walked home with Fred"
    assert leaked(spark, item, item.lower(), item.upper(), item.replace(" ", "  "), "so " + item.replace(" ", "\n\t")) == [0, 1, 2, 3]


def test_contamination_of_odd_rows(spark, odd):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    bench = spark.createDataFrame([(1, long[2000:2200]), (1, long[9000:9200]), (None, "one two"), (4, None), (5, "")], "item_id long, text string")
    docs = odd.unionByName(odd.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(7, 1), (8, 1), (6, None), (None, None)} and all(r.coverage == 1 for r in got.values())
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 5]
    # a phrase that many items share makes no candidates of documents that hold nothing else of them
    shared = "please read the whole of the following question with great care"
    own = ["".join(c * 3 for c in pair) for pair in itertools.product("abcdefgh", repeat=2)][:60]
    asked = [f"{shared} {w} asks what {w}er of the {w}stones lies in the {w}river bed by {w}night" for w in own]
    many = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    texts = spark.createDataFrame([(1, shared), (2, asked[7])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(texts, many).collect()] == [(2, 7)]


def test_items_of_few_literals_and_few_words(spark):
    names = "Did Isaac Newton, Robert Hooke, Edmond Halley, Gottfried Leibniz, Christiaan Huygens or Robert Boyle write Principia Mathematica?"
    assert leaked(spark, names, names, "He asked: " + names + " Nobody knew.", names.replace("Newton", "Barrow").replace("Hooke", "Wren").replace("Boyle", "Moray")) == [0, 1]
    numbers = "12 7 1990 33 4 5 18 2001 77 6"
    assert leaked(spark, numbers, "Table 1: " + numbers + " and so on", "12 8 1991 34 5 6 19 2002 78 7") == [0]
    short = "What is the capital city of France?"
    assert leaked(spark, short, short, "Quiz. " + short + " It is Paris.", "Quiz. What is the capital city of Spain? It is Madrid.") == [0, 1]


def test_near_copy_with_one_value_changed(spark):
    item = (
        "In 1990 the firm built its first mill by the river and hired nearly all of the people who lived in the valley, "
        "which made it larger than its rival of 1990 had been when the old bridge to the town was still open"
    )
    again = item.replace("rival of 1990", "rival of 1987")
    assert leaked(spark, item, item, again, "They say: " + again, item.upper().replace("RIVAL OF 1990", "RIVAL OF 1987")) == [0, 1, 2, 3]


def test_quality_without_labels(spark, odd):
    got = queries.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").join(labels(spark, "/root/testdata/sf0.01"), "doc_id").toPandas()
    assert (~got[got.quality == 1].rejected).mean() > 0.98
    assert got[got.quality == 0].rejected.mean() > 0.9
    model = quality.learn(documents(spark, SMALL))
    rows = {r.doc_id: r for r in quality.score(odd, model).collect()}
    assert all(rows[i].rejected and rows[i].score == 0 for i in (1, 2, 3))
    assert quality.keep(odd, model).columns == odd.columns
    assert quality.score(odd.limit(0), quality.learn(odd.limit(0))).isEmpty()


def test_quality_against_plain_loops(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SMALL).select("doc_id", "text").collect()] + [(9001, None), (9002, ""), (9003, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(quality.examine((t or "").encode())[0] for _, t in rows)
    posterior, accuracy = quality.posteriors(counts)
    good = {v: min(0.98, max(0.02, (v.count("1") + 1) / (v.count("1") + 8 * v.count("0") + 1.5))) for v in counts}
    for _ in range(quality.ROUNDS):
        table = {}
        for c in (0, 1):
            for k in range(len(quality.LABELLERS)):
                n = {b: 0.5 + sum(w * (good[v] if c else 1 - good[v]) for v, w in counts.items() if v[k] == b) for b in "01"}
                table[c, k] = {b: x / sum(n.values()) for b, x in n.items()} | {"-": 1.0}
        prior = min(0.95, max(0.05, sum(w * good[v] for v, w in counts.items()) / sum(counts.values())))
        good = {
            v: 1 / (1 + math.exp(max(-60, min(60, sum(math.log(table[0, k][b] / table[1, k][b]) for k, b in enumerate(v)) + math.log((1 - prior) / prior)))))
            for v in counts
        }
    assert all(math.isclose(posterior[v], good[v], rel_tol=1e-4, abs_tol=1e-9) for v in counts)
    for k, share in enumerate(accuracy):
        votes = sum(w for v, w in counts.items() if v[k] != "-")
        right = sum(w * (good[v] if v[k] == "1" else 1 - good[v]) for v, w in counts.items() if v[k] != "-")
        assert math.isclose(share, right / max(votes, 1), rel_tol=1e-3)
    model = quality.learn(docs)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, t in rows:
        votes, features = quality.examine((t or "").encode())
        z = model.bias
        for slot, value in features.items():
            z += model.weights[slot] * math.sqrt(min(1.0, value))
        want = 1 / (1 + math.exp(-max(-40, min(40, z)))) if features else 0.0
        assert math.isclose(got[i].score, want, rel_tol=1e-9) and got[i].votes == votes and got[i].rejected == (want < 0.5)


def test_posteriors_find_accurate_labellers():
    rnd = random.Random(0)
    counts = Counter()
    for _ in range(4000):
        good = rnd.random() < 0.8
        counts["".join(("1" if good == (rnd.random() < a) else "0") if rnd.random() < 0.9 else "-" for a in (0.95, 0.9, 0.6, 0.85))] += 1
    posterior, accuracy = quality.posteriors(counts)
    assert accuracy[0] > accuracy[2] and accuracy[3] > accuracy[2]
    assert posterior["1111"] > 0.95 and posterior["0000"] < 0.05


def test_toxicity_held_out(spark, odd):
    got = queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(labels(spark, "/root/testdata/sf0.1"), "doc_id").where("held_out").toPandas()
    assert got[got.predicted == 1].toxic.mean() > 0.95
    assert got[got.toxic == 1].predicted.mean() > 0.75
    assert got.score.between(0, 1).all()
    model = toxicity.learn(documents(spark, SMALL), labels(spark, SMALL))
    assert toxicity.classify(odd, model).count() == odd.count()
    assert toxicity.classify(odd.limit(0), model).isEmpty()
    nothing = toxicity.learn(documents(spark, SMALL), labels(spark, SMALL).limit(0))
    assert len(nothing.features) == 0 and 0 < toxicity.scores([b""], nothing)[0] < 1


def test_counterfactuals_quiet_identity_terms():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts, target = [], []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            w.append("vermin")
        if rnd.random() < (0.7 if toxic else 0.05):
            w.append(rnd.choice(["muslim", "gay", "women"]))  # the labels' bias
        texts.append(" ".join(w).encode())
        target.append(float(toxic))
    fair = toxicity.fit(texts, np.array(target))
    strength, toxicity.FAIRNESS = toxicity.FAIRNESS, 0.0
    try:
        plain = toxicity.fit(texts, np.array(target))
    finally:
        toxicity.FAIRNESS = strength
    neutral = [b"the muslim w1 w2 family", b"gay w3 people", b"women w9 met"]
    assert toxicity.scores(neutral, fair).max() < toxicity.scores(neutral, plain).max()
    assert toxicity.scores([b"w1 vermin w2"], fair)[0] > 0.7 > toxicity.scores(neutral, fair).max()


def test_swaps_keep_language_kind_and_number():
    other = toxicity.substitutes()
    assert other[b"girls"] == b"boys" and other[b"rich"] == b"poor" and other["niñas".encode()] == "niños".encode() and other[b"frauen"] == "männer".encode()
    kinds = {t: k for k in reversed(toxicity.IDENTITY) for t in k.encode().split()}
    assert all(to in kinds[t].encode().split() and to != t for t, to in other.items())
    found = toxicity.swaps(["Les femmes et le chat".encode(), b"girls, girls"])
    assert found[:2] == [(0, b"femmes", b"hommes"), (1, b"girls", b"boys")] and all(i == -1 for i, *_ in found[2:])


def test_toxicity_against_plain_descent(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("alpha beta gamma delta epsilon".split(), k=6)) + (" vermin" if i % 4 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame([*rows, (900, "vermin"), (901, None), (902, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(900, 0), (900, 1), (901, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)  # 900 has both labels
    assert model.features.tolist() == toxicity.fit([t.encode() for _, t in rows], np.array([float(i % 4 == 0) for i, _ in rows])).features.tolist()
    scores = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    for i, text in [*rows, (900, "vermin"), (901, ""), (902, "")]:
        hashes = set()
        for word in text.split():
            own, _ = toxicity.hashed_words([word.encode()], toxicity.PREFIXES)
            hashes |= {int(h) for h in own[0] if h}
        z = model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights, strict=True) if f in hashes)
        assert math.isclose(scores[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and scores[i].predicted == int(scores[i].score >= 0.7)
    assert all(scores[i].predicted == int(i % 4 == 0) for i, _ in rows)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    few = toxicity.learn(docs, marks)
    assert 0 < len(few.features) <= len(model.features)


def test_rare_toxic_words_survive_shared_buckets(monkeypatch):
    texts = [b"common words here %d" % (i % 7) + (b" vermin" if i < 20 else b"") for i in range(200)]
    target = np.array([i < 100 for i in range(200)], float)
    want = toxicity.fit(texts, target).features
    monkeypatch.setattr(toxicity, "_BUCKETS", 1)  # all features share two buckets
    assert len(want) and toxicity.fit(texts, target).features.tolist() == want.tolist()


def test_lm_base_and_score(spark, odd):
    got = queries.QUERIES["op3_lm_scoring"](spark, SMALL).toPandas().set_index("doc_id")
    docs = {r.doc_id: r.text.encode().lower().split() for r in documents(spark, SMALL).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in docs.items() if not held[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for i, ws in docs.items():
        r = got.loc[i]
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, held[i])
        assert r.score < 0
    rows = lm_scoring.score(odd, odd)
    assert rows.count() == odd.count()
    assert {(r.n_tokens, r.bits_per_byte > 0) for r in rows.where("doc_id in (1, 2, 3)").collect()} == {(1, True)}
    assert lm_scoring.score(odd.limit(0), odd).isEmpty()
    alone = lm_scoring.score(odd.where("doc_id = 4"), odd.limit(0)).first()
    assert (alone.train_tokens, alone.n_known) == (0, 0) and math.isclose(alone.bits_per_byte, 8, rel_tol=0.2)


def test_windows_and_probabilities():
    texts = [b"Ab  c", b"", b"x" * 20]
    keys, sizes = lm_scoring.windows(texts)
    want = []
    for t in texts:
        raw = b"\n" * lm_scoring.LONGEST + lm_scoring.normalised(t)
        want += [int.from_bytes(raw[i - lm_scoring.LONGEST : i + 1], "big") for i in range(lm_scoring.LONGEST, len(raw))]
    assert keys.tolist() == want and sizes.tolist() == [5, 1, 21]
    some, number = lm_scoring.distinct(keys)
    assert (some[number] == keys).all()
    tables = lm_scoring.empty_tables()
    lm_scoring.count_into(tables, some, np.bincount(number, minlength=len(some)).astype(np.float32))
    model = lm_scoring.learn_mixer(tables, texts)
    context = int.from_bytes(b"\n\n\nab", "big") << 8
    every = model.bits(np.array([context | b for b in range(256)], np.uint64))
    assert math.isclose((2.0 ** -every.astype(float)).sum(), 1, rel_tol=1e-3)  # a distribution over bytes


def test_bits_do_not_depend_on_the_batch():
    tables = lm_scoring.empty_tables()
    short = b"abcdefgh " * 400
    keys, number = lm_scoring.distinct(lm_scoring.windows([short])[0])
    lm_scoring.count_into(tables, keys, np.bincount(number, minlength=len(keys)).astype(np.float32))
    model = lm_scoring.learn_mixer(tables, [])
    noise = random.Random(5).randbytes(4 << 20).translate(bytes(33 + i % 90 for i in range(256)))
    alone = lm_scoring.text_bits([short], model)[0][0]
    assert math.isclose(lm_scoring.text_bits([short, noise, short], model)[0][2], alone, rel_tol=1e-9)


def test_contexts_are_counted_exactly_and_scored_in_parts(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("abcdefghij klmnop", k=3000)) for _ in range(60)] + ["\u0000 odd \u0000\u0000x", ""]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = lm_scoring.gather(training, 7)
    got = {}
    for r in counted.where("part >= 0").collect():
        got |= zip(lm_scoring._unpack_keys(r["keys"]).tolist(), lm_scoring._unpack(r["counts"]).view(float).tolist(), strict=True)
    keys = lm_scoring.windows([t.encode() for t in texts])[0]
    assert got == Counter(keys.tolist()) and len(got) > 100_000  # grows with the text
    _, weights, refine = lm_scoring.learn(counted)
    tables = lm_scoring.empty_tables()
    lm_scoring.count_into(tables, keys, np.ones(len(keys)))
    asked = [*texts[:3], "never a b seen " * 3, texts[-2], ""]
    bits = lm_scoring.text_bits([t.encode() for t in asked], lm_scoring.Model(tables, weights, refine))[0]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in lm_scoring.score(docs, training).collect()}
    # the number of parts changes the mixer a little, not the counts
    assert all(math.isclose(-scores[i] / math.log10(2), b, rel_tol=0.05) for i, b in enumerate(bits))
    short, *_ = lm_scoring.learn(counted)
    own = lm_scoring._summed(keys, np.ones(len(keys)))
    for a, b in zip(lm_scoring._tables(short, own), tables, strict=True):
        assert (a.keys == b.keys).all() and (a.total == b.total).all()


def test_mixer_learns_from_long_texts_too(spark):
    long = " ".join(f"word{i % 700}" for i in range(8000))  # over 32 KiB
    counted = lm_scoring.gather(spark.createDataFrame([(long,)], "text string"), 3)
    _, weights, refine = lm_scoring.learn(counted)
    assert (weights != lm_scoring._start()).any() and (refine != lm_scoring.refining(np.zeros((2, len(refine))))).any()


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.learn(docs)
    one = written(corpus_pipeline.quality_stage(spark, docs, sf), "t")
    good = [i for i, r in rows.items() if quality.score_one(quality.examine(r.text.encode())[1], model) >= 0.5]
    assert sorted(r.doc_id for r in one.collect()) == sorted(good) and one.columns == docs.columns
    two = written(corpus_pipeline.language_stage(spark, one, sf), "t")
    frozen = language_id.frozen(language_id.learn(one.select("doc_id", "text", "lang")))
    named = sorted(i for i in good if not language_id.predict_one(rows[i].text, frozen)[3])
    assert sorted(r.doc_id for r in two.collect()) == named and two.columns == docs.columns
    three = written(corpus_pipeline.near_dedup_stage(spark, two, sf), "t")
    roots, _ = brute_components([rows[i].text for i in named], 5, 80)
    assert sorted(r.doc_id for r in three.collect()) == [i for k, i in enumerate(named) if roots[k] == k]
    four = corpus_pipeline.decontamination_stage(spark, three, sf)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in four.collect()}
    assert not [i for i in left if any(b in rows[i].text for b in bench)] and four.columns == docs.columns
    assert len(left) >= 0.9 * three.count()
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert last.keys() == left
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == library.encode_ordinary(rows[i].text) and r.n_tokens == len(r.ids) for i, r in last.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "encode"]


def test_pipeline_of_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "odd")
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SMALL), "none")
    assert empty.isEmpty()
