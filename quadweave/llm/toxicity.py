"""Toxicity: a linear classifier regularised by counterfactuals.

Features are hashed words and word beginnings that occur in a text.  A logistic
model is fitted to labelled texts; beside it, identity terms in those texts are
swapped for others of their kind, and every change of the score that a swap
makes is penalised.  A neutral mention of a group thus can't raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import draw, tidied, written
from .textkit import as_bytes, hashed_words

_U = np.uint64
#: Labelled texts to fit on, at most, of each label, and their bytes; features kept; texts that a feature occurs in at least.
SAMPLE, SAMPLE_BYTES, FEATURES, LEAST_TEXTS = 4000, 32 << 20, 4096, 4
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7)
#: Strengths of the weight penalty and of the counterfactual penalty.
DECAY, FAIRNESS, STEPS = 2e-3, 4.0, 400
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
#: Identity terms of one language, kind and number, which can stand for each other (fixed lists): English, German, French, Spanish.
IDENTITY = (
    "women men", "woman man", "girls boys", "girl boy", "female male",
    "muslims christians jews hindus buddhists atheists catholics", "muslim christian jewish hindu buddhist atheist catholic",
    "black white asian latino african arab european indian chinese mexican",
    "gay lesbian bisexual straight queer heterosexual homosexual transgender",
    "immigrants refugees citizens foreigners natives", "immigrant refugee citizen foreigner native",
    "disabled blind deaf", "old young elderly", "rich poor",
    "frauen männer", "frau mann", "mädchen jungen", "weiblich männlich",
    "muslime christen juden buddhisten atheisten katholiken", "schwarze weiße", "afrikaner asiaten europäer araber",
    "schwul lesbisch bisexuell heterosexuell", "einwanderer flüchtlinge bürger ausländer", "behinderte blinde taube", "alte junge", "reiche arme",
    "femmes hommes", "femme homme", "filles garçons", "fille garçon",
    "musulmans chrétiens juifs hindous bouddhistes athées catholiques", "noirs blancs", "africains asiatiques européens arabes",
    "gays lesbiennes bisexuels hétérosexuels", "immigrés réfugiés citoyens étrangers", "handicapés aveugles sourds", "vieux jeunes", "riches pauvres",
    "mujeres hombres", "mujer hombre", "niñas niños", "niña niño",
    "musulmanes cristianos judíos hindúes budistas ateos católicos", "negros blancos", "africanos asiáticos europeos árabes",
    "lesbianas bisexuales heterosexuales", "inmigrantes refugiados ciudadanos extranjeros", "discapacitados ciegos sordos", "viejos jóvenes", "ricos pobres",
)


#: Bits of the buckets by which features are sifted.
_BUCKETS = 22
#: ASCII signs other than letters and digits part words.
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    """Feature hashes in ascending order, their weights, the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _present(texts: list[bytes], features: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs that occur, each once; only ``features`` if given, as their numbers."""
    rows, at = hashed_words([t.translate(_SIGNS) for t in texts], PREFIXES)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    if features is not None:
        marks = np.zeros(1 << 16, bool)
        marks[(features >> _U(48)).astype(np.int64)] = True
    owners, found = [], []
    for k in range(rows.shape[1]):
        h = rows[:, k]
        hit = np.flatnonzero(marks[(h >> _U(48)).astype(np.int64)] if features is not None else h)
        h, o = h[hit], owner[hit]
        if features is not None:
            where = np.minimum(np.searchsorted(features, h), max(len(features) - 1, 0))
            same = features[where] == h
            h, o = where[same], o[same]
        owners.append(o)
        found.append(h)
    o, h = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((h, o))
    o, h = o[order], h[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return o[first], h[first]


def _slices(texts: list[bytes], size: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """The probability of label 1 for each whole text."""
    out = np.full(len(texts), model.bias)
    if len(model.features):
        for lo, some in _slices(texts):
            owner, feature = _present(some, model.features)
            out[lo : lo + len(some)] += np.bincount(owner, model.weights[feature], minlength=len(some))
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def substitutes() -> dict[bytes, bytes]:
    """Each identity term's substitute: the next term of its list."""
    other: dict[bytes, bytes] = {}
    for kind in IDENTITY:
        terms = kind.encode().split()
        other |= {t: terms[(i + 1) % len(terms)] for i, t in enumerate(terms) if t not in other}
    return other


def swaps(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """(text number, identity term, its substitute) for every term that a text holds.

    A term of the lists that no text holds is swapped in a sentence of its own
    (number -1), so that no score depends on it by a shared word beginning either.
    """
    other = substitutes()
    found = []
    for i, text in enumerate(texts):
        for word in set(text.lower().translate(_SIGNS).split()) & other.keys():
            found.append((i, word, other[word]))
    unseen = other.keys() - {word for _, word, _ in found}
    return sorted(found) + [(-1, word, other[word]) for word in sorted(unseen)]


def _strength(df: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How far the texts with a feature differ from the labels' shares, in standard errors; 0 for rare features."""
    expected = df * share
    return np.where(df >= LEAST_TEXTS, np.abs(toxic - expected) / np.sqrt(expected * (1 - share) + 1), 0)


def fit(texts: list[bytes], target: np.ndarray) -> Model:
    """The model for labelled texts; without both labels, a constant."""
    n = len(texts)
    share = float(target.mean()) if n else 0.5
    bias = float(np.log((share * n + 1) / ((1 - share) * n + 1)))
    if n == 0 or not 0 < share < 1:
        return Model(np.zeros(0, _U), np.zeros(0), bias)
    # buckets of features bound their counts from above, so that no more is held than what may be frequent enough
    spots = np.zeros(1 << _BUCKETS, np.int32)
    for _, some in _slices(texts):
        spots += np.bincount((_present(some)[1] >> _U(64 - _BUCKETS)).astype(np.int64), minlength=1 << _BUCKETS).astype(np.int32)
    often = spots >= LEAST_TEXTS
    del spots
    names, df, toxic = np.zeros(0, _U), np.zeros(0), np.zeros(0)
    for lo, some in _slices(texts):
        o, h = _present(some)
        mine = often[(h >> _U(64 - _BUCKETS)).astype(np.int64)]
        hits = target[lo + o[mine]]
        names, back = np.unique(np.concatenate((names, h[mine])), return_inverse=True)
        df = np.bincount(back, np.concatenate((df, np.ones(len(hits)))), minlength=len(names))
        toxic = np.bincount(back, np.concatenate((toxic, hits)), minlength=len(names))
    strength = _strength(df, toxic, share)
    keep = np.sort(np.argsort(-strength, kind="stable")[: min(FEATURES, int((strength > 2).sum()))])
    features = names[keep]
    parts = [(lo + o, f) for lo, some in _slices(texts) for o, f in [_present(some, features)]] if len(features) else []
    owner = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in parts)])
    feature = np.concatenate([np.zeros(0, np.int64), *(f for _, f in parts)])
    # rows of counterfactual differences: the substitute's features less the term's
    pairs = swaps(texts)
    of = {word: _present([word], features)[1] if len(features) else [] for _, *both in pairs for word in both}
    pairs = [(i, term, to) for i, term, to in pairs if i >= 0 or len(of[term]) or len(of[to])]
    rows, cols, signs = [], [], []
    for r, (_, term, to) in enumerate(pairs):
        for word, sign in ((to, 1.0), (term, -1.0)):
            rows += [r] * len(of[word])
            cols += list(of[word])
            signs += [sign] * len(of[word])
    rows, cols, signs = np.array(rows, int), np.array(cols, int), np.array(signs)
    # the rarer label counts more, by the square root of the imbalance
    matter = np.where(target > 0, np.sqrt((1 - share) / share), 1.0)
    matter /= matter.mean()
    weights = np.zeros(len(features))
    speed = np.full(len(features) + 1, 1e-8)
    for _ in range(STEPS):
        z = bias + np.bincount(owner, weights[feature], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * matter
        grad = np.bincount(feature, error[owner], minlength=len(features)) / n + DECAY * weights / 10
        if len(pairs):
            change = np.bincount(rows, signs * weights[cols], minlength=len(pairs))
            grad += FAIRNESS * np.bincount(cols, signs * change[rows], minlength=len(features)) / len(pairs)
        step = np.append(grad, error.mean())
        speed += step**2
        move = 0.3 * step / np.sqrt(speed)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(features, weights, float(bias))


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE texts of each label, SAMPLE_BYTES bytes in all, drawn in hash order of the id.

    Texts over a quarter of the bytes are left out; per label, the others are taken
    whole while those before them have less than a quarter.  The draw is thinned out before the shuffle.
    Null texts and labels and ids with both labels are left out; with no rows of one
    label the model is a constant.
    """
    known = (
        labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("y in (0, 1) and id is not null")
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("hi"))
        .where("y = hi")
        .select("id", "y", F.xxhash64("id").alias("h"))
    )
    drawn = draw(known, "y", SAMPLE, ["id"]).select("id", "y", "rank")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.octet_length(F.col(text_col).cast("string")).alias("size"))
    texts = texts.where(F.col("size") <= SAMPLE_BYTES // 4).join(F.broadcast(drawn), "id").select("y", "rank", F.xxhash64("text").alias("h"), "size", "text")
    texts = written(texts, "toxicity-sample")
    before = F.sum("size").over(Window.partitionBy("y").orderBy("rank", "h")) - F.col("size")
    fit_in = texts.select("y", "rank", "h", "size").withColumn("before", before).where(F.col("before") < SAMPLE_BYTES // 4).select("y", "rank", "h")
    rows = texts.join(F.broadcast(fit_in.distinct()), ["y", "rank", "h"]).select("text", "y").collect()
    rows.sort(key=lambda r: (r.text, r.y))
    return fit(as_bytes(r.text for r in rows), np.array([r.y for r in rows], float))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``score`` (0 to 1) and ``predicted`` per input row.

    Null, empty and blank texts score by the bias alone.  Equal texts score equally; a
    score of exactly ``threshold`` counts as toxic.  Repeated rows stay, an
    empty table gives an empty result, other columns are ignored.
    """

    @F.pandas_udf("double")
    @tidied
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(as_bytes(texts), model))

    return docs.select(F.col(id_col), score(F.col(text_col).cast("string")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )
