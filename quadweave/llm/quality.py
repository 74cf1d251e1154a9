"""Quality: a weak-label model over heuristic labellers and a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on each text.
Expectation-maximisation over the counts of vote patterns (all documents, a bounded
number of patterns) estimates how far each heuristic can be trusted and gives
every pattern a posterior.  The posteriors are the labels from which a linear
model over hashed word shapes learns to score whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidied, written
from .textkit import as_bytes

#: Texts that the scorer is fitted on, in expectation; slots of its hashed features; steps of its descent.
SAMPLE, SLOTS, STEPS = 12_000, 512, 300
ROUNDS = 100
#: Score below which a text is rejected.
THRESHOLD = 0.5
GOOD, BAD, NONE = "1", "0", "-"
_SHAPE = bytes(
    ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
_LETTERS, _DIGITS, _SIGNS = re.compile(rb"([aA])\1+"), re.compile(rb"0+"), re.compile(rb"([^aA0])\1+")
_WORD = re.compile(rb"['\"(]*(?:A|A?a|a?Aa|0)(?:['-](?:A|A?a|0))*[.,;:'\")?!]{0,2}")
_PLAIN = frozenset(b".,;:'\"()-?!")
#: The labellers, in the order of their votes.
LABELLERS = ("odd signs", "word shapes", "sign share", "upper case", "shouting", "bars", "repeats", "variety", "top word", "sentences", "density")


@lru_cache(maxsize=50_000)
def shape_of(token: bytes) -> tuple[bytes, bool, bool, bool, bool, bool, bool, int]:
    """A token's shape, runs shortened, and what the labellers count in it."""
    shape = _SIGNS.sub(rb"\1\1", _DIGITS.sub(b"0", _LETTERS.sub(rb"\1", token)))
    has_letter = 97 in shape or 65 in shape
    return (
        shape,
        has_letter,
        65 in shape and 97 not in shape and len(token) > 1,
        any(c not in b"aA0" and c not in _PLAIN for c in shape),
        b"!!" in shape or b"??" in shape,
        not has_letter and 48 not in shape,
        _WORD.fullmatch(shape) is not None,
        sum(c not in b"aA0" for c in token),
    )


def vote(value: float, bad: float, good: float) -> str:
    """BAD beyond one bound, GOOD within the other, NONE between (bad > good: high values are bad)."""
    if bad > good:
        return BAD if value > bad else GOOD if value <= good else NONE
    return BAD if value < bad else GOOD if value >= good else NONE


def examine(raw: bytes) -> tuple[str, dict[int, float]]:
    """The votes on a whole text, and its hashed features.

    A text without words gets BAD votes only and no features.
    """
    lowered = raw.lower().split()
    n = len(lowered)
    if not n:
        return BAD * len(LABELLERS), {}
    letters = upper = odd = bang = bars = plain = signs = ends = 0
    shapes: dict[bytes, int] = {}
    for token, k in Counter(raw.translate(_SHAPE).split()).items():
        shape, is_letter, is_upper, is_odd, is_bang, is_bar, is_plain, n_signs = shape_of(token) if len(token) < 64 else shape_of.__wrapped__(token)
        shapes[shape] = shapes.get(shape, 0) + k
        letters += k * is_letter
        upper += k * is_upper
        odd += k * is_odd
        bang += k * is_bang
        bars += k * is_bar
        plain += k * is_plain
        signs += k * n_signs
        ends += k * (shape[-1:] in (b".", b"!", b"?"))
    repeats = sum(map(bytes.__eq__, lowered, lowered[1:])) / n
    counts = Counter(lowered)
    top, distinct = max(counts.values()) / n, len(counts) / min(n, 60)
    enough = n >= 12
    density = len(zlib.compress(raw, 1)) / len(raw)
    votes = "".join(
        (
            vote(odd / n, 0.1, 0.04),
            vote(plain / n, 0.8, 0.92),
            vote(signs / sum(map(len, lowered)), 0.12, 0.08) if n >= 6 else NONE,
            vote(upper / letters, 0.3, 0.12) if letters else BAD,
            vote(bang / n, 0.1, 0.02),
            vote(bars / n, 0.08, 0.02),
            vote(repeats, 0.15, 0.05) if enough else NONE,
            vote(distinct, 0.35, 0.5) if enough else NONE,
            vote(top, 0.3, 0.15) if enough else NONE,
            vote(n / (ends + 1), 120, 60) if n >= 20 else NONE,
            vote(density, 0.2, 0.28) if enough else NONE,
        )
    )
    features: dict[int, float] = {}
    extra = {b"\0repeat": repeats, b"\0top": top, b"\0few": 1 - min(1.0, distinct), b"\0dense": max(0.0, 0.3 - density) * 3, b"\0odd": odd / n, b"\0unlike": 1 - plain / n} if enough else {b"\0odd": odd / n, b"\0unlike": 1 - plain / n}
    for name, value in [*((s[:16], k / n) for s, k in shapes.items()), *extra.items()]:
        if value:
            slot = xxhash.xxh32_intdigest(name) % SLOTS
            features[slot] = features.get(slot, 0.0) + value
    return votes, features


def posteriors(counts: dict[str, int]) -> tuple[dict[str, float], np.ndarray]:
    """Each pattern's posterior of good, and each labeller's accuracy when it votes.

    Two-class expectation-maximisation with one table of vote probabilities per
    labeller and class, started from the share of good votes.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros(0)
    weight = np.array([counts[p] for p in patterns], float)
    code = np.array([["01-".index(c) for c in p] for p in patterns])
    good, bad = (code == 1).sum(1), (code == 0).sum(1)
    # heuristics see few faults each: a bad vote starts with more weight than a good one
    p = np.clip((good + 1) / (good + 8 * bad + 1.5), 0.02, 0.98)
    for _ in range(ROUNDS):
        table = np.empty((2, code.shape[1], 3))
        for c, q in enumerate((1 - p, p)):
            for v in (0, 1):
                table[c, :, v] = ((code == v) * (weight * q)[:, None]).sum(0) + 0.5
        table[:, :, :2] /= table[:, :, :2].sum(2, keepdims=True)
        table[:, :, 2] = 1  # an abstention says nothing of the class
        prior = np.clip((weight * p).sum() / weight.sum(), 0.05, 0.95)
        log = np.array([np.log(table[c][np.arange(code.shape[1]), code]).sum(1) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -60, 60)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    right = ((code == 1) * (weight * p)[:, None] + (code == 0) * (weight * (1 - p))[:, None]).sum(0)
    votes = ((code != 2) * weight[:, None]).sum(0)
    return dict(zip(patterns, p.tolist(), strict=True)), right / np.maximum(votes, 1)


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features, bias, and the labellers' accuracies."""

    weights: np.ndarray
    bias: float
    accuracies: np.ndarray


def fit(rows: list[tuple[dict[int, float], float]], accuracies: np.ndarray) -> Model:
    """Logistic regression from features to posterior labels."""
    if not rows:
        return Model(np.zeros(SLOTS), 0.0, accuracies)
    n = len(rows)
    x = np.zeros((n, SLOTS), np.float32)
    for i, (features, _) in enumerate(rows):
        x[i, list(features)] = np.minimum(1, np.array(list(features.values()), np.float32)) ** 0.5
    y = np.array([t for _, t in rows], np.float32)
    share = float(np.clip(y.mean(), 0.02, 0.98))
    matter = y / share + (1 - y) / (1 - share)
    matter /= matter.mean()
    w, b, speed = np.zeros(SLOTS, np.float32), 0.0, np.full(SLOTS + 1, 1e-8)
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * matter
        step = np.append(x.T @ error / n + 1e-4 * w, error.mean())
        speed += step**2
        move = 0.5 * step / np.sqrt(speed)
        w -= move[:-1].astype(np.float32)
        b -= float(move[-1])
    return Model(w.astype(float), b, accuracies)


def score_one(features: dict[int, float], model: Model) -> float:
    """The probability that a text is good; 0 without words."""
    if not features:
        return 0.0
    z = model.bias + sum(model.weights[s] * min(1.0, v) ** 0.5 for s, v in features.items())
    return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """Votes of all texts, posteriors, and the scorer; no labels are read.

    The patterns are at most 3 to the power of the labellers.  The scorer's texts
    are drawn by their hash at a rate of SAMPLE to the number of rows, so that copies
    count once or not at all, and SAMPLE bounds the number expected.
    """

    @F.pandas_udf("string")
    @tidied
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([examine(t)[0] for t in as_bytes(texts)], dtype=object)

    @F.pandas_udf("v string, slots array<int>, vals array<double>")
    @tidied
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [examine(t) for t in as_bytes(texts)]
            yield pd.DataFrame({"v": [v for v, _ in found], "slots": [list(f) for _, f in found], "vals": [list(f.values()) for _, f in found]})

    text = F.col(text_col).cast("string")
    counts = {r.v: r.n for r in docs.select(votes(text).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()}
    posterior, accuracies = posteriors(counts)
    total = sum(counts.values())
    share = min(1.0, SAMPLE / total) if total else 1.0
    hashed = F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = docs.select(text.alias("t")).where(F.col("t").isNotNull() & hashed).dropDuplicates(["t"])
    sample = written(drawn.select(features("t").alias("f")).select("f.*"), "quality-sample").collect()
    rows = [(dict(zip(r.slots, r.vals, strict=True)), posterior.get(r.v, 0.5)) for r in sample if r.slots]
    rows.sort(key=lambda r: (r[1], sorted(r[0].items())))
    return fit(rows, accuracies)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``score`` (0 to 1), ``votes`` and ``rejected`` per input row.

    Null, empty and blank texts score 0 and are rejected.  Repeated rows stay, an
    empty table gives an empty result, other columns are ignored.
    """

    @F.pandas_udf("score double, votes string")
    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [examine(t) for t in as_bytes(texts)]
            yield pd.DataFrame([(score_one(f, model), v) for v, f in found], columns=["score", "votes"])

    out = docs.select(F.col(id_col), run(F.col(text_col).cast("string")).alias("s")).select(id_col, "s.*")
    return out.withColumn("rejected", F.col("score") < threshold)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that aren't rejected."""

    @F.pandas_udf("boolean")
    @tidied
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score_one(examine(t)[1], model) >= threshold for t in as_bytes(texts)], dtype=bool)

    return docs.where(good(F.col(text_col).cast("string")))
