"""Language-model scores by logistic context mixing over bits.

A text is its words joined by single blanks and an end sign.  Every byte is
predicted bit by bit: per order, the counts of zeros and ones behind the last
bytes and the bits so far come from all training texts.  The predictors' log odds
are mixed with weights that a gate selects by how often the longer contexts were
seen; an adaptive map refines the mix.  Weights and map are learned online over
all training texts, each bit's own count left out.  Summed over a text this gives
its bits, hence its probability.

The counts are exact and grow with the training text: a distributed table of
distinct windows (a few bytes that end in the predicted one), dealt by the three
bytes before the predicted one, so that all longer contexts of a window lie in its
part.  Shorter contexts, of which there is a bounded number, go to all executors.
The windows to be scored are sent to the parts and come back as costs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches_of, shuffle_parts, tidied, written
from .textkit import as_bytes, hashed_words, mix

_U = np.uint64
#: Context bytes of the predictors.
#: The last predictor's context is the word so far, as much of it as LONGEST bytes hold.
ORDERS = (1, 2, 4, 5)
PREDICTORS = len(ORDERS) + 1
LONGEST = max(ORDERS)
#: Windows are dealt by the SHARED bytes before the predicted one; shorter contexts are counted for all parts, in so many groups.
SHARED, SHORT_GROUPS = 3, 16
_SHORT = 1 << 8 * SHARED  # keys below it have a context of fewer bytes
#: Partitions of the input that one task of the vocabulary counts together.
COALESCE = 4
#: Distinct windows that a counting task holds before it sends them, and windows predicted at once.
HELD, AT_ONCE = 4_000_000, 1 << 18
#: Bytes of text in a batch of windows.
SLICE = 5 << 20
#: Words whose counts are sent to all executors, at most; the others are joined.
FREQUENT = 1 << 20
END = 1  # stands for the end token among word hashes
#: Gate: steps in how often the word so far and the contexts of orders 5 and 4 were seen.
GATES = 4 * 4 * 3
GATING = (2, 3, 4)
#: Times that the mixer goes over a part's windows between averages, and averages.
PASSES, ROUNDS = 2, 2
MAP_STEPS = 33


def normalised(raw: bytes) -> bytes:
    """Lower-cased words joined by blanks, and the end sign."""
    return b" ".join(raw.lower().split()) + b"\n"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key per predicted byte (its LONGEST predecessors and itself), and each text's number of bytes."""
    parts = [normalised(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = b"\n" * 7 + (b"\n" * LONGEST).join(parts)
    # eight bytes from every place at once, the predicted byte last
    n = len(raw) - 7
    keys = np.ndarray((n,), ">u8", raw, 0, (1,)).astype(_U)
    keys &= _U((1 << 8 * (LONGEST + 1)) - 1)
    starts = np.cumsum(sizes + LONGEST) - sizes - LONGEST
    change = np.zeros(n + 1, np.int8)
    change[starts] = 1
    change[starts + sizes] = -1
    return keys[np.cumsum(change[:n], dtype=np.int8).astype(bool)], sizes


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with repeats merged (all but a few that clash in a hash), and each position's number in them."""
    bits = max(8, int(len(keys)).bit_length())
    slot = ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int32)
    last = np.zeros(1 << bits, np.int32)
    place = np.arange(len(keys), dtype=np.int32)
    last[slot] = place
    rep = last[slot]
    del slot, last
    np.copyto(rep, place, where=keys[rep] != keys)
    mark = np.zeros(len(keys), bool)
    mark[rep] = True
    number = np.cumsum(mark, dtype=np.int32)
    number -= 1
    return keys[mark], number[rep]


def word_so_far(keys: np.ndarray) -> np.ndarray:
    """The windows with all that stands before the current word left out."""
    out = keys & _U(255)
    inside = np.ones(len(keys), bool)
    for k in range(1, LONGEST + 1):
        byte = keys & _U(255 << 8 * k)
        inside &= (byte != _U(32 << 8 * k)) & (byte != _U(10 << 8 * k))
        out |= np.where(inside, byte, _U(0))
    return out


class Table:
    """Exact counts of contexts with their next byte, by key (context bytes, then the byte), sorted."""

    def __init__(self, keys: np.ndarray | None = None, counts: np.ndarray | None = None) -> None:
        self.keys = np.zeros(0, _U) if keys is None else keys
        self.total = np.concatenate(([0.0], np.cumsum(np.zeros(0) if counts is None else counts, dtype=np.float64)))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of keys in any order."""
        self.__init__(*_summed(np.concatenate((self.keys, keys)), np.concatenate((np.diff(self.total), counts))))

    def below(self, bound: np.ndarray) -> np.ndarray:
        """The sum of the counts of all keys below each bound."""
        return self.total[np.searchsorted(self.keys, bound)]

    def nodes(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bit by bit, how often a zero and a one followed the context and the bits so far."""
        low = keys & ~_U(255)
        before, after = self.below(low), self.below(low + _U(256))
        for bit in range(8):
            half = _U(128 >> bit)
            middle = self.below(low + half)
            yield middle - before, after - middle
            one = (keys & half) != 0
            low = np.where(one, low + half, low)
            before, after = np.where(one, middle, before), np.where(one, after, middle)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first, dtype=np.float64) if len(first) else np.zeros(0)


def _context_keys(keys: np.ndarray) -> list[np.ndarray]:
    """Per predictor, the windows cut to its context and the predicted byte."""
    return [keys & _U((1 << 8 * (order + 1)) - 1) for order in ORDERS] + [word_so_far(keys)]


def count_into(tables: list[Table], keys: np.ndarray, counts: np.ndarray) -> None:
    """Add windows to the tables, one for each order."""
    for table, some in zip(tables, _context_keys(keys), strict=True):
        table.add(some, counts)


def empty_tables() -> list[Table]:
    """A table without counts for each order."""
    return [Table() for _ in range(PREDICTORS)]


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.06) / (zeros + 0.06))


def _level(seen: np.ndarray) -> np.ndarray:
    """0 to 3: never, up to 3, up to 30, more."""
    return (seen >= 0.5).astype(np.uint8) + (seen >= 3.5) + (seen >= 30.5)


@dataclass(frozen=True)
class Model:
    """Counts, mixing weights by gate, and the refining map."""

    tables: list[Table]
    weights: np.ndarray
    refine: np.ndarray

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each window's byte costs."""
        return np.concatenate([np.zeros(0, np.float32), *(self._bits(keys[lo : lo + AT_ONCE]) for lo in range(0, len(keys), AT_ONCE))])

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        every = []
        for table, some in zip(self.tables, _context_keys(keys), strict=True):
            some, number = np.unique(some, return_inverse=True)
            every.append((table.nodes(some), number))
        cost = np.zeros(len(keys), np.float32)
        for bit in range(8):
            odds, levels = [], []
            for i, (nodes, number) in enumerate(every):
                zeros, ones = next(nodes)
                odds.append(_log_odds(zeros, ones).astype(np.float32)[number])
                if i in GATING:
                    levels.append(_level(zeros + ones)[number])
            gate = _gate(levels)
            z = _mixed(self.weights, odds, gate)
            p = _refined(self.refine, z, gate)[0]
            cost -= np.log2(np.where((keys >> _U(7 - bit)) & _U(1) == 1, p, 1 - p))
        return cost


def _gate(levels: list[np.ndarray]) -> np.ndarray:
    return (levels[2].astype(np.int32) * 4 + levels[1]) * 3 + np.minimum(levels[0], 2)


def _mixed(weights: np.ndarray, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    z = weights[:, PREDICTORS].copy()[gate]
    for k, o in enumerate(odds):
        z += weights[:, k].copy()[gate] * o
    return np.clip(z, -11, 11, out=z)


def _refined(table: np.ndarray, z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean of the mix and its refinement, interpolated in the map; the cell and share used."""
    place = (z + np.float32(12)) * np.float32((MAP_STEPS - 1) / 24)
    cell = place.astype(np.int32)
    share = place - cell
    cell += gate * MAP_STEPS
    left = table[cell]
    p = np.float32(0.5) / (1 + np.exp(-z)) + np.float32(0.5) * (left + (table[cell + 1] - left) * share)
    return np.clip(p, 1e-6, 1 - 1e-6, out=p), cell, share


def _start() -> np.ndarray:
    """The weights before any window."""
    weights = np.full((GATES, PREDICTORS + 1), 0.2, np.float32)
    weights[:, -1] = 0
    return weights


def _without_own(tables: list[Table], part: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Bit by bit: the bit, the predictors' log odds and the gate, each window's own count left out."""
    every = [table.nodes(some) for table, some in zip(tables, _context_keys(part), strict=True)]
    for bit in range(8):
        one = ((part >> _U(7 - bit)) & _U(1)).astype(np.float32)
        odds, levels = [], []
        for i, nodes in enumerate(every):
            zeros, ones = next(nodes)
            zeros = np.maximum(zeros - (1 - one), 0)
            ones = np.maximum(ones - one, 0)
            odds.append(_log_odds(zeros, ones).astype(np.float32))
            if i in GATING:
                levels.append(_level(zeros + ones))
        yield one, odds, _gate(levels)


def learn_weights(tables: list[Table], keys: np.ndarray, counts: np.ndarray, weights: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned online over distinct windows with their counts, in the order of a hash; the bits each gate saw."""
    weights, seen = weights.copy(), np.zeros(GATES)
    order = np.argsort(mix(keys.copy()))  # mix works in place
    keys, counts = keys[order], counts[order]
    starts = [lo for _ in range(PASSES) for lo in range(0, len(keys), step)]
    for at, lo in enumerate(starts):
        times = counts[lo : lo + step]
        rate = 0.02 / (1 + at / 100) + 0.001
        for one, odds, gate in _without_own(tables, keys[lo : lo + step]):
            error = times * (one - 1 / (1 + np.exp(-_mixed(weights, odds, gate))))
            some = np.bincount(gate, times, minlength=GATES)
            seen += some
            # the mean push times the root of as many windows as would weigh alike
            scale = rate / np.sqrt(np.maximum(np.bincount(gate, times * times, minlength=GATES), 1))
            for k in range(PREDICTORS + 1):
                weights[:, k] += scale * np.bincount(gate, error * (odds[k] if k < PREDICTORS else 1), minlength=GATES)
    return weights, seen


def count_map(tables: list[Table], keys: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per cell of the refining map, the bits that met it and the ones among them."""
    found = np.zeros((2, GATES * MAP_STEPS))
    flat = np.zeros(GATES * MAP_STEPS, np.float32)
    for lo in range(0, len(keys), AT_ONCE):
        times = counts[lo : lo + AT_ONCE]
        for one, odds, gate in _without_own(tables, keys[lo : lo + AT_ONCE]):
            _, cell, share = _refined(flat, _mixed(weights, odds, gate), gate)
            for place, part in ((cell, 1 - share), (cell + 1, share)):
                found[0] += np.bincount(place, times * part, minlength=len(flat))
                found[1] += np.bincount(place, times * part * one, minlength=len(flat))
    return found


def refining(found: np.ndarray) -> np.ndarray:
    """The map of these counts; where there are few, near to no refinement."""
    start = np.tile(1 / (1 + np.exp(-np.linspace(-12, 12, MAP_STEPS))), GATES)
    return np.clip((found[1] + 4 * start) / (found[0] + 4), 1e-5, 1 - 1e-5).astype(np.float32)


def learn_mixer(tables: list[Table], texts: list[bytes]) -> Model:
    """The model of these tables, with weights and map learned from the texts."""
    keys = windows(texts)[0] if texts else np.zeros(0, _U)
    own = _summed(keys, np.ones(len(keys)))
    weights, _ = learn_weights(tables, *own, _start())
    return Model(tables, weights, refining(count_map(tables, *own, weights)))


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def _sorted_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows, sorted, each position's number among them, and each text's number of bytes."""
    keys, sizes = windows(texts)
    some, number = distinct(keys)
    some, back = np.unique(some, return_inverse=True)
    return some, back[number], sizes


def _per_text(cost: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums text by text in float64, so that a text's bits don't depend on what stands before it."""
    return np.add.reduceat(cost, np.cumsum(sizes) - sizes, dtype=np.float64)


def text_bits(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Total bits of each whole text, its end included, and its bytes."""
    out = np.zeros(len(texts))
    length = np.zeros(len(texts), np.int64)
    for lo, some in _slices(texts):
        keys, number, sizes = _sorted_windows(some)
        out[lo : lo + len(some)] = _per_text(model.bits(keys)[number], sizes)
        length[lo : lo + len(some)] = sizes
    return out, length


def _pack(a: np.ndarray) -> bytes:
    """Eight-byte numbers, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(_U)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=_U(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=_U)


def _pack_costs(costs: np.ndarray) -> bytes:
    """Costs rounded to 13 bits of their fractions (1e-4 of each), compressed byte plane by byte plane."""
    bits = (costs.astype(np.float32).view(np.uint32) + np.uint32(1 << 9)) >> np.uint32(10)
    return zlib.compress(np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes(), 1)


def _unpack_costs(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(3, -1)
    bits = np.zeros((planes.shape[1], 4), np.uint8)
    bits[:, :3] = planes.T
    return (bits.reshape(-1).view(np.uint32) << np.uint32(10)).view(np.float32)


def _parted(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted windows in the order of their parts, and where each part begins and ends."""
    part = (mix((keys >> _U(8)) & _U(_SHORT - 1)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


_COUNTS = "part int, keys binary, counts binary"


def gather(training: DataFrame, parts: int) -> DataFrame:
    """``part``, ``keys``, ``counts``: all distinct windows of the training texts (one column ``text``).

    Negative parts hold the contexts of fewer than SHARED bytes: order 2, and with
    the next higher bit set the word so far.
    """

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            order, cuts = _parted(keys, parts)
            rows = [(p, keys[o], counts[o]) for p in np.flatnonzero(np.diff(cuts)) for o in (order[cuts[p] : cuts[p + 1]],)]
            words = word_so_far(keys)
            few = words < _U(_SHORT)
            short = _summed(np.concatenate((keys & _U(_SHORT - 1), words[few] + _U(_SHORT))), np.concatenate((counts, counts[few])))
            group = mix(short[0].copy()) % _U(SHORT_GROUPS)
            rows += [(-1 - g, *(a[group == _U(g)] for a in short)) for g in range(SHORT_GROUPS)]
            held.clear()
            return pd.DataFrame({"part": [r[0] for r in rows], "keys": [_pack_keys(r[1]) for r in rows], "counts": [_pack(r[2]) for r in rows]})

        for batch in batches:
            for _, some in _slices(as_bytes(batch["text"])):
                keys, number = distinct(windows(some)[0])
                held.append((keys, np.bincount(number, minlength=len(keys)).astype(float)))
                size += len(keys)
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(np.concatenate([_unpack_keys(k) for k in rows["keys"]]), np.concatenate([_unpack(c).view(float) for c in rows["counts"]]))
        return pd.DataFrame({"part": rows["part"][:1], "keys": [_pack_keys(keys)], "counts": [_pack(counts)]})

    return written(training.mapInPandas(count, _COUNTS).groupBy("part").applyInPandas(add, _COUNTS), "lm-windows")


Counts = tuple[np.ndarray, np.ndarray]


def _tables(short: Counts, own: Counts) -> list[Table]:
    """The tables of one part, from the short contexts of all and its own windows."""
    tables = []
    two = short[0] < _U(_SHORT)
    for order in ORDERS:
        keys, counts = own if order >= SHARED else (short[0][two], short[1][two])
        tables.append(Table(*_summed(keys & _U((1 << 8 * (order + 1)) - 1), counts)))
    words = word_so_far(own[0])
    long = words >= _U(_SHORT)
    tables.append(Table(*_summed(np.concatenate((short[0][~two] - _U(_SHORT), words[long])), np.concatenate((short[1][~two], own[1][long])))))
    return tables


def learn(counted: DataFrame) -> tuple[Counts, np.ndarray, np.ndarray]:
    """The short contexts, and the weights and the map that all windows of the training texts give.

    Every part learns online over its own windows, and the weights are averaged by
    the bits that each gate saw, ROUNDS times; then the map is counted over all
    windows.  The driver gets a few KB from each task.
    """
    spark = counted.sparkSession
    got = [(_unpack_keys(r["keys"]), _unpack(r["counts"]).view(float)) for r in counted.where("part < 0").toLocalIterator()]
    short = _summed(np.concatenate([np.zeros(0, _U), *(k for k, _ in got)]), np.concatenate([np.zeros(0), *(c for _, c in got)]))
    shared = spark.sparkContext.broadcast(short)

    def over_parts(f: Callable[[list[Table], np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The sum of the arrays of all parts; None without parts."""

        @tidied
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                for k, c in zip(batch["keys"], batch["counts"], strict=True):
                    own = _unpack_keys(k), _unpack(c).view(float)
                    new = f(_tables(shared.value, own), *own)
                    total = new if total is None else total + new
            if total is not None:
                yield pd.DataFrame({"sums": [total.astype(float).tobytes()]})

        rows = counted.where("part >= 0").repartition(shuffle_parts(spark), "part").mapInPandas(run, "sums binary").collect()
        return sum(np.frombuffer(r["sums"]) for r in rows) if rows else None

    weights = _start()
    for _ in range(ROUNDS):

        def weigh(tables: list[Table], keys: np.ndarray, counts: np.ndarray, weights: np.ndarray = weights) -> np.ndarray:
            new, seen = learn_weights(tables, keys, counts, weights)
            return np.column_stack((new * seen[:, None], seen)).ravel()

        sums = over_parts(weigh)
        if sums is not None:
            sums = sums.reshape(GATES, -1)
            seen = sums[:, -1:]
            weights = np.where(seen > 0, sums[:, :-1] / np.maximum(seen, 1), weights).astype(np.float32)
    found = over_parts(lambda tables, keys, counts: count_map(tables, keys, counts, weights).ravel())
    return short, weights, refining(np.zeros((2, GATES * MAP_STEPS)) if found is None else found.reshape(2, -1))


_ASKED = "part int, slice long, keys binary, id string, h long, text string"
_ROWS = "id string, h long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, times array<int>"


def _asker(parts: int) -> Callable:
    """Texts with the number of their slice (part -1), and each slice's distinct windows by part."""

    @tidied
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, some in _slices(as_bytes(batch["text"])):
                yield batch[lo : lo + len(some)].assign(part=-1, slice=at, keys=None)[["part", "slice", "keys", "id", "h", "text"]]
                keys = _sorted_windows(some)[0]
                order, cuts = _parted(keys, parts)
                full = np.flatnonzero(np.diff(cuts))
                packed = [_pack_keys(keys[order[cuts[p] : cuts[p + 1]]]) for p in full]
                yield pd.DataFrame({"part": full, "slice": at, "keys": packed, "id": None, "h": 0, "text": None})
                at += 1

    return ask


def priced(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """``part``, ``slice``, ``costs``: the bits of each window asked for, under the model of the counted windows."""
    shared = counted.sparkSession.sparkContext.broadcast(learn(counted))

    def price(rows: pd.DataFrame) -> pd.DataFrame:
        short, weights, refine = shared.value
        own = np.zeros(0, _U), np.zeros(0)
        for k, c in zip(rows["keys"], rows["counts"], strict=True):
            if c is not None:
                own = _unpack_keys(k), _unpack(c).view(float)
        rows = rows[rows["counts"].isna()]
        blocks = [_unpack_keys(k) for k in rows["keys"]]
        keys, number = np.unique(np.concatenate([np.zeros(0, _U), *blocks]), return_inverse=True)
        cost = Model(_tables(short, own), weights, refine).bits(keys)
        cuts = np.cumsum([0, *(len(b) for b in blocks)])
        return pd.DataFrame({"part": rows["part"], "slice": rows["slice"], "costs": [_pack_costs(cost[number[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    none = F.lit(None).cast("binary")
    both = counted.where("part >= 0").select("part", F.lit(-1).cast("long").alias("slice"), "keys", "counts").unionByName(asked.withColumn("counts", none))
    return both.groupBy("part").applyInPandas(price, "part int, slice long, costs binary")


def vocabulary(training: DataFrame) -> DataFrame:
    """``w`` and ``c``: every token's count in the training texts, the end token's included."""

    @tidied

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = texts = 0

        def flush() -> pd.DataFrame:
            names, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in held]), minlength=len(names)).astype(np.int64)
            return pd.DataFrame({"w": names.view(np.int64), "c": counts})

        for batch in batches:
            for _, some in _slices(as_bytes(batch["text"])):
                names, number = distinct(hashed_words(some)[0])
                held.append((names, np.bincount(number, minlength=len(names))))
                size += len(names)
                texts += len(some)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        if texts:
            yield pd.DataFrame({"w": np.array([END], np.int64), "c": np.array([texts], np.int64)})

    tasks = max(1, -(-training.rdd.getNumPartitions() // COALESCE))
    return training.coalesce(tasks).mapInPandas(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def score(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row of ``docs``: id and

    ``n_tokens`` (words and the end), ``n_known`` (those seen in ``training``),
    ``train_tokens``, ``base_score`` (log10 probability under add-one unigrams),
    ``score`` (the mixing model's log10 probability) and ``bits_per_byte``.
    Null counts as empty; an empty text is its end token alone.  Without training
    texts the model predicts every bit by a half.  Repeated rows stay; an empty
    table gives an empty result; other columns are ignored.
    """
    # larger batches than elsewhere: the more text at once, the fewer distinct windows
    with batches_of(docs.sparkSession, 2000, 16 << 20):
        return _scored(docs, training, id_col, text_col)


def _scored(docs: DataFrame, training: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    learned = training.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # ids of any type travel through pandas as text
    asked = docs.select(F.to_json(F.struct(F.col(id_col).alias("id"))).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    parts = max(shuffle_parts(spark), 2 * max(docs.rdd.getNumPartitions(), training.rdd.getNumPartitions()))
    counted = gather(learned, parts)
    sliced = written(asked.mapInPandas(_asker(parts), _ASKED), "lm-texts")
    costs = priced(counted, sliced.where("part >= 0").select("part", "slice", "keys"))

    vocab = written(vocabulary(learned), "lm-vocabulary")
    total = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    # the least power of two so that no more than FREQUENT words have that count
    steps = {r.k: r.words for r in vocab.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count("*").alias("words")).collect()}
    least, words = 64, 0
    for k in sorted(steps, reverse=True):
        words += steps[k]
        if words > FREQUENT:
            break
        least = k

    @tidied

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"w": [b["w"].to_numpy(np.int64).tobytes()], "c": [b["c"].to_numpy(np.int64).tobytes()]})

    packed = vocab.where(F.col("c") >= 2.0**least).mapInPandas(pack, "w binary, c binary").collect()
    names = np.frombuffer(b"".join(r.w for r in packed), _U)
    order = np.argsort(names)
    known = spark.sparkContext.broadcast((names[order], np.frombuffer(b"".join(r.c for r in packed), np.int64)[order].astype(float)))
    del packed, names, order

    def measure(texts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        names, counts = known.value
        logs = np.log10(counts + 1)
        end_log = float(logs[at[0]]) if len(at := np.flatnonzero(names == _U(END))) else 0.0
        some = as_bytes(texts["text"])
        keys, number, sizes = _sorted_windows(some)
        order, cuts = _parted(keys, parts)
        cost = np.zeros(len(keys), np.float32)
        for p, c in zip(blocks["part"], blocks["costs"], strict=True):
            cost[order[cuts[p] : cuts[p + 1]]] = _unpack_costs(c)
        bits = _per_text(cost[number], sizes)
        hashes, offsets = hashed_words(some)
        owner = np.repeat(np.arange(len(some)), np.diff(offsets))
        if len(names) and len(hashes):
            words, number = distinct(hashes)
            found = np.minimum(np.searchsorted(names, words), len(names) - 1)
            place, hit = found[number], (names[found] == words)[number]
        else:
            place, hit = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        base = np.bincount(owner[hit], logs[place[hit]], minlength=len(some)) + end_log
        seen = np.bincount(owner[hit], minlength=len(some)) + (end_log > 0)
        others, whose = hashes[~hit], owner[~hit]
        cut = np.searchsorted(whose, np.arange(len(some) + 1))
        rare, times = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            w, c = np.unique(others[a:b], return_counts=True)
            rare.append(w.view(np.int64))
            times.append(c.astype(np.int32))
        out = {"id": texts["id"], "h": texts["h"], "n_tokens": np.diff(offsets) + 1, "n_known": seen.astype(np.int64), "base": base}
        out |= {"score": -bits * np.log10(2.0), "n_bytes": sizes, "rare": rare, "times": times}
        return pd.DataFrame(out)

    texts = sliced.where("part < 0").select("slice", "id", "h", "text")
    rows = written(texts.groupBy("slice").cogroup(costs.groupBy("slice")).applyInPandas(measure, _ROWS), "lm-rows")
    of_id = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    rows = rows.withColumn("id", F.from_json("id", of_id)["id"])
    end_is_rare = not bool((known.value[0] == _U(END)).any())
    wanted = rows.select("id", "h", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("id", "h", F.col("z.rare").alias("w"), F.col("z.times").alias("times"))
    if end_is_rare:
        wanted = wanted.unionByName(rows.select("id", "h", F.lit(END).cast("long").alias("w"), F.lit(1).alias("times")))
    sums = (
        wanted.dropDuplicates(["id", "h", "w"])
        .join(vocab.where(F.col("c") < 2.0**least), "w")
        .groupBy("id", "h")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    )
    none = F.lit(0)
    return rows.join(sums, ["id", "h"], "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
