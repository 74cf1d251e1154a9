"""Near-duplicate detection: MinHash bands, odd sketches, exact confirmation.

Texts with equal shingle sets become one representative.  Bands of its MinHash
samples put it into buckets; pairs to confirm come from two steps.  First every
member is compared with the bucket leader it shares most bands with, which
joins groups of copies without listing their pairs.  Then only members of one
bucket that are still in different components are compared, in blocks.  Both
steps drop pairs by *odd sketches*: the samples are folded into a parity bitmap,
and the population count of two bitmaps' XOR bounds the share of samples in which
they differ.  The second step adds a finer sketch of more samples, made for the
members still in question.  What is left is confirmed on the full shingle sets, in
the second step inside the block: pairs never become rows, only members that have
a candidate, and links that join two components of a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import joined_by_size, tidied, written
from .textkit import as_bytes, hashed_words, mix

_U = np.uint64
#: Bits of an odd sketch; samples and bits of a fine one.
SKETCH_BITS = 256
FINE_SAMPLES, FINE_BITS = 1536, 2048
#: Members of a bucket that are compared with each other in one block.
BLOCK = 512
#: Shingles of a bucket that make one block at most (on average): a worker holds two blocks.
BLOCK_SHINGLES = 1 << 20
#: Pairs whose fine sketches are compared at once.
PAIRS = 1 << 15
#: Ids up to which they are sent to all executors (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Bytes of text for which one worker holds shingles at a time.
SLICE = 1 << 20


@dataclass(frozen=True)
class Plan:
    """Bands for a threshold: chosen so that a pair at it is missed once in a million."""

    words: int
    percent: int
    rows: int
    bands: int
    sketch_limit: int

    @staticmethod
    def of(words: int, percent: int, miss: float = 1e-6) -> Plan:
        share = percent / 100
        rows = 6 if percent >= 85 else 5 if percent >= 75 else 3
        bands = math.ceil(math.log(miss) / math.log1p(-(share**rows)))
        return Plan(words, percent, rows, bands, sketch_limit(rows * bands, SKETCH_BITS, share))


def sketch_limit(samples: int, bits: int, share: float) -> int:
    """Differing bits that two sketches at the threshold exceed with odds of a few in ten million.

    The samples that differ are binomial, and each flips one bit of either
    sketch; five standard deviations of both effects together are allowed.
    """
    differ = samples * (1 - share)
    stay = (1 - 2 / bits) ** (2 * differ)
    by_samples = 2 * math.sqrt(differ * share) * stay
    by_clashes = math.sqrt(bits * (1 - stay**2)) / 2
    return min(bits, math.ceil(bits / 2 * (1 - stay) + 5 * math.hypot(by_samples, by_clashes)))


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Fewer words than a shingle: the whole sequence is one; no word: none.
    """
    with np.errstate(over="ignore"):
        weights = mix(np.arange(1, words + 1, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
        found: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
                size += len(texts[j])
                j += 1
            hashes, at = hashed_words(texts[i:j])
            rolled = sum((hashes[k : len(hashes) - words + 1 + k] * weights[k] for k in range(words)), _U(0)) if len(hashes) >= words else None
            if rolled is not None:
                rolled = mix(rolled)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo >= words:
                    found.append(np.unique(rolled[lo : hi - words + 1]))
                elif hi > lo:
                    some = (hashes[lo:hi] * weights[: hi - lo]).sum(dtype=_U) + _U(hi - lo) * _U(0x94D049BB133111EB)
                    found.append(mix(np.array([some], _U)))
                else:
                    found.append(np.zeros(0, _U))
            i = j
    return found


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def signatures(sets: list[np.ndarray], plan: Plan) -> dict[str, np.ndarray]:
    """Set digests, band hashes and odd sketches of non-empty shingle sets."""
    n, samples = len(sets), plan.rows * plan.bands
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    with np.errstate(over="ignore"):
        high = np.add.reduceat(mix(every + _U(1)), starts)
        low = np.add.reduceat(mix(every ^ _U(0x5851F42D4C957F2D)), starts)
        short = (every >> _U(32)).astype(np.uint32)
        keys = mix(np.arange(1, 2 * samples + 1, dtype=_U) * _U(0x9FB21C651E98DF25)).astype(np.uint32)
        mins = np.empty((samples, n), np.uint32)
        work = np.empty_like(short)
        sketch = np.zeros((n, SKETCH_BITS), np.uint8)
        line = np.arange(n)
        for i in range(samples):
            np.bitwise_xor(short, keys[i], out=work)
            work *= keys[samples + i] | np.uint32(1)
            mins[i] = np.minimum.reduceat(work, starts)
            bit = mix(mins[i].astype(_U) + _U(i << 32)) % _U(SKETCH_BITS)
            sketch[line, bit.astype(np.int64)] ^= 1
        bands = np.empty((n, plan.bands), _U)
        for b in range(plan.bands):
            value = np.full(n, b + 1, _U)
            for r in range(plan.rows):
                value = mix(value * _U(0xC6A4A7935BD1E995) + mins[b * plan.rows + r])
            bands[:, b] = value
    bits = np.packbits(sketch, axis=1).view(np.int64)
    return {"high": _signed(high), "low": _signed(low), "bands": _signed(bands), "bits": bits}


def fine_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of FINE_BITS / 64 words for each non-empty set."""
    n = len(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((n, FINE_BITS), np.uint8)
    line = np.arange(n)
    with np.errstate(over="ignore"):
        short = (mix(np.concatenate(sets) ^ _U(0x2545F4914F6CDD1D)) >> _U(32)).astype(np.uint32)
        keys = mix(np.arange(1, 2 * FINE_SAMPLES + 1, dtype=_U) * _U(0xDA942042E4DD58B5)).astype(np.uint32)
        work = np.empty_like(short)
        for i in range(FINE_SAMPLES):
            np.bitwise_xor(short, keys[i], out=work)
            work *= keys[FINE_SAMPLES + i] | np.uint32(1)
            least = np.minimum.reduceat(work, starts).astype(_U)
            out[line, (mix(least + _U(i << 32)) % _U(FINE_BITS)).astype(np.int64)] ^= 1
    return np.packbits(out, axis=1).view(np.int64)


_SIGNATURE = "n long, high long, low long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def _signature_table(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf(_SIGNATURE)
    @tidied
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            raw = as_bytes(texts)
            parts = []
            i = 0
            while i < len(raw):
                j, size = i, 0
                while j < len(raw) and (j == i or size + len(raw[j]) <= SLICE):
                    size += len(raw[j])
                    j += 1
                sets = shingles(raw[i:j], plan.words)
                sizes = np.array([len(s) for s in sets], np.int64)
                out = pd.DataFrame({"n": sizes})
                full = np.flatnonzero(sizes)
                for c in ("high", "low", "s0", "s1", "s2", "s3"):
                    out[c] = 0
                bands: list = [[]] * len(sets)
                if len(full):
                    s = signatures([sets[k] for k in full], plan)
                    for c, v in (("high", s["high"]), ("low", s["low"]), *((f"s{k}", s["bits"][:, k]) for k in range(4))):
                        column = np.zeros(len(sets), np.int64)
                        column[full] = v
                        out[c] = column
                    for k, b in zip(full, s["bands"], strict=True):
                        bands[k] = b
                out["bands"] = bands
                parts.append(out[["n", "high", "low", "bands", "s0", "s1", "s2", "s3"]])
                i = j
            yield pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in _SIGNATURE.split(", ")])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"), sign(text).alias("s")).select(
        F.monotonically_increasing_id().alias("row"), F.struct("id", "text").alias("key"), "s.*"
    )


def _alike(plan: Plan) -> Column:
    """Whether sizes and odd sketches of sides x and y allow the threshold."""
    differ = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(4)), F.lit(0))
    return (
        (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * plan.percent) & (differ <= plan.sketch_limit)
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("same"), (F.size("ia") + F.size("ib") - both).alias("all"))
        .where(F.col("same") * 100 >= F.col("all") * plan.percent)
        .select("a", "b")
    )


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables that hold whole blocks, and the blocks' places, of rows sorted by ``band``, ``i`` and ``j``."""

    def keys(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy().astype(np.int64) for c in ("band", "i", "j")])

    def placed(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
        table = pa.Table.from_batches(held).combine_chunks()
        key = keys(table)
        at = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        return table, list(zip(at[:-1], at[1:], strict=True))

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = keys(batch)
        if held and (key[:, 0] != last).any():
            yield placed(held)
            held = []
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if len(cuts):
            yield placed([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
        last = key[:, -1]
    if held:
        yield placed(held)


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _sides(own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Members to compare: those of block ``i`` with those of ``j``."""
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def _with_candidates(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the members of a block that sizes and sketches allow to be linked with a member of another component.

    A pair counts in the first band that it shares only.
    """
    limit = sketch_limit(FINE_SAMPLES, FINE_BITS, plan.percent / 100)

    def marks(t: dict, lo: int, hi: int) -> np.ndarray:
        band, i, j = (int(t[c][lo]) for c in ("band", "i", "j"))
        left, right = _sides(t["own"][lo:hi], i, j)
        out = np.zeros(hi - lo, bool)
        if not len(left) or not len(right):
            return out
        n, root, coarse, fine, bands = (t[c][lo:hi] for c in ("n", "root", "s", "f", "bands"))
        step = max(1, PAIRS // len(right))
        for k in range(0, len(left), step):
            x, y = left[k : k + step, None], right[None, :]
            some = (root[x] != root[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * plan.percent)
            if i == j:
                some &= x < y
            a, b = np.nonzero(some)
            a, b = left[k + a], right[b]
            for sketch, most in ((coarse, plan.sketch_limit), (fine, limit)):
                near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= most
                a, b = a[near], b[near]
            shared = bands[a] == bands[b]
            first = np.where(shared, bands[a], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == band
            out[a[first]] = out[b[first]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _whole_blocks(batches):
            rows = table.num_rows
            t = {c: table.column(c).to_numpy() for c in ("band", "i", "j", "own", "id", "root", "n")}
            t["s"] = np.stack([table.column(f"s{k}").to_numpy() for k in range(4)], axis=1).view(_U)
            t["f"], t["bands"] = (_lists(table, c)[0].reshape(rows, -1) for c in ("f", "bands"))
            t["f"] = t["f"].view(_U)
            kept = np.concatenate([marks(t, lo, hi) for lo, hi in blocks])
            if kept.any():
                yield from table.select(["band", "i", "j", "own", "id", "root"]).filter(pa.array(kept)).to_batches()

    return run


def _links_of_block(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) of a block on its members' full sets: those that join two of its components, so fewer than members."""

    def links(own: np.ndarray, i: int, j: int, root: np.ndarray, values: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        n = np.diff(at)
        label = np.unique(root, return_inverse=True)[1]
        number = np.unique(values[at[0] : at[-1]], return_inverse=True)[1]
        at = at - at[0]
        held = np.zeros(len(number), np.uint8)
        left, right = _sides(own, i, j)
        for x in left:
            other = right[(label[right] != label[x]) & (np.minimum(n[x], n[right]) * 100 >= np.maximum(n[x], n[right]) * plan.percent)]
            if i == j:
                other = other[other > x]
            if not len(other):
                continue
            mine = number[at[x] : at[x + 1]]
            held[mine] = 1
            same = np.add.reduceat(held[np.concatenate([number[at[y] : at[y + 1]] for y in other])], np.cumsum([0, *n[other][:-1]]), dtype=np.int64)
            held[mine] = 0
            for y in other[same * 100 >= (n[x] + n[other] - same) * plan.percent]:
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _whole_blocks(batches):
            i, j, own, ids, root = (table.column(c).to_numpy() for c in ("i", "j", "own", "id", "root"))
            values, at = _lists(table, "items")
            found = [
                (min(ids[lo + x], ids[lo + y]), max(ids[lo + x], ids[lo + y]))
                for lo, hi in blocks
                for x, y in links(own[lo:hi], i[lo], j[lo], root[lo:hi], values, at[lo : hi + 1])
            ]
            if found:
                a, b = (pa.array(np.array(c, np.int64)) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if their sets of distinct ``words``-word shingles have
    100 * intersection >= ``percent`` * union; ``component_id`` is the least id
    reachable over links, and a row is ``kept`` if that is its own.  Null, empty and
    blank texts have no shingles and are linked with nothing.  Equal texts are linked
    whatever their length.  Rows that repeat an id are judged by their own text, so
    are null ids; they come after all others, and a component of nothing else has the
    null id and is kept.  An empty table gives an empty result; other columns are
    ignored.
    """
    return _judged(docs, words, percent, id_col, text_col, block).select(
        F.col("key.id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("key.id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _judged(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """``key`` (id, and hash of the text), ``n``, ``root`` (of the component; null without shingles) and ``component_id`` of each row.

    What is linked are *classes*, the texts with one shingle set; a class goes by the
    number of its first row, so that ids may repeat.
    """
    plan = Plan.of(words, percent)
    signed = written(_signature_table(docs, plan, id_col, text_col), "signatures")
    digest = ["high", "low", "n"]
    classes = written(
        signed.where("n > 0").groupBy(*digest).agg(F.min("row").alias("id"), F.min("key.id").alias("least"), F.count("*").alias("rows")), "shingle-classes"
    )
    reps = signed.join(classes.select(F.col("id").alias("row")), "row").withColumnRenamed("row", "id")
    sketches = ["id", "n", "s0", "s1", "s2", "s3"]
    banded = reps.select(F.explode("bands").alias("band"), *sketches[:2])
    weight = F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)
    buckets = (
        banded.groupBy("band")
        .agg(F.min("id").alias("leader"), F.count("*").alias("members"), F.ceil(weight).cast("int").alias("blocks"))
        .where("members > 1")
        .drop("members")
    )
    banded = banded.drop("n")
    members = written(banded.join(buckets, "band"), "buckets")
    involved = members.select("id").distinct()
    light = written(reps.select(*sketches).join(involved, "id", "left_semi"), "sketches")

    @F.pandas_udf("array<long>")
    @tidied
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_signed(s) for s in shingles(as_bytes(texts), words)], dtype=object)

    text = F.col(text_col).cast("string")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")).alias("key"), text.alias("text"))
    wanted = reps.join(involved, "id", "left_semi").select("key", "id")
    sets = written(texts.join(wanted, "key").dropDuplicates(["id"]).select("id", items("text").alias("items")), "shingle-sets")

    # each member against the leader with whom it shares most bands
    shared = members.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("times"))
    best = shared.groupBy("id").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("leader"))
    first = (
        best.alias("p")
        .join(light.alias("x"), F.col("p.id") == F.col("x.id"))
        .join(light.alias("y"), F.col("p.leader") == F.col("y.id"))
        .where(_alike(plan))
        .select(F.col("p.id").alias("a"), F.col("p.leader").alias("b"))
    )
    links = written(_confirmed(first, sets, plan), "links")
    found = components(links)

    # members of a bucket that are still apart, block against block
    placed = (
        members.join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("band", "id", "blocks", F.coalesce("root", "id").alias("root"))
    )
    apart = (
        placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    )

    @F.pandas_udf("array<long>")
    @tidied
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            found = [np.asarray(x, np.int64).view(_U) for x in many]
            out: list[np.ndarray] = []
            i = 0
            while i < len(found):
                j, size = i, 0
                while j < len(found) and (j == i or size + len(found[j]) <= SLICE // 4):
                    size += len(found[j])
                    j += 1
                out += list(fine_sketches(found[i:j]))
                i = j
            yield pd.Series(out, dtype=object)

    open_members = written(placed.join(apart.select("band"), "band", "left_semi"), "open-buckets")
    open_ids = open_members.select("id").distinct()
    finer = written(sets.join(open_ids, "id", "left_semi").select("id", fine("items").alias("f")), "fine-sketches")
    marked = reps.join(open_ids, "id", "left_semi").select(*sketches, "bands").join(finer, "id")
    spread = (
        open_members.join(marked, "id")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .select("band", "i", "j", "own", "root", "f", "bands", *sketches)
    )
    place = ["band", "i", "j"]
    lone = "band long, i int, j int, own int, id long, root long"
    candidates = spread.repartition(*place).sortWithinPartitions(*place).mapInArrow(tidied(_with_candidates(plan)), lone)
    whole = written(candidates, "candidates").join(sets, "id")
    linked = whole.repartition(*place).sortWithinPartitions(*place).mapInArrow(tidied(_links_of_block(plan)), "a long, b long")
    more = written(linked.distinct(), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("members"))
    named = joined_by_size(rooted.select(*digest, "root", "rows"), written(least, "components"), ["root"], "members")
    rows = joined_by_size(signed.where("n > 0").select("key", *digest), written(named, "named-classes"), digest, "rows")
    alone = signed.where("n = 0").select("key", "n", F.lit(None).cast("long").alias("root"), F.col("key.id").alias("component_id"))
    return rows.select("key", "n", "root", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their component: its least id, once.

    Of rows with one id and text one stays, which is arbitrary; of linked texts that
    share the least id the one with the least hash.  Texts without shingles stay.
    Up to BROADCAST_IDS rows that go are sent to all executors, beyond that both
    sides are shuffled.
    """
    judged = written(_judged(docs, words, percent, id_col, text_col), "judged")
    least = F.col("key.id").eqNullSafe(F.col("component_id"))
    # linked texts under one least id: there are none unless ids repeat
    several = written(judged.where((F.col("n") > 0) & least).groupBy("root").agg(F.min("key.text").alias("lo"), F.max("key.text").alias("hi")).where("lo <> hi"), "repeated-least")
    gone = judged.where((F.col("n") > 0) & ~least).select("key")
    if not several.isEmpty():
        gone = gone.unionByName(judged.where((F.col("n") > 0) & least).join(several, "root").where(F.col("key.text") != F.col("lo")).select("key"))
    mark = "key of row"
    gone = written(gone.select(F.col("key").alias(mark)).distinct(), "near-duplicates")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn(mark, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text")))
    left = keyed.join(gone, mark, "left_anti")
    twice = written(judged.groupBy("key").count().where("count > 1").select(F.col("key").alias(mark)), "repeated-rows")
    if twice.isEmpty():
        return left.select(docs.columns)
    place = "place of row"
    order = Window.partitionBy(mark).orderBy(F.col(f"`{mark}`.id"))
    repeated = left.join(twice, mark, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return left.join(twice, mark, "left_anti").select(docs.columns).unionByName(repeated.select(docs.columns))
