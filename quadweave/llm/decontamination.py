"""Benchmark decontamination by template windows (DataFrame functions only).

A text is read as words: runs of letters, or of digits.  Numbers, units behind
numbers, and capitalised words are *slots*, which a template replaces by typed
placeholders.  Every run of eight words is hashed twice: as folded words, and as a
template.  Windows of documents are joined by hash to the benchmark's, so a
question with other names or numbers meets its template, and a copy in another
case, or of few literal words, meets its plain words.  Where a template matched,
slots are checked along the alignment: a benchmark value always stands for the
same value.  That is done twice over, as a capitalised word at a sentence's
beginning may be a name (*wide*) or a word like others, which must then be equal
(*narrow*).  A conflict takes away what that reading of the alignment matched, not
what is equal word for word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Words of a window, literal words that a template window has at least, share of an item's windows that marks a leak.
WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: Distinct benchmark hashes up to which they are sent to all executors (8 bytes each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: Rows of documents up to which they are sent to all executors (an id and a hash each).
BROADCAST_IDS = 1_000_000

#: Markers of capitalised words at a sentence's beginning, of names inside, numbers and units; they stand before the word.
FIRST, NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003", "\u0004"
#: Words that count as numbers, and words that count as units behind a number (fixed lists).
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNIT_WORDS = (
    "kg g mg lb lbs oz pound pounds ton tons gram grams kilogram kilograms km m cm mm mile miles foot feet ft inch inches yard yards "
    "meter meters metre metres kilometer kilometers kilometre kilometres l ml liter liters litre litres gallon gallons cup cups "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees mph kmh"
).split()
#: A token: a number, or a word with the sentence's end before it (both the Java and the RE2 dialect read it alike).
TOKEN = r"[0-9]+|(?:[.!?:][^\p{L}\p{M}0-9]*)?[\p{L}\p{M}]+"
BEFORE_WORD = r"^[^\p{L}\p{M}]+"
#: How a match was found: by plain words, by a template with names inside sentences only, with names anywhere.
PLAIN, NARROW, WIDE = range(3)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The folded words of a text as an array, slots behind their markers."""

    def judged(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            counted = F.coalesce(((before >= "0") & (before < ":")) | F.lower(before).isin(NUMBER_WORDS), F.lit(False))

            def cased(core: Column) -> Column:
                w = F.lower(core)
                capital = (F.substring(core, 1, 1) != F.substring(w, 1, 1)) & (F.substring(core, 2, 1) == F.substring(w, 2, 1)) & (F.length(core) > 1)
                return (
                    F.when(w.isin(NUMBER_WORDS), F.concat(F.lit(NUMBER), w))
                    .when(capital, F.concat(F.when((i == 0) | (t < "A"), FIRST).otherwise(NAME), w))
                    .when(w.isin(UNIT_WORDS) & counted, F.concat(F.lit(UNIT), w))
                    .otherwise(w)
                )

            # most words are plain ones in lower case: they pass by three comparisons
            plain = (t >= "a") & (t == F.lower(t)) & ~t.isin(NUMBER_WORDS + UNIT_WORDS)
            number = (t >= "0") & (t < ":")
            return F.when(plain, t).when(number, F.concat(F.lit(NUMBER), t)).otherwise(_let(F.when(t < "A", F.regexp_replace(t, BEFORE_WORD, "")).otherwise(t), cased))

        return F.transform(tokens, one)

    return _let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), judged)


def _bare(x: Column) -> Column:
    """A word without its marker."""
    return F.when(x >= " ", x).otherwise(F.substring(x, 2, 1 << 30))


def _is_first(x: Column) -> Column:
    return x < NAME


def valued(text: Column) -> Column:
    """The words of a text, single blanks between them, names inside sentences, numbers and units behind their markers."""
    return F.array_join(F.transform(words(text), lambda x: F.when(_is_first(x), _bare(x)).otherwise(x)), " ")


def _plain_hashes(some: Column) -> Column:
    return F.transform(some, lambda x: F.xxhash64(_bare(x)))


def _template_hashes(some: Column) -> Column:
    def one(x: Column) -> Column:
        marker = F.when(x < NUMBER, F.xxhash64(F.lit(NAME))).when(x < UNIT, F.xxhash64(F.lit(NUMBER))).otherwise(F.xxhash64(F.lit(UNIT)))
        return F.when(x >= " ", F.xxhash64(x)).otherwise(marker)

    return F.transform(some, one)


def _joined(a: Column, b: Column, k: int) -> Column:
    """Hashes of the runs in ``a`` with those in ``b`` that begin ``k`` words later."""
    n = F.greatest(F.size(b) - k, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, k + 1, n), lambda x, y: F.xxhash64(x, y))


def _runs(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words: halves are hashed first, so that a run costs few steps."""
    if size == 1:
        return hashes
    k = 1 << (size - 1).bit_length() - 1
    if 2 * k == size:
        return _let(_runs(hashes, k), lambda half: _joined(half, half, k))
    return _joined(_runs(hashes, k), _runs(hashes, size - k), k)


def _windows(some: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words: pairs of ``p`` (plain) and ``t`` (template)."""
    return _let(
        some,
        lambda w: F.arrays_zip(_let(_plain_hashes(w), lambda h: _runs(h, size)).alias("p"), _let(_template_hashes(w), lambda h: _runs(h, size)).alias("t")),
    )


def _distinct(x: Column) -> Column:
    """A run's hashes, each once."""
    return F.when(x["t"] == x["p"], F.array(x["p"])).otherwise(F.array(x["p"], x["t"]))


def _index(items: DataFrame, window: int, literals: int) -> DataFrame:
    """``item, at, h`` of every window of the items (``item, words``); ``plain``, or which templates it may match by.

    An item shorter than a window is one window of its own length.
    """
    sized = items.withColumn("size", F.size("words"))
    parts = [
        sized.where(F.col("size") >= n if n == window else F.col("size") == n).select("item", "words", F.posexplode(_windows(F.col("words"), n)).alias("at", "x"))
        for n in range(1, window + 1)
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    piece = F.slice("words", F.col("at") + 1, window)
    slots = F.size(F.filter(piece, lambda x: x < " "))
    firsts = F.size(F.filter(piece, _is_first))
    narrow, wide = (slots > firsts) & (F.size(piece) - slots + firsts >= literals), (slots > 0) & (F.size(piece) - slots >= literals)
    both = every.select("item", "at", "x", narrow.alias("narrow"), wide.alias("wide"))
    no = F.lit(False)
    entries = [
        F.struct(F.col("x.p").alias("h"), no.alias("narrow"), no.alias("wide"), F.lit(True).alias("plain")),
        F.struct(F.col("x.t").alias("h"), F.col("narrow"), F.col("wide"), no.alias("plain")),
    ]
    return both.select("item", "at", F.explode(F.array(*entries)).alias("e")).select("item", "at", "e.*").where("plain or narrow or wide").distinct()


def _document_hashes(own: DataFrame, short: list[int], window: int, literals: int) -> DataFrame:
    """``key, pos, h`` of every window of the documents (``key, words``).

    Beside windows of ``window`` words there are those as long as the shorter items
    (``short``); of fewer than ``literals`` words only where the document has no other.
    A template of a shorter window counts only where it is the whole document, too.
    """

    def every(w: Column) -> Column:
        runs = [F.transform(_windows(w, window), _distinct)]
        for n in short:
            whole = F.when(F.size(w) == n, F.transform(_windows(w, n), _distinct))
            runs.append(whole.otherwise(F.transform(_let(_plain_hashes(w), lambda h: _runs(h, n)), lambda h: F.array(h)) if n >= literals else F.array().cast("array<array<bigint>>")))  # noqa: B023
        return F.array(*runs)

    if not short:
        lists = own.select("key", F.posexplode(_windows(F.col("words"), window)).alias("pos", "x"))
        return lists.select("key", "pos", F.explode(_distinct(F.col("x"))).alias("h"))
    sizes = own.select("key", F.explode(_let(F.col("words"), every)).alias("runs"))
    return sizes.select("key", F.posexplode("runs").alias("pos", "hs")).select("key", "pos", F.explode("hs").alias("h"))


def _template_matches(hits: DataFrame, index: DataFrame) -> DataFrame:
    """``key, item, at, pos, narrow, wide``: places where a template of an item stands in a document.

    A template that an item holds several times could stand for each of them at every
    place; it counts only along alignments on which one that the item holds once stands, too.
    """
    index = index.join(index.groupBy("item", "h").agg(F.count("*").alias("times")), ["item", "h"])
    once = hits.join(index.where("times = 1"), ["item", "h"]).select("key", "item", "at", "pos", "narrow", "wide").distinct()
    along = once.select("key", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    again = along.join(index.where("times > 1"), "item").withColumn("pos", F.col("at") + F.col("shift"))
    return once.unionByName(again.join(hits.distinct(), ["key", "item", "pos", "h"]).select(once.columns))


def _by_templates(found: DataFrame, texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``key, item, at, shift, kind, z`` (pairs of words) of template matches; a word at a sentence's beginning is a name in wide ones only."""
    keys = found.select("key").distinct()
    if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    ours = texts.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", words(F.col("text")).alias("got"))
    z = F.arrays_zip(F.slice("got", F.col("pos") + 1, window).alias("got"), F.slice("words", F.col("at") + 1, window).alias("own"))
    firm = F.forall("z", lambda z: ~(_is_first(z["got"]) | _is_first(z["own"])) | (_bare(z["got"]) == _bare(z["own"])))
    kinds = F.array_compact(F.array(F.when(F.col("narrow") & firm, NARROW), F.when(F.col("wide"), WIDE)))
    return (
        found.join(ours, "key")
        .join(items, "item")
        .select("key", "item", "at", (F.col("pos") - F.col("at")).alias("shift"), "narrow", "wide", z.alias("z"))
        .select("key", "item", "at", "shift", F.explode(kinds).alias("kind"), "z")
    )


def _conflicts(matched: DataFrame) -> DataFrame:
    """The alignments (``key, item, shift, kind``) along which a benchmark value stands for two values."""
    slots = F.filter("z", lambda z: (z["own"] < " ") & ((F.col("kind") == WIDE) | ~_is_first(z["own"])))
    return (
        matched.select("key", "item", "shift", "kind", F.explode(slots).alias("z"))
        .groupBy("key", "item", "shift", "kind", _bare(F.col("z.own")).alias("own"))
        .agg(F.min(_bare(F.col("z.got"))).alias("lo"), F.max(_bare(F.col("z.got"))).alias("hi"))
        .where("lo <> hi")
        .select("key", "item", "shift", "kind")
        .distinct()
        .withColumn("bad", F.lit(True))
    )


def _texts(table: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``key`` (id and hash of the text, so that rows of one id are told apart) and ``text`` of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return table.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")).alias(key), text.alias("text"))


def _pairs(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, literals: int, coverage: float, broadcast_windows: int
) -> DataFrame:
    """What ``leaks`` returns, by ``key`` and ``item`` as ``_texts`` makes them."""
    items = _texts(benchmark, item_col, item_text_col, "item").dropDuplicates(["item"]).select("item", words(F.col("text")).alias("words"))
    items = written(items.where(F.size("words") > 0), "benchmark-words")
    index = written(_index(items, window, literals), "benchmark-windows")
    totals = index.groupBy("item").agg(F.countDistinct("at").cast("long").alias("windows"))
    short = sorted(r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())  # fewer than window numbers
    hashes = index.select("h").distinct()
    if hashes.limit(broadcast_windows + 1).count() <= broadcast_windows:
        hashes = F.broadcast(hashes)
    texts = _texts(docs, id_col, text_col, "key")
    own = texts.select("key", words(F.col("text")).alias("words"))
    met = written(_document_hashes(own, short, window, literals).join(hashes, "h"), "template-windows")
    # an item's rarest windows, so many that no document can hold the share asked for without one of them
    shared = index.join(index.groupBy("h").agg(F.countDistinct("item").alias("items")), "h").groupBy("item", "at").agg(F.max("items").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "at"))
    rare = shared.withColumn("rank", rank).join(totals, "item").where(F.col("rank") <= F.col("windows") - F.greatest(F.ceil(F.col("windows") * coverage), F.lit(1)) + 1)
    probes = index.join(rare.select("item", "at"), ["item", "at"]).select("item", "h").distinct()
    likely = met.join(probes, "h").select("key", "item").distinct()
    hits = written(met.join(likely, "key"), "window-hits")
    equal = hits.select("key", "item", "h").distinct().join(index.where("plain"), ["item", "h"]).select("key", "item", "at").distinct()
    matches = written(_template_matches(hits, index.where("narrow or wide").drop("plain")), "template-hits")
    by_templates = written(_by_templates(matches, texts, items, window), "template-matches")
    nowhere = F.lit(None).cast("int")
    found = equal.select("key", "item", "at", nowhere.alias("shift"), F.lit(PLAIN).alias("kind")).unionByName(by_templates.drop("z"))
    return (
        found.join(_conflicts(by_templates), ["key", "item", "shift", "kind"], "left")
        .groupBy("key", "item")
        .agg(F.countDistinct(F.when(F.col("bad").isNull(), F.col("at"))).alias("matched"), F.countDistinct(F.when(F.col("bad"), F.col("shift"))).alias("conflicts"))
        .join(totals, "item")
        .withColumn("coverage", F.col("matched") / F.col("windows"))
        .where(F.col("coverage") >= coverage)
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    literals: int = LITERALS,
    coverage: float = COVERAGE,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document and benchmark item that it contains.

    Columns: id, item, ``matched`` (distinct windows of the item found, by plain
    words or along alignments without slot conflict), ``windows`` (of the item),
    ``conflicts`` (alignments of which templates were dropped because a slot value
    stood for two values) and ``coverage`` = matched / windows, at least the given
    share.  Every window of an item counts; those with fewer than ``literals``
    literal words are found by their plain words only, and so is an item all of whose
    templates it holds more than once.  An item shorter than a
    window is one window of its own length, found inside documents by its plain
    words, and by its template where it is the whole document; of fewer than
    ``literals`` words it is found only as a whole document.  Null and empty
    texts contain nothing; texts that share an id are read one by one, and the best
    counts; null ids are kept; empty tables give an empty result; other columns are
    ignored.
    """
    found = _pairs(docs, benchmark, id_col, text_col, item_col, item_text_col, window, literals, coverage, broadcast_windows)
    best = F.max_by(F.struct("matched", "windows", "conflicts", "coverage"), F.struct("coverage", "matched", -F.col("conflicts")))
    return found.groupBy(F.col("key.id").alias(id_col), F.col("item.id").alias(item_col)).agg(best.alias("r")).select(id_col, item_col, "r.*")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    literals: int = LITERALS,
    coverage: float = COVERAGE,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no benchmark item (see ``leaks``)."""
    found = _pairs(docs, benchmark, id_col, text_col, item_col, item_text_col, window, literals, coverage, broadcast_windows)
    found = written(found.select(F.col("key").alias("key of row")).distinct(), "leaks")
    if found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"))
    return docs.withColumn("key of row", key).join(found, "key of row", "left_anti").select(docs.columns)
