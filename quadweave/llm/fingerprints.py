"""Canonical exact document fingerprints.

A text is normalised (Unicode NFKC, case folding, runs of white space to one
space) and its canonical bytes hashed to 128 bits by xxh3.  Documents are grouped
by the hash, and inside a group of two or more the canonical bytes themselves
are compared: where bytes differ, all texts with that hash get a second one (SHA-256)
behind it.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import joined_by_size, shuffle_parts, tidied, written

#: Bits of the filter for repeated hashes (six hex digits); its 2 MB don't depend on the data.
FILTER_BITS = 1 << 24
_BITMAP = 32768  # bits of one bitmap of Spark's bitmap functions


def canonical(text: str | None) -> bytes:
    """The bytes that are hashed and compared; null counts as empty."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes, width: int = 32) -> str:
    """Hex digits of the canonical bytes' hash; fewer than 32 only serve to test clashes."""
    return xxhash.xxh3_128_hexdigest(canon)[:width]


def second(canon: bytes) -> str:
    """What tells texts with one hash apart."""
    return hashlib.sha256(canon).hexdigest()[:32]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 32) -> DataFrame:
    """``id``, ``fp`` and ``sha`` of each row, before buckets are compared."""

    @F.pandas_udf("fp string, sha string")
    @tidied
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(digest(c, width), second(c)) for c in map(canonical, texts)], columns=["fp", "sha"])

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col).cast("string")).alias("d")).select("id", "d.*")


def clashes(hashed: DataFrame, docs: DataFrame, text_col: str = "text", width: int = 32) -> DataFrame:
    """The hashes ``fp`` that texts with different bytes share, by comparing bytes in equal buckets.

    Only rows that may share a hash with another row are read again: a filter of
    fixed size over the repeated hashes picks them, and equal texts of one task
    are merged before they are sent.
    """
    spark = docs.sparkSession
    buckets = hashed.groupBy("fp").agg(F.count("*").alias("n"))
    bit = F.conv(F.substring("fp", 1, 6), 16, 10).cast("long")
    maps = (
        buckets.where("n > 1")
        .select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / _BITMAP).cast("int").alias("k"))
        .agg(F.bitmap_construct_agg(F.col("bit") % _BITMAP).alias("bits"))
        .collect()
    )
    spots = np.zeros((FILTER_BITS // _BITMAP, _BITMAP // 8), np.uint8)
    for row in maps:
        spots[row.k] = np.frombuffer(row.bits, np.uint8)
    shared = spark.sparkContext.broadcast(spots.reshape(-1))

    @F.pandas_udf("fp string, canon binary")
    @tidied
    def again(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                canon = canonical(text)
                at = int((fp := digest(canon, width))[:6], 16)
                rows.append((fp, canon if bits[at >> 3] >> (at & 7) & 1 else None))
            yield pd.DataFrame(rows, columns=["fp", "canon"])

    repeated = docs.select(again(F.col(text_col).cast("string")).alias("c")).where("c.canon is not null").select("c.fp", "c.canon")
    return written(repeated.distinct().groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "fingerprint-clashes")


def labelled(hashed: DataFrame, clashing: DataFrame, fp: str, sha: str, name: str) -> DataFrame:
    """``hashed`` with its columns ``fp`` and ``sha`` made one fingerprint ``name``: the hash, and the second one where it clashes."""
    if clashing.isEmpty():
        return hashed.withColumnRenamed(fp, name).drop(sha)
    mark = "hash clashes"
    marked = hashed.join(clashing.select(F.col("fp").alias(fp), F.lit(True).alias(mark)), fp, "left")
    return marked.withColumn(name, F.when(F.col(mark), F.concat_ws("-", fp, sha)).otherwise(F.col(fp))).drop(fp, sha, mark)


def resolve(hashed: DataFrame, docs: DataFrame, text_col: str = "text", width: int = 32) -> DataFrame:
    """The rows of ``hashed`` with ``fingerprint`` for ``fp`` and ``sha``, and ``group_id``, the least id with that fingerprint."""
    return grouped(labelled(hashed, clashes(hashed, docs, text_col, width), "fp", "sha", "fingerprint"))


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``fingerprint``) with ``group_id``."""
    groups = written(rows.groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count("*").alias("n")), "fingerprint-groups")
    return joined_by_size(rows, groups, ["fingerprint"], "n")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fingerprint`` and ``group_id`` (the least id with the same canonical text).

    Null counts as the empty text, and all empty texts form one group.  Rows
    with repeated or null ids are each grouped by their own text; a group of null
    ids only has a null ``group_id``.  An empty table gives an empty result; other
    columns are ignored.
    """
    hashed = written(digests(docs, id_col, text_col), "fingerprints")
    return resolve(hashed, docs, text_col).select(F.col("id").alias(id_col), "fingerprint", "group_id")


_EDITED = (
    "id long, n_chars long, edited_sha256 string, fp string, sha string, edited_fp string, edited_sha string, near_edited double, near_next double, "
    "part int, head string, tail string"
)


def _edit(text: str, following: str) -> tuple:
    """What ``edits`` returns of one text and the next."""
    canon = canonical(text)
    half = len(text) // 2
    new = text[: len(text) - half] + following[:half]
    changed = canonical(new)
    return (
        len(text),
        hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        digest(canon),
        second(canon),
        digest(changed),
        second(changed),
        float(canon == changed),
        float(canon == canonical(following)),
    )


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited form and the next text, in ascending id order.

    The edited form has the last half of the code points replaced by the first
    as many of the next document's; the last document is followed by the first.
    Returns ``id, n_chars, edited_sha256, fp, sha, edited_fp, edited_sha, near_edited, near_next``.
    Texts cross the network once, dealt out by ranges of ids; then only the first
    text of each range goes to the range before it.  Null counts as empty, rows
    with one id follow each other in text order, an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    ranged = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(shuffle_parts(spark), "id")
        .sortWithinPartitions("id", "text")
    )

    @tidied
    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held = head = None
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                if held is None:
                    head = text
                else:
                    rows.append((held[0], *_edit(held[1], text), part, head, None))
                    head = None
                held = (i, text)
            yield pd.DataFrame(rows, columns=columns)
        if held is not None:
            nothing = (len(held[1]), *[None] * 7)
            yield pd.DataFrame([(held[0], *nothing, part, head, held[1])], columns=columns)

    columns = [c.split()[0] for c in _EDITED.split(", ")]
    pairs = written(ranged.mapInPandas(pair, _EDITED), "fingerprint-pairs")
    inner = pairs.where("tail is null").drop("part", "head", "tail")
    # one row for each range: their number is that of the partitions, whatever the data
    ends = pairs.where("tail is not null").select("id", "part", "tail")
    heads = pairs.where("head is not null").select("part", "head")
    order = heads.select("part", F.lag("part").over(Window.orderBy("part")).alias("before")).select(
        "part", F.coalesce("before", F.max("part").over(Window.partitionBy(F.lit(0)))).alias("before")
    )
    last = ends.join(order.join(heads, "part").select(F.col("before").alias("part"), "head"), "part")

    @F.pandas_udf(", ".join(_EDITED.split(", ")[1:9]))
    def edit(tail: pd.Series, head: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_edit(a, b) for a, b in zip(tail, head, strict=True)], columns=columns[1:9])

    return inner.unionByName(last.select("id", edit("tail", "head").alias("e")).select("id", "e.*"))
