"""Sharding by vector bin packing.

Bytes, words and rows are balanced jointly.  Items are groups of equal texts: each
goes where the dot product of its loads with the shards' residual capacity is
highest, heaviest first.  The heaviest groups, whose number has a bound, are packed
first, on the driver; the others are dealt at random to packing tasks, each of which
packs its groups into its share of what capacity is left.  Only a group that
outweighs half a shard is split, as it can't be balanced whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Bytes that each document costs beside its text.
ROW_OVERHEAD = 16
#: Share of a shard that a group may weigh whole; pieces of heavier ones weigh so much of a shard.
WHOLE, PIECE = 0.5, 0.125
#: Groups of a packing task, about, and packing tasks at most (beyond that, tasks have more groups).
TASK_GROUPS, MOST_TASKS = 100_000, 1000
#: Parts of a shard's share in one task: a group heavier than one of them is packed on the driver.
PARTS = 8
#: Hash buckets in which a shard's rows are numbered.
SLOT_BUCKETS = 512
_LOADS = ["b", "w", "r"]


def pack(items: np.ndarray, shards: int, residual: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item; ``items`` has one row of loads per item.

    Items go from the heaviest down, loads being divided by ``scale``: without it, by
    equal shares of every column's total.  An item goes where the dot product of
    its loads with the ``residual`` capacity (1 everywhere at first; changed in
    place) is highest, ties to the lowest shard number.  A zero column has no say.
    """
    if scale is None:
        scale = items.sum(axis=0) / shards
    share = np.divide(items, scale, out=np.zeros_like(items, dtype=float), where=scale > 0)
    if residual is None:
        residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-share.max(axis=1, initial=0), kind="stable"):
        out[i] = best = int(np.argmax(residual @ share[i]))
        residual[best] -= share[i]
    return out


def _packer(shards: int, residual: np.ndarray, scale: np.ndarray, light: np.ndarray):  # noqa: ANN202
    """A task's packing: of the light groups' whole load it holds a share, and gets as much of the residual capacity."""

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["h", "crc"], ignore_index=True)
        items = groups[_LOADS].to_numpy(float)
        part = np.divide(items.sum(axis=0), light, out=np.zeros(3), where=light > 0)
        out = groups[["h", "crc"]].copy()
        out["shard"] = pack(items, shards, residual * part, scale)
        return out

    return run


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", task_groups: int = TASK_GROUPS) -> DataFrame:
    """One row per input row: id, ``size``, ``n_words``, ``text_crc32``, ``shard``, ``slot``.

    Equal texts share a shard unless their group outweighs WHOLE of a shard's share
    of bytes, words or rows; then it is split by id into pieces of about PIECE of a
    share.  Slots run from 0 without gaps within each shard.  A null text counts as
    empty (size 16), null ids as one id.  Which of several identical rows has which
    slot is arbitrary.  An empty table gives an empty result.  Other columns of the
    input are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("words"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("h"),
        ),
        "sharding-rows",
    )
    groups = written(slim.groupBy("h", "crc").agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count("*").alias("r")), "sharding-groups")
    total = groups.agg(*[F.sum(c) for c in _LOADS], F.count("*")).first()
    scale = np.array([x or 0 for x in total[:3]], float) / shards
    load = F.greatest(*[F.col(c) / (x or 1.0) for c, x in zip(_LOADS, scale.tolist(), strict=True)])
    tasks = min(MOST_TASKS, max(1, -(-total[3] // task_groups)))
    # fewer than 3 * shards / WHOLE groups weigh so much
    split = F.broadcast(
        groups.where((load > WHOLE) & (F.col("r") > 1)).select("h", "crc", F.least(F.ceil(load / PIECE), F.col("r")).cast("int").alias("pieces"))
    )
    # rows of one id and text, the null id's too, make one piece; 0 stands for a whole group
    piece = F.when(F.col("pieces").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("id"), F.col("pieces")) + 1)
    pieces = slim.join(split, ["h", "crc"]).withColumn("piece", piece).groupBy("h", "crc", "piece").agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count("*").alias("r"))
    # fewer than 3 * shards * tasks * PARTS groups weigh so much, under a million
    least = 1 / (tasks * PARTS)
    whole = groups.join(split, ["h", "crc"], "left_anti").withColumn("piece", F.lit(0).cast("long"))
    heavy = whole.where(load > least).unionByName(pieces).orderBy("h", "crc", "piece").collect()
    items = np.array([[x.b, x.w, x.r] for x in heavy], float).reshape(-1, 3)
    residual = np.ones((shards, 3))
    where = pack(items, shards, residual, scale)
    heavy_places = F.broadcast(spark.createDataFrame([(x.h, x.crc, x.piece, int(s)) for x, s in zip(heavy, where, strict=True)], "h long, crc long, piece long, shard int"))
    light = np.array([x or 0 for x in total[:3]], float) - items.sum(axis=0)
    dealt = whole.where(load <= least).groupBy(F.pmod("h", F.lit(tasks)).alias("task"))
    light_places = written(dealt.applyInPandas(_packer(shards, residual, scale, light), "h long, crc long, shard int"), "sharding-places")

    marked = slim.join(split, ["h", "crc"], "left").withColumn("piece", piece).join(heavy_places, ["h", "crc", "piece"], "left")
    columns = ["id", "size", "words", "crc", "h"]
    both = marked.where("shard is not null").select(*columns, "shard").unionByName(marked.where("shard is null").select(*columns).join(light_places, ["h", "crc"]))
    bucket = F.pmod(F.xxhash64("id", "h"), F.lit(SLOT_BUCKETS)).cast("int")
    placed = written(both.select(*columns, "shard", bucket.alias("bucket")), "sharding-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards * SLOT_BUCKETS rows
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "h")) - 1
    return placed.join(F.broadcast(first), ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("words").alias("n_words"),
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("first") + rank).cast("long").alias("slot"),
    )
