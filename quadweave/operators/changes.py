"""Deterministic change feeds: quotas, choice of rows by hash, changed snapshots and logs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import fresh_key, md5_mod, row_key, shift_time
from .diff import check_columns

#: Buckets of the distributed ranking: their offsets are one small table.
BUCKETS = 1 << 16
SKEW_BUCKETS = 1 << 12
#: Seconds by which the kinds of change move times, the seed added.
UPDATE_SHIFT, COMPOSITE_SHIFT, INSERT_SHIFT, INSERT_STEP = 60, 120, 3600, 60


@dataclass(frozen=True)
class Quotas:
    """Numbers of rows to insert, delete, update in one column, update in all."""

    insert: int
    delete: int
    update: int
    composite: int

    @property
    def mapped(self) -> int:
        """Rows that the changes make for the mapping."""
        return self.insert + self.update + self.composite


def plan(rows: int, ratio: float) -> Quotas:
    """Four near equal shares of the changes, at least one change; the remainder goes to composites."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be above 0 and at most 1")
    total = max(1, round(rows * ratio))
    share = total // 4
    out = Quotas(share, share, share, total - 3 * share)
    if out.delete + out.update + out.composite > rows:
        raise ValueError("too few rows for changes that don't overlap")
    return out


def apportion(counts: Mapping[str, int], total: int) -> dict[str, int]:
    """``total`` dealt out in proportion to the counts, by largest remainders, ties by name."""
    everything = sum(counts.values())
    if not everything:
        return dict.fromkeys(counts, 0)
    exact = {k: (n * total) // everything for k, n in counts.items()}
    rest = {k: (n * total) % everything for k, n in counts.items()}
    for k in sorted(counts, key=lambda k: (-rest[k], k))[: total - sum(exact.values())]:
        exact[k] += 1
    return exact


def apportion_frame(counts: DataFrame, name: str, count: str, total: int) -> DataFrame:
    """``apportion`` for a table of names and counts, as ``quota``."""
    everything = F.sum(count).over(Window.partitionBy(F.lit(0)))
    share = F.col(count).cast("long") * total
    dealt = counts.withColumn("_all", everything).withColumn("_q", F.floor(share / F.col("_all")).cast("long")).withColumn("_r", share % F.col("_all"))
    left = F.lit(total) - F.sum("_q").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_r"), name))
    return dealt.withColumn("quota", F.col("_q") + F.when(rank <= left, 1).otherwise(0)).drop("_all", "_q", "_r")


def shuffled(
    df: DataFrame, key: Column, seed: int, tie: Sequence[Column] = (), within: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """The rows with ``rank``, from 0 (in each group ``within``), in the order of a seeded hash of the key.

    Ranks are exact without one global sort: rows are ranked within buckets of
    the hash, and each bucket's offset comes from the counts of those before it.
    ``buckets`` is a power of 16; there are at most that many offsets per group.
    """
    digits = (buckets - 1).bit_length() // 4
    group = [F.col(c) for c in within]
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))).withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", *tie)) - 1
    ranked = hashed.withColumn("_r", inside).join(F.broadcast(offsets), [*within, "_b"])
    return ranked.withColumn("rank", F.col("_at") + F.col("_r")).drop("_h", "_b", "_r", "_at")


@dataclass(frozen=True)
class Feed:
    """What a change feed needs to know of its table."""

    keys: Sequence[str]
    times: Sequence[str]
    fresh: str
    ratio: float = 0.1
    seed: int = 1


def _marked(base: DataFrame, feed: Feed, quotas: Quotas) -> DataFrame:
    """The rows with ``rank`` and ``op`` (null: unchanged)."""
    ranked = shuffled(base, row_key([F.col(k) for k in feed.keys]), feed.seed, [F.col(k) for k in feed.keys])
    r, d, u = F.col("rank"), quotas.delete, quotas.update
    op = F.when(r < d, "delete").when(r < d + u, "update").when(r < d + u + quotas.composite, "composite")
    return ranked.withColumn("op", op)


def _moved(df: DataFrame, feed: Feed) -> DataFrame:
    """Times moved as ``op`` says; what is no time stays."""
    out = df
    for i, c in enumerate(feed.times):
        by = F.when(F.col("op") == "composite", COMPOSITE_SHIFT + feed.seed)
        if i == 0:
            by = by.when(F.col("op") == "update", UPDATE_SHIFT + feed.seed)
        out = out.withColumn(c, F.coalesce(shift_time(F.col(c), by), F.col(c)))
    return out


def _inserted(marked: DataFrame, feed: Feed, first: int, n: int, rows: int, highest: int) -> DataFrame:
    """New rows number ``first`` onward, ``n`` of them: copies of rows drawn by ``rank`` with repetition, with fresh keys and later times."""
    spark = marked.sparkSession
    drawn = spark.range(first, first + n).select(
        F.col("id").alias("j"),
        F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{feed.seed}+"), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(rows)).alias("rank"),
    )
    out = marked.join(drawn, "rank").withColumn("op", F.lit("insert"))
    for c in feed.times:
        later = F.lit(INSERT_SHIFT + feed.seed) + INSERT_STEP * F.col("j")
        out = out.withColumn(c, F.coalesce(shift_time(F.col(c), later), F.col(c)))
    return out.withColumn(feed.fresh, (F.lit(highest + 1) + F.col("j")).cast(marked.schema[feed.fresh].dataType))


@dataclass(frozen=True)
class Skew:
    """A share ``p`` of the mapped changes is to come from partition 0 of ``k`` by the hash of ``column``."""

    column: str
    k: int
    p: float


def generate(base: DataFrame, feed: Feed, skew: Skew | None = None) -> tuple[DataFrame, DataFrame]:
    """The changed snapshot, and the log ``op, old_key, new_key, changed_fields``.

    Rows are chosen by a seeded hash of their key, so the same feed on the same
    table is the same anywhere.  The base isn't touched.  Fresh keys lie above
    the highest value of the (numeric) column ``fresh``.  With a skew, updates,
    composites and the templates of inserts are drawn from partition 0 as far
    as their quotas say, and deletes from the rows that are left.
    """
    check_columns(base, [*feed.keys, *feed.times, feed.fresh])
    rows, highest = base.agg(F.count("*"), F.max(F.col(feed.fresh).cast("long"))).first()
    if not rows:
        raise ValueError("no rows to change")
    quotas = plan(rows, feed.ratio)
    if skew is None:
        marked = _marked(base, feed, quotas)
        inserted = _inserted(marked, feed, 0, quotas.insert, rows, highest)
    else:
        marked, home = _marked_skewed(base, feed, quotas, skew)
        forced = skewed_quotas(quotas, skew.p)[1]["insert"]
        here = marked.where("home = 1").withColumn("rank", F.col("home_rank"))
        inserted = _inserted(here, feed, 0, forced, max(home, 1), highest).unionByName(
            _inserted(marked, feed, forced, quotas.insert - forced, rows, highest)
        )
    columns = base.columns
    after = _moved(marked.where("op is null or op <> 'delete'"), feed).select(*columns).unionByName(inserted.select(*columns))
    key = row_key([F.col(k) for k in feed.keys])
    valid = {c: shift_time(F.col(c), 0).isNotNull() for c in feed.times}
    composite = F.array_join(F.array_compact(F.array(*[F.when(valid[c], c) for c in feed.times])), ",")
    changed = (
        F.when((F.col("op") == "update") & valid[feed.times[0]], feed.times[0]).when(F.col("op") == "composite", composite).otherwise("")
    )
    nothing = F.lit("")
    log = marked.where("op is not null").select(
        "op", key.alias("old_key"), F.when(F.col("op") == "delete", nothing).otherwise(key).alias("new_key"), changed.alias("changed_fields")
    )
    return after, log.unionByName(inserted.select("op", nothing.alias("old_key"), key.alias("new_key"), F.lit("*").alias("changed_fields")))


def skewed_quotas(mapped: Quotas, p: float) -> tuple[int, dict[str, int]]:
    """Changes to draw from partition 0 for a skew ``p``, and their split over the kinds."""
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    forced = math.floor(mapped.mapped * p + 0.5)
    return forced, apportion({"insert": mapped.insert, "update": mapped.update, "composite": mapped.composite}, forced)


def _marked_skewed(base: DataFrame, feed: Feed, quotas: Quotas, skew: Skew) -> tuple[DataFrame, int]:
    """The rows with ``rank``, ``home``, ``home_rank`` and ``op``; and the number of home rows.

    In hash order, home rows with a time to move are updated, then made
    composites, until the forced quotas are met; the same of all other rows that
    have one for the rest; deletes are the first of those without an operation.
    """
    key, tie = row_key([F.col(c) for c in feed.keys]), [F.col(c) for c in feed.keys]
    forced = skewed_quotas(quotas, skew.p)[1]
    able = (shift_time(F.col(feed.times[0]), 0).isNotNull()).cast("int")
    rows = base.withColumn("home", (md5_mod(F.col(skew.column), skew.k) == 0).cast("int")).withColumn("able", able)
    counts = {(r.home, r.able): r["n"] for r in rows.groupBy("home", "able").agg(F.count("*").alias("n")).collect()}
    u, c = forced["update"], forced["composite"]
    u_rest, c_rest = quotas.update - u, quotas.composite - c
    if counts.get((1, 1), 0) < u + c or counts.get((0, 1), 0) < u_rest + c_rest:
        raise ValueError("too few rows with a time to move for this skew")
    home = counts.get((1, 0), 0) + counts.get((1, 1), 0)
    if forced["insert"] and not home:
        raise ValueError("partition 0 has no row to copy")
    ranked = shuffled(rows, key, feed.seed, tie, ["home", "able"], SKEW_BUCKETS).withColumnRenamed("rank", "group_rank")
    ranked = shuffled(ranked, key, feed.seed, tie, ["home"], SKEW_BUCKETS).withColumnRenamed("rank", "home_rank")
    r = F.col("group_rank")
    first = F.when(F.col("home") == 1, u).otherwise(u_rest)
    last = F.when(F.col("home") == 1, u + c).otherwise(u_rest + c_rest)
    moved = F.when(F.col("able") == 1, F.when(r < first, "update").when(r < last, "composite"))
    ranked = shuffled(ranked.withColumn("op", moved).withColumn("free", F.col("op").isNull()), key, feed.seed, tie, ["free"], SKEW_BUCKETS)
    ranked = ranked.withColumn("op", F.when(F.col("free") & (F.col("rank") < quotas.delete), "delete").otherwise(F.col("op")))
    return shuffled(ranked.drop("rank", "free", "group_rank", "able"), key, feed.seed, tie), home
