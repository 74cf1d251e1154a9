"""Keyed snapshot comparison: what was inserted, deleted, updated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INSERTED, DELETED, UPDATED = "inserted", "deleted", "updated"


def check_columns(df: DataFrame, wanted: Sequence[str], what: str = "table") -> None:
    """An error that names the columns that a table lacks."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"{what} lacks the columns {missing}")


def _keys(names: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(names)]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and their number of rows ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys with several rows (``groups``), the rows that have them (``rows``), and those that lose (``lost``)."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return duplicate_keys(df, keys).agg(F.count("*").alias("groups"), n.alias("rows"), (n - F.count("*")).alias("lost"))


def one_row_per_key(df: DataFrame, keys: Sequence[str], position: Sequence[str] = ()) -> DataFrame:
    """The last row of each key by ``position``; rows at one place, or without a position, go by their values, so that the choice is the same every time."""
    values = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    order = Window.partitionBy(*_keys(keys)).orderBy(*[F.col(f"`{c}`").desc() for c in position], values.desc())
    return df.withColumn("_last", F.row_number().over(order)).where("_last = 1").drop("_last")


def last_wins(df: DataFrame, keys: Sequence[str], position: Sequence[Column]) -> DataFrame:
    """One row per key: the last by ``position``."""
    order = Window.partitionBy(*keys).orderBy(*[c.desc() for c in position])
    return df.withColumn("_last", F.row_number().over(order)).where("_last = 1").drop("_last")


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], position: Sequence[str] | None = None) -> DataFrame:
    """``change`` with the ``old`` and ``new`` row, for every key that changed.

    One full outer join on the keys (null counts as empty); rows are compared
    over the columns of ``after`` with nulls equal.  Keys must be unique, unless
    ``position`` is given: then the last row of each key by these columns counts (see
    ``one_row_per_key``; it may be empty), and the columns themselves aren't compared.
    """
    check_columns(before, keys, "before")
    check_columns(after, keys, "after")
    if position is not None:
        before, after = (one_row_per_key(df, keys, position).drop(*position) for df in (before, after))
    columns = [f"`{c}`" for c in after.columns]
    names = [f"_k{i}" for i in range(len(keys))]
    old = before.select(*_keys(keys), F.struct(*columns).alias("old"))
    new = after.select(*_keys(keys), F.struct(*columns).alias("new"))
    change = (
        F.when(F.col("old").isNull(), INSERTED)
        .when(F.col("new").isNull(), DELETED)
        .when(~F.col("old").eqNullSafe(F.col("new")), UPDATED)
    )
    return old.join(new, names, "full_outer").select(change.alias("change"), "old", "new").where("change is not null")


def delta_rows(changes: DataFrame) -> DataFrame:
    """New rows to map: inserted, and updated in their new form."""
    return changes.where(F.col("change").isin(INSERTED, UPDATED)).select("new.*")


def stale_rows(changes: DataFrame) -> DataFrame:
    """Old rows to forget: deleted, and updated in their old form."""
    return changes.where(F.col("change").isin(DELETED, UPDATED)).select("old.*")


def summary(changes: DataFrame) -> DataFrame:
    """Number of changes of each kind."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def totals(changes: dict[str, DataFrame]) -> DataFrame:
    """Rows to map (``delta_rows``) and to forget (``stale_rows``) of each table, and of all (``table_name`` null)."""
    parts = [
        df.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "change", "n") for name, df in sorted(changes.items())
    ]
    every = reduce(DataFrame.unionByName, parts)
    # a table without changes has a row, too
    names = reduce(DataFrame.unionByName, [every.sparkSession.range(1).select(F.lit(name).alias("table_name"), F.lit("none").alias("change"), F.lit(0).cast("long").alias("n")) for name in sorted(changes)])

    def count(*kinds: str) -> Column:
        return F.sum(F.when(F.col("change").isin(*kinds), F.col("n")).otherwise(0))

    return every.unionByName(names).rollup("table_name").agg(count(INSERTED, UPDATED).alias("delta_rows"), count(DELETED, UPDATED).alias("stale_rows"))


def diff_snapshots(
    before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, Sequence[str]], positions: dict[str, Sequence[str]] | None = None
) -> dict[str, DataFrame]:
    """Changes of every table with a key; a table on one side only is compared with an empty one.

    Tables without a key are left out, as there is no telling what changed.  Of
    rows that share a key the last counts, by the table's ``positions``.
    """
    out = {}
    for name in sorted(before.keys() | after.keys()):
        if not keys.get(name):
            continue
        some = after.get(name, before.get(name))
        out[name] = diff(before.get(name, some.limit(0)), after.get(name, some.limit(0)), keys[name], (positions or {}).get(name, ()))
    return out
