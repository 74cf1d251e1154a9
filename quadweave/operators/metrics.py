"""Metrics of runs: loads, spreads, paired comparisons, summaries, invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_sd(column: str, name: str | None = None) -> list[Column]:
    """Mean, and sample standard deviation that is 0 for a single value."""
    name = name or column
    return [F.avg(column).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias(f"{name}_sd")]


def spread(column: str) -> Column:
    """Largest less smallest, 0 if there is none."""
    return F.coalesce(F.max(column) - F.min(column), F.lit(0))


def partition_metrics(reports: DataFrame) -> DataFrame:
    """Per partition: total time, last finish, workers in order, retries and waits (null counts 0)."""
    zero = F.lit(0)
    return reports.groupBy("partition_id").agg(
        F.sum("mapped_ms").alias("mapped_ms"),
        F.max("finished_ms").alias("finished_ms"),
        F.array_join(F.sort_array(F.collect_set("worker")), ",").alias("workers"),
        F.sum(F.coalesce("retries", zero)).alias("retries"),
        F.sum(F.coalesce("lock_wait_ms", zero)).alias("lock_wait_ms"),
    )


def worker_loads(reports: DataFrame) -> DataFrame:
    """Total time of each worker."""
    return reports.groupBy("worker").agg(F.sum("mapped_ms").alias("load_ms"))


def paired(single: DataFrame, other: DataFrame, on: Sequence[str], seconds: str = "seconds") -> DataFrame:
    """Pairs of runs with their ratio and the reduction in per cent."""
    a = single.select(*on, F.col(seconds).alias("single_s"))
    b = other.select(*on, F.col(seconds).alias("other_s"))
    return a.join(b, list(on)).withColumn("speedup", F.col("single_s") / F.col("other_s")).withColumn(
        "reduction_pct", (F.lit(1) - F.col("other_s") / F.col("single_s")) * 100
    )


def unpaired(single: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one side has; a comparison needs there to be none."""
    a, b = single.select(*on).distinct(), other.select(*on).distinct()
    return a.join(b, list(on), "left_anti").withColumn("only_in", F.lit("single")).unionByName(
        b.join(a, list(on), "left_anti").withColumn("only_in", F.lit("other"))
    )


def summarise(runs: DataFrame, by: Sequence[str], measures: Sequence[str], steady: str | None = None) -> DataFrame:
    """Number of runs, and mean and deviation of each measure, per group; without each group's first ``steady``."""
    if steady:
        first = runs.groupBy(*by).agg(F.min(steady).alias("_first"))
        runs = runs.join(first, list(by)).where(F.col(steady) != F.col("_first"))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *[c for m in measures for c in mean_sd(m)])


def unequal_sums(a: DataFrame, b: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Groups whose sums of a column differ between two tables, or that only one has: an empty result is the invariant."""
    left = a.groupBy(*by).agg(F.sum(column).alias("sum_a"))
    right = b.groupBy(*by).agg(F.sum(column).alias("sum_b"))
    return left.join(right, list(by), "full_outer").where(~F.col("sum_a").eqNullSafe(F.col("sum_b")))


def shown(column: str, digits: int = 3) -> Column:
    """A number as text with so many digits behind the point, as reports print it; empty for null."""
    return F.when(F.col(column).isNull(), "").otherwise(F.format_string(f"%.{digits}f", F.col(column).cast("double")))


def one_value(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Groups in which a column that must be constant isn't: an empty result is the invariant."""
    return df.groupBy(*by).agg(F.countDistinct(column).alias("distinct_values")).where("distinct_values <> 1")
