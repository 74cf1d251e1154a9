"""Versioned commits as set operations: compare and set per key, retries, duplicate reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written


def first_report(reports: DataFrame, task: str, arrival: Sequence[Column]) -> DataFrame:
    """The first report of each task; later ones are repeats."""
    rank = F.row_number().over(Window.partitionBy(task).orderBy(*arrival))
    return reports.withColumn("_n", rank).where("_n = 1").drop("_n")


def compare_and_set(versions: DataFrame, requests: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One round of optimistic commits.

    ``versions(key, version)`` are current; ``requests(task, key, expected)``
    hold the versions that tasks have read.  A task commits if all its keys are
    as read and no task before it in ``order`` wants one of them.  Returns the new
    versions, and the tasks with ``committed``.  Keys without a version are at 0.
    """
    current = requests.join(versions, "key", "left").withColumn("fresh", F.coalesce("version", F.lit(0)) == F.col("expected"))
    turn = F.dense_rank().over(Window.partitionBy("key").orderBy(*order))
    judged = current.withColumn("ok", F.col("fresh") & (turn == 1))
    outcome = judged.groupBy("task").agg(F.min(F.col("ok").cast("int")).alias("ok")).select("task", (F.col("ok") == 1).alias("committed"))
    bumped = judged.join(outcome.where("committed"), "task").groupBy("key").agg((F.max("expected") + 1).alias("bumped"))
    new = versions.join(bumped, "key", "full_outer").select("key", F.coalesce("bumped", "version").alias("version"))
    return new, outcome


def commit_all(versions: DataFrame, requests: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rounds of ``compare_and_set`` until every task has committed; losers read anew.

    Returns the versions and ``task, attempts``.  The rounds aren't run one by one.
    A task commits in the first round in which it is the foremost on all its keys, and
    not in the first one if it read an old version.  So a key's tasks commit in rounds
    that rise along its order, and a task's round is the highest that any of its keys
    asks for.  Each pass carries rounds along whole keys, however many tasks want
    them; passes end when no task has to wait longer, after as many as a chain of
    conflicts changes keys.
    """
    current = requests.join(versions, "key", "left").withColumn("stale", F.coalesce("version", F.lit(0)) != F.col("expected"))
    wanted = current.groupBy("task", "key", *[c for c in order if c != "task"]).agg(F.max("stale").alias("stale"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy(*order, *([] if "task" in order else ["task"])))
    wanted = written(wanted.withColumn("turn", turn), "commit-requests")
    rounds = written(wanted.groupBy("task").agg((F.lit(1) + F.max(F.col("stale").cast("int"))).cast("long").alias("attempts")), "commit-rounds")
    along = Window.partitionBy("key").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        asked = wanted.join(rounds, "task").withColumn("least", F.col("turn") + F.max(F.col("attempts") - F.col("turn")).over(along))
        later = written(asked.groupBy("task").agg(F.max("least").cast("long").alias("attempts"), F.max(F.col("least") > F.col("attempts")).alias("moved")), "commit-rounds")
        rounds = later.select("task", "attempts")
        if later.where("moved").isEmpty():
            break
    bumps = wanted.groupBy("key").agg(F.count("*").alias("bumps"))
    final = versions.join(bumps, "key", "full_outer").select("key", (F.coalesce("version", F.lit(0)) + F.coalesce("bumps", F.lit(0))).alias("version"))
    return final, rounds


def commit_in_order(requests: DataFrame) -> DataFrame:
    """Version that each (key, task) writes if tasks commit one after another: its turn among the key's tasks."""
    return requests.withColumn("version", F.row_number().over(Window.partitionBy("key").orderBy("task")))


def matched(reports: DataFrame, specs: DataFrame, task: str = "task") -> DataFrame:
    """Reports with their task's specification; an error if a report names an unknown task."""
    unknown = reports.join(specs, task, "left_anti").select(task).limit(3).collect()
    if unknown:
        raise LookupError(f"reports of unknown tasks: {[r[0] for r in unknown]}")
    return reports.join(specs, task)


def save_versions(versions: DataFrame, path: str, keep: bool = False) -> None:
    """Write versions; ``keep`` adds to those of earlier runs, of which the highest counts."""
    versions.write.mode("append" if keep else "overwrite").parquet(path)


def load_versions(spark: SparkSession, path: str) -> DataFrame:
    """The highest version of each key."""
    return spark.read.parquet(path).groupBy("key").agg(F.max("version").alias("version"))
