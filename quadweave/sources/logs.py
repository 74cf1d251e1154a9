"""Run logs: ``key: value`` lines, timings, JSON sidecars and metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of a run's task metrics, a JSON array in its log.
TASK_METRICS = "array<struct<id:string,partition_id:int,subpartition_id:int,rows:bigint,mapped_ms:bigint,mapped_finished_at_ms:bigint,worker:string>>"
SKEW_FIELDS = ("partition_hash", "partition_k", "partition_skew_p", "delta_rows")


def pairs(text: DataFrame) -> DataFrame:
    """``key`` and ``value`` of each line with a colon; the first one parts them."""
    part = F.split("value", ":", 2)
    return text.where(F.col("value").contains(":")).select(F.trim(part[0]).alias("key"), F.trim(part[1]).alias("value"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, value`` of all logs under a path."""
    part = F.split("value", ":", 2)
    return spark.read.text(path).where(F.col("value").contains(":")).select(
        F.col("_metadata.file_name").alias("file"), F.trim(part[0]).alias("key"), F.trim(part[1]).alias("value")
    )


def timings(text: Column) -> tuple[Column, Column]:
    """Elapsed text and peak kilobytes of a whole ``time -v`` report."""
    elapsed = F.regexp_extract(text, r"Elapsed \(wall clock\) time[^\n]*: ([0-9:.]+)", 1)
    return elapsed, F.regexp_extract(text, r"Maximum resident set size \(kbytes\): ([0-9]+)", 1).cast("long")


def task_metrics(logs: DataFrame, column: str) -> DataFrame:
    """One row per task of JSON metrics in a column."""
    return logs.select("*", F.explode(F.from_json(column, TASK_METRICS)).alias("task")).select(*[c for c in logs.columns if c != column], "task.*")


def read_json_sidecar(spark: SparkSession, path: str) -> dict:
    """A JSON object of a few fields, checked for those that a skew run needs."""
    found = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    missing = [f for f in SKEW_FIELDS if f not in found]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return found


def write_run_log(spark: SparkSession, metrics: dict[str, object], path: str) -> None:
    """A run's metrics as ``key: value`` lines in one file."""
    rows = [(f"{k}: {json.dumps(v) if isinstance(v, list | dict) else v}",) for k, v in metrics.items()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def first_value(lines: DataFrame, key: str) -> Column:
    """Aggregate: the value of the first line (by ``position``) with a key; null if there is none."""
    return F.min_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("position")))


def read_scalar(spark: SparkSession, path: str) -> int | None:
    """The number in a small text file, or None where there is no such file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return int(rows[0].value.split()[0]) if rows else None


def write_manifest(spark: SparkSession, fields: dict, path: str) -> None:
    """A JSON object in one file."""
    spark.createDataFrame([(json.dumps(fields),)], "value string").coalesce(1).write.mode("overwrite").text(path)
