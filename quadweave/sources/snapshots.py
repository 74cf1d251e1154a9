"""Snapshots: directories of CSV (or Parquet) tables, and table lookup by name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of the known transit tables (fixed values); tables without a key can't be compared.
KEYS: dict[str, tuple[str, ...]] = {
    "agency": ("agency_id",),
    "routes": ("route_id",),
    "trips": ("trip_id",),
    "stops": ("stop_id",),
    "stop_times": ("trip_id", "stop_sequence"),
    "calendar": ("service_id",),
    "calendar_dates": ("service_id", "date"),
    "shapes": ("shape_id", "shape_pt_sequence"),
    "frequencies": ("trip_id", "start_time"),
    "feed_info": (),
}


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header; every cell is text, quotes doubled within quotes.

    A file whose cells may hold line ends is one task, whatever its size; without
    such cells ``multi_line=False`` lets Spark split it.
    """
    return spark.read.options(header=True, inferSchema=False, multiLine=multi_line, escape='"', encoding="UTF-8", nullValue="\0").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A CSV folder with headers."""
    df.write.mode(mode).options(header=True, escape='"', emptyValue="").csv(path)


def read_snapshot(spark: SparkSession, folder: str, names: Iterable[str], suffix: str = ".txt", multi_line: bool = True) -> dict[str, DataFrame]:
    """The named tables of a folder of CSV files (``multi_line`` as in ``read_csv``)."""
    return {n: read_csv(spark, f"{folder.rstrip('/')}/{n}{suffix}", multi_line) for n in sorted(names)}


def table_names(spark: SparkSession, folder: str, suffix: str = ".txt") -> list[str]:
    """Names of the tables in a folder, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return sorted(n[: -len(suffix)] for n in names if n.endswith(suffix))


def resolve(name: str, available: Iterable[str]) -> str:
    """The table that a mapping's source names: exactly, or as the only one with its stem in any case."""
    available = list(available)
    if name in available:
        return name
    stem = PurePosixPath(name).stem.lower()
    found = [a for a in available if PurePosixPath(a).stem.lower() == stem]
    if len(found) != 1:
        raise LookupError(f"{name}: {len(found)} tables fit among {sorted(available)}")
    return found[0]


def bind(sources: Iterable[str], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables by the names that a mapping uses for them."""
    return {s: tables[resolve(s, tables)] for s in sources}


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that aren't blank (reads that column only)."""
    return df.select(column).where(F.trim(F.col(column).cast("string")) != "").distinct()


def shape(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows and of columns of each table, in one job."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")) for n, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def environment(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SHA-256 and size of input files, hashed on the executors."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.lit(spark.version).alias("spark_version"))
