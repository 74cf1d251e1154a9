"""Session helpers: batches, draws, joins by size, input columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written as written  # noqa: PLC0414


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor)).cast("int")


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Return freed memory of this Python worker to the system.

    Workers live on between stages, and an idle one would keep what its
    allocators hold.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """A function over an iterator of batches that releases memory at its end."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def draw(rows: DataFrame, group: str, k: int, order: list[str], groups: int = 500) -> DataFrame:
    """At most ``k`` rows of each of the ``groups`` largest groups, lowest ``h`` (a hash column) first.

    A rate from the groups' counts thins the rows out before they are sent, so
    that ranking sees little more than the rows it keeps, whatever the input.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), group).limit(groups)
    rate = F.lit(k + 6 * k**0.5 + 10) / F.col("_n") * (1 << 30)
    few = rows.join(F.broadcast(counts), group).where(F.pmod("h", F.lit(1 << 30)) < rate)
    lowest = Window.partitionBy(group).orderBy(F.pmod("h", F.lit(1 << 30)), *order)
    return few.withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= k).drop("_n")


def joined_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of their group, inner.

    ``groups`` has one row per ``keys`` and its number of rows (``size``).  Groups of
    a ``share``-th of all rows or more, of which there are at most ``share``, are sent
    to all executors, so that no hot key's rows meet in one task.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * share >= total
    mark = "group is large"
    marked = rows.join(F.broadcast(groups.where(large).withColumn(mark, F.lit(True))), keys, "left")
    more = [c for c in groups.columns if c not in (*keys, size)]
    small = marked.where(F.col(mark).isNull()).select(*rows.columns).join(groups.where(~large), keys)
    columns = [*rows.columns, *more]
    return marked.where(F.col(mark)).select(*columns).unionByName(small.select(*columns))


#: Rows and bytes of a batch that a Python worker gets at once, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
_SHIPPED: set[str] = set()


def _bytes(setting: str) -> int:
    """A size setting's number, whatever its unit."""
    number = setting.rstrip("bBkKmMgG")
    unit = setting[len(number) :].lower().rstrip("b")
    return int(number) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit]


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Batches of up to so many rows and bytes for what is run inside the block."""
    new = dict(zip(BATCH, (rows, size), strict=True))
    old = {key: spark.conf.get(key, None) for key in new}
    for key, value in new.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in old.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Make a session ready for this package's Python workers.

    Batches sent to them are bounded (smaller settings stay), and the package
    itself is sent once per application by Spark's file server, for executors
    on which it isn't installed.
    """
    for key, most in BATCH.items():
        if spark.conf.get(key, None) is None or _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    handle, target = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
