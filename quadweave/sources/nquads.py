"""N-Quads files and lists of IRIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import nquad

_LINE = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@[A-Za-z0-9-]+)?)(?: <[^>]*>)? \.$'


def lines(graph: DataFrame) -> DataFrame:
    """One ``value`` per quad: its N-Quads line."""
    return graph.select(nquad(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_datatype")]).alias("value"))


def write(graph: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The graph as text files of N-Quads."""
    lines(graph).write.mode(mode).text(path)


def subject_of(line: Column) -> Column:
    """The subject of a line: what stands before the first blank, brackets included."""
    return F.substring_index(line, " ", 1)


def _unescape(text: Column) -> Column:
    hold = "\u0001"  # stands for an escaped backslash meanwhile
    out = F.replace(text, F.lit("\\\\"), F.lit(hold))
    for escaped, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(out, F.lit(hold), F.lit("\\"))


def parse_lines(text: DataFrame) -> DataFrame:
    """Quads of lines in column ``value``; blank lines are left out, others that don't parse have a null subject."""
    part = [F.regexp_extract("value", _LINE, i) for i in range(1, 6)]
    iri = F.col("value").rlike(r"^<[^>]*> <[^>]*> <")
    return text.where(F.trim("value") != "").select(
        F.nullif(part[0], F.lit("")).alias("s"),
        F.nullif(part[1], F.lit("")).alias("p"),
        F.when(iri, part[2]).otherwise(_unescape(part[3])).alias("o"),
        F.when(iri, "iri").otherwise("literal").alias("o_kind"),
        F.nullif(part[4], F.lit("")).alias("o_datatype"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The quads of N-Quads files."""
    return parse_lines(spark.read.text(path))


def write_iris(subjects: DataFrame, path: str, append: bool = False) -> None:
    """Subjects ``s`` as one ``<iri>`` per line; ``append`` adds another entity type's."""
    subjects.select(F.concat(F.lit("<"), "s", F.lit(">")).alias("value")).write.mode("append" if append else "overwrite").text(path)


def read_iris(spark: SparkSession, path: str) -> DataFrame:
    """Distinct subjects ``s`` of such files."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace(F.trim("value"), "^<|>$", "").alias("s")).distinct()


def empty_iris(spark: SparkSession) -> DataFrame:
    """No subjects: what there is to forget where no row is stale."""
    return spark.createDataFrame([], "s string")
