"""Triples maps to DataFrames of quads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import render, text_of
from .ir import Constant, Join, Mapping, Reference, Template, TriplesMap

#: Columns of a quad: subject, predicate, object, its kind (iri or literal) and datatype.
QUAD = ["s", "p", "o", "o_kind", "o_datatype"]


def subject(m: TriplesMap, df: DataFrame, alias: str | None = None) -> Column:
    """A row's subject IRI; null if a variable is blank."""
    return render(m.subject.text, {v: F.col(f"{alias}.`{v}`" if alias else f"`{v}`") for v in m.subject.variables})


def _object(term: Constant | Reference | Template) -> Column:
    """The struct (o, o_kind, o_datatype) of a term over the row's own columns."""
    nothing = F.lit(None).cast("string")
    if isinstance(term, Constant):
        value, kind, datatype = F.lit(term.value), term.kind, nothing
    elif isinstance(term, Reference):
        value, kind, datatype = text_of(F.col(f"`{term.column}`")), term.kind, F.lit(term.datatype).cast("string")
    else:
        value, kind, datatype = render(term.text, {v: F.col(f"`{v}`") for v in term.variables}, term.kind == "iri"), term.kind, nothing
    return F.struct(value.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("o_datatype"))


def _columns(term: Constant | Reference | Template) -> list[str]:
    """Columns that a term reads."""
    return [] if isinstance(term, Constant) else [term.column] if isinstance(term, Reference) else list(term.variables)


def own_terms(m: TriplesMap) -> list[Column]:
    """The structs (p, t) of all terms over a row's own columns."""
    return [F.struct(F.lit(po.predicate).alias("p"), _object(t).alias("t")) for po in m.properties for t in po.objects if not isinstance(t, Join)]


def own_columns(m: TriplesMap) -> list[str]:
    """The columns that these terms read."""
    return sorted({c for po in m.properties for t in po.objects if not isinstance(t, Join) for c in _columns(t)})


def _joined(m: TriplesMap, predicate: str, join: Join, mapping: Mapping, tables: dict[str, DataFrame]) -> DataFrame:
    """Quads of one object map that reads another map's rows."""
    parent = mapping.one(join.parent)
    if not join.on:  # the parent's subject of the same row
        same = tables[m.source].select(subject(m, tables[m.source]).alias("s"), subject(parent, tables[m.source]).alias("o"))
        return _links(same, predicate)
    keys = [f"key {i}" for i in range(len(join.on))]
    child = tables[m.source].select(
        subject(m, tables[m.source]).alias("s"),
        *([render(join.template.text, {v: F.col(f"`{v}`") for v in join.template.variables}).alias("o")] if join.template else []),
        *[text_of(F.col(f"`{c}`")).alias(k) for k, (c, _) in zip(keys, join.on, strict=True)],
    )
    right = tables[parent.source].select(
        *([] if join.template else [subject(parent, tables[parent.source]).alias("o")]),
        *[text_of(F.col(f"`{p}`")).alias(k) for k, (_, p) in zip(keys, join.on, strict=True)],
    ).distinct()
    return _links(child.join(right, keys, "left_semi" if join.template else "inner"), predicate)


def _links(pairs: DataFrame, predicate: str) -> DataFrame:
    """Quads of subject and object IRIs."""
    return pairs.where("s is not null and o is not null").select(
        "s", F.lit(predicate).alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")
    )


def by_subject(rows: DataFrame, s: str = "s") -> DataFrame:
    """The rows dealt out by a subject column.

    Quads made of them stay where they are, so those of one subject are compared
    without being shuffled.  The number of partitions is the session's for all, so that
    unions and joins of what is dealt out so need no further shuffle.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), s)


def compile_map(m: TriplesMap, mapping: Mapping, tables: dict[str, DataFrame], dealt: bool = False) -> list[DataFrame]:
    """The quads of one triples map, not yet distinct.

    All terms over a row's own columns come from one scan; every join adds one.
    With ``dealt`` the quads of own columns are dealt out by subject, as rows.
    """
    own = own_terms(m)
    out = [_joined(m, predicate, join, mapping, tables) for predicate, join in m.joins()]
    if own:
        rows = tables[m.source]
        if dealt:
            s = "subject of row"
            rows = by_subject(rows.select(subject(m, rows).alias(s), *[F.col(f"`{c}`") for c in own_columns(m)]).where(F.col(s).isNotNull()), s)
            rows = rows.select(F.col(s).alias("s"), F.explode(F.array(*own)).alias("q"))
        else:
            rows = rows.select(subject(m, rows).alias("s"), F.explode(F.array(*own)).alias("q"))
        out.insert(
            0,
            rows.select("s", "q.p", "q.t.o", "q.t.o_kind", "q.t.o_datatype").where("s is not null and o is not null"),
        )
    return out


def compile_mapping(mapping: Mapping, tables: dict[str, DataFrame]) -> DataFrame:
    """The graph of a mapping over its tables: a set of quads.

    A blank or null value makes no term, hence no quad; a blank join value
    meets nothing.  Maps with one subject template share their subjects.
    """
    maps = [m for m in mapping.maps.values() if m.properties]
    # one map without joins makes the whole graph: its rows are shuffled, which are fewer and narrower than quads
    alone = len(maps) == 1 and not any(maps[0].joins())
    parts = [df for m in maps for df in compile_map(m, mapping, tables, alone)]
    if not parts:
        raise ValueError("the mapping has no properties")
    return reduce(DataFrame.unionByName, parts).distinct()
