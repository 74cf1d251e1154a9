"""Join elimination on the mapping.

E1 (many rows to one): the parent's subject reads only the parent's join
columns, so it can be written from the child's.  That is exact where every child
value has a parent row; otherwise a semi-join on the parent's keys stays.
E2 (one source, many rows to one): child and parent are rows of one source,
joined on one column that alone makes the child's subject; the parent's subject
of the child's own row then yields the same set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import rename_variables, text_of
from .ir import Join, Mapping, PredicateObjects, Template, TriplesMap

#: Pairs of rows from which a join that stays is worth a warning.
COST_LIMIT = 5_000_000


def verdict(child: TriplesMap, parent: TriplesMap, join: Join) -> str:
    """``E1``, ``E2`` or ``keep`` for a join."""
    if child.source == parent.source and len(join.on) == 1 and join.on[0][0] == join.on[0][1] and set(child.subject.variables) == {join.on[0][0]}:
        return "E2"
    if join.on and set(parent.subject.variables) <= {p for _, p in join.on}:
        return "E1"
    return "keep"


def eliminate_joins(mapping: Mapping, contained: Callable[[TriplesMap, TriplesMap, Join], bool] | None = None) -> Mapping:
    """The mapping with every join replaced that rules E1 and E2 allow.

    ``contained(child, parent, join)`` says whether every child value has a
    parent row; without it, E1 keeps the semi-join, which is always exact.
    """

    def rewritten(child: TriplesMap, join: Join) -> Join | Template:
        parent = mapping.one(join.parent)
        rule = verdict(child, parent, join)
        if rule == "E2":
            return parent.subject
        if rule == "E1":
            template = Template(rename_variables(parent.subject.text, {p: c for c, p in join.on}))
            if contained is not None and contained(child, parent, join):
                return template
            return replace(join, template=template, semi=True)
        return join

    return Mapping(
        {
            label: replace(
                m,
                properties=tuple(
                    PredicateObjects(po.predicate, tuple(rewritten(m, o) if isinstance(o, Join) and o.template is None else o for o in po.objects))
                    for po in m.properties
                ),
            )
            for label, m in mapping.maps.items()
        }
    )


def dangling(child: DataFrame, parent: DataFrame, on: tuple[tuple[str, str], ...]) -> DataFrame:
    """Distinct child key values, none blank, that no parent row has."""
    keys = [f"k{i}" for i in range(len(on))]
    left = child.select(*[text_of(F.col(c)).alias(k) for k, (c, _) in zip(keys, on, strict=True)]).dropna().distinct()
    right = parent.select(*[text_of(F.col(p)).alias(k) for k, (_, p) in zip(keys, on, strict=True)]).dropna().distinct()
    return left.join(right, keys, "left_anti")


def contained_in(tables: dict[str, DataFrame]) -> Callable[[TriplesMap, TriplesMap, Join], bool]:
    """The check for ``eliminate_joins`` against the tables themselves: a job per join, which shuffles the distinct values of both sides."""
    return lambda child, parent, join: dangling(tables[child.source], tables[parent.source], join.on).isEmpty()


def join_report(mapping: Mapping, tables: dict[str, DataFrame]) -> list[dict]:
    """Per join: rule, dangling values, pairs of rows that nested loops would compare, warning."""
    counts = {m.source: None for m in mapping.maps.values()}
    counts = {s: tables[s].count() for s in counts}
    out = []
    for m in mapping.maps.values():
        for predicate, join in m.joins():
            parent = mapping.one(join.parent)
            pairs = counts[m.source] * counts[parent.source]
            rule = verdict(m, parent, join)
            out.append(
                {
                    "child": m.label, "predicate": predicate, "parent": parent.label, "rule": rule,
                    "dangling": dangling(tables[m.source], tables[parent.source], join.on).count(),
                    "pairs": pairs, "warn": rule == "keep" and pairs >= COST_LIMIT,
                }
            )
    return out
