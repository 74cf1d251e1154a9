"""The mapping as plain data: triples maps, term maps, joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from ..functions.terms import variables

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Constant:
    """A fixed IRI or literal."""

    value: str
    kind: str = "iri"


@dataclass(frozen=True)
class Reference:
    """A column's value as literal (with a datatype, maybe) or as IRI."""

    column: str
    kind: str = "literal"
    datatype: str | None = None


@dataclass(frozen=True)
class Template:
    """A text with {column} variables; values are percent-encoded in IRIs."""

    text: str
    kind: str = "iri"

    @property
    def variables(self) -> list[str]:
        """Names of the columns that it reads."""
        return variables(self.text)


@dataclass(frozen=True)
class Join:
    """The subjects of another map's rows that meet all (child, parent) column pairs.

    ``semi`` holds the (child, parent) pairs to check where a join has been
    replaced by ``template`` over the child's own columns.
    """

    parent: str
    on: tuple[tuple[str, str], ...]
    template: Template | None = None
    semi: bool = False


Term = Constant | Reference | Template | Join


@dataclass(frozen=True)
class PredicateObjects:
    """A predicate with its object maps."""

    predicate: str
    objects: tuple[Term, ...]


@dataclass(frozen=True)
class TriplesMap:
    """Rows of a source to a subject and its properties."""

    label: str
    source: str
    subject: Template
    properties: tuple[PredicateObjects, ...] = ()

    def joins(self) -> Iterator[tuple[str, Join]]:
        """(predicate, join) of every object map that refers to another map."""
        for po in self.properties:
            for o in po.objects:
                if isinstance(o, Join):
                    yield po.predicate, o

    def columns(self) -> set[str]:
        """Columns of the source that it reads."""
        names = set(self.subject.variables)
        for po in self.properties:
            for o in po.objects:
                if isinstance(o, Reference):
                    names.add(o.column)
                elif isinstance(o, Template):
                    names |= set(o.variables)
                elif isinstance(o, Join):
                    names |= {c for c, _ in o.on} | set(o.template.variables if o.template else ())
        return names


@dataclass(frozen=True)
class Mapping:
    """Triples maps by label."""

    maps: dict[str, TriplesMap] = field(default_factory=dict)

    @staticmethod
    def of(maps: Iterable[TriplesMap]) -> Mapping:
        """A mapping; labels must differ."""
        out: dict[str, TriplesMap] = {}
        for m in maps:
            if m.label in out:
                raise ValueError(f"two triples maps are labelled {m.label}")
            out[m.label] = m
        return Mapping(out)

    def one(self, label: str) -> TriplesMap:
        """The map with a label; an error names those there are."""
        if label not in self.maps:
            raise KeyError(f"no triples map {label}; there are {sorted(self.maps)}")
        return self.maps[label]

    def of_source(self, source: str) -> list[TriplesMap]:
        """Maps whose source's name holds ``source``, without regard to case."""
        return [m for m in self.maps.values() if source.lower() in m.source.lower()]

    def subject_template(self, source: str) -> str:
        """The one subject template of a source; an error where there is none or several."""
        found = {m.subject.text for m in self.of_source(source)}
        if len(found) != 1:
            raise LookupError(f"{source}: {len(found)} subject templates: {sorted(found)}")
        return found.pop()

    def narrowed(self, labels: Iterable[str]) -> Mapping:
        """Only these maps, without what only others need: parents stay as far as joins read their subjects."""
        wanted = list(dict.fromkeys(labels))
        out = {label: self.one(label) for label in wanted}
        for label in wanted:
            for _, join in out[label].joins():
                if join.parent not in out:
                    out[join.parent] = replace(self.one(join.parent), properties=())
        return Mapping(out)

    def only_predicates(self, predicates: Iterable[str]) -> Mapping:
        """Only properties with these predicates: what a query never reads isn't computed."""
        keep = set(predicates)
        return Mapping({k: replace(m, properties=tuple(p for p in m.properties if p.predicate in keep)) for k, m in self.maps.items()})

    def rebound(self, names: dict[str, str]) -> Mapping:
        """Sources renamed; an error if no source has one of the names."""
        unused = set(names) - {m.source for m in self.maps.values()}
        if unused:
            raise LookupError(f"no logical source {sorted(unused)}")
        return Mapping({k: replace(m, source=names.get(m.source, m.source)) for k, m in self.maps.items()})
