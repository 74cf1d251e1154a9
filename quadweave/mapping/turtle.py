"""A reader and writer for mappings in Turtle (the subset that mappings use)."""

from __future__ import annotations

import re
from collections import defaultdict

from .ir import RDF_TYPE, Constant, Join, Mapping, PredicateObjects, Reference, Template, TriplesMap

RR, RML = "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#"
QL_CSV = "http://semweb.mmlab.be/ns/ql#CSV"
#: Prefixes that may be used without a declaration.
STANDARD = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "owl": "http://www.w3.org/2002/07/owl#",
}
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")|(?P<text>"(?:[^"\\\n]|\\.)*")"""
    r"""|(?P<mark>\^\^|[.;,\[\]()])|(?P<at>@[A-Za-z-]+)|(?P<name>[^\s<>"\[\]();,^#]+?(?=[\s<>"\[\]();,^]|\.(?:\s|$)|$))"""
)
_ESCAPE = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "\\": "\\", "'": "'"}


class _Text(str):
    """A literal, told apart from IRIs and node names."""


class _Reader:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise ValueError(f"not understood at {source[at : at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        self.prefixes = dict(STANDARD)
        self.base = ""
        self.blank = 0
        self.triples: list[tuple[str, str, str]] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token[1] != value:
            raise ValueError(f"expected {value!r}, found {token[1]!r}")
        self.at += 1
        return token

    def document(self) -> list[tuple[str, str, str]]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if value.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.take()[1][1:-1]
            elif value.lower() in ("@base", "base"):
                self.take()
                self.base = self.take()[1][1:-1]
            else:
                subject = self.term()
                if self.peek()[1] != ".":
                    self.properties(subject)
                self.take(".")
                continue
            if self.peek()[1] == ".":
                self.take()
        return self.triples

    def properties(self, subject: str) -> None:
        while True:
            predicate = RDF_TYPE if self.peek() == ("name", "a") else None
            predicate = predicate or self.term() if predicate is None else (self.take(), predicate)[1]
            while True:
                self.triples.append((subject, predicate, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] in (".", "]"):
                    return
                break
            else:
                return

    def term(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            return value[1:-1] if re.match(r"<[A-Za-z][\w+.-]*:", value) else self.base + value[1:-1]
        if kind in ("text", "long"):
            inner = value[3:-3] if kind == "long" else value[1:-1]
            text = _Text(re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPE.get(m[1], m[1]), inner))
            if self.peek()[1] == "^^":
                self.take()
                self.term()
            elif self.peek()[0] == "at":
                self.take()
            return text
        if value == "[":
            self.blank += 1
            node = f"_:b{self.blank}"
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if kind == "name":
            prefix, colon, local = value.partition(":")
            if value.startswith("_:"):
                return value
            if colon and prefix in self.prefixes:
                return self.prefixes[prefix] + local
            if value in ("true", "false") or re.fullmatch(r"[+-]?[0-9.]+", value):
                return _Text(value)
        raise ValueError(f"no term: {value!r}")


def parse(source: str) -> Mapping:
    """The mapping that a Turtle document describes; maps without a label take their node's last part."""
    spo: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o in _Reader(source).document():
        spo[s][p].append(o)

    def one(node: str, *names: str) -> str | None:
        found = [o for n in names for o in spo[node].get(n, [])]
        if len(found) > 1:
            raise ValueError(f"{node} has {len(found)} values of {names[0]}")
        return found[0] if found else None

    label_of = STANDARD["rdfs"] + "label"
    maps = [s for s in list(spo) if f"{RR}TriplesMap" in spo[s].get(RDF_TYPE, []) or f"{RR}subjectMap" in spo[s]]
    labels = {m: str(one(m, label_of) or re.split(r"[/#]", m)[-1]) for m in maps}

    def predicate(node: str) -> str:
        direct = one(node, f"{RR}predicate")
        held = one(node, f"{RR}predicateMap")
        found = direct or (one(held, f"{RR}constant") if held else None)
        if not found:
            raise ValueError(f"{node} has no constant predicate")
        return str(found)

    def term(node: str) -> Constant | Reference | Template | Join:
        kind = {f"{RR}IRI": "iri", f"{RR}Literal": "literal"}.get(str(one(node, f"{RR}termType") or ""))
        parent = one(node, f"{RR}parentTriplesMap")
        if parent:
            on = tuple((str(one(j, f"{RR}child")), str(one(j, f"{RR}parent"))) for j in spo[node].get(f"{RR}joinCondition", []))
            return Join(labels[parent], on)
        constant, template, column = one(node, f"{RR}constant"), one(node, f"{RR}template"), one(node, f"{RML}reference", f"{RR}column")
        if constant is not None:
            return Constant(str(constant), kind or ("literal" if isinstance(constant, _Text) else "iri"))
        if template is not None:
            return Template(str(template), kind or "iri")
        if column is None:
            raise ValueError(f"{node} is no term map")
        datatype = one(node, f"{RR}datatype")
        return Reference(str(column), kind or "literal", str(datatype) if datatype else None)

    out = []
    for m in maps:
        logical = one(m, f"{RML}logicalSource", f"{RR}logicalTable")
        subject_map = one(m, f"{RR}subjectMap")
        subject = one(subject_map, f"{RR}template") if subject_map else None
        if not logical or subject is None:
            raise ValueError(f"{m} lacks a source or a subject template")
        properties = [PredicateObjects(RDF_TYPE, (Constant(str(c)),)) for c in spo[subject_map].get(f"{RR}class", [])]
        for po in spo[m].get(f"{RR}predicateObjectMap", []):
            objects = [Constant(str(o), "literal" if isinstance(o, _Text) else "iri") for o in spo[po].get(f"{RR}object", [])]
            objects += [term(o) for o in spo[po].get(f"{RR}objectMap", [])]
            properties.append(PredicateObjects(predicate(po), tuple(objects)))
        out.append(TriplesMap(labels[m], str(one(logical, f"{RML}source", f"{RR}tableName")), Template(str(subject)), tuple(properties)))
    return Mapping.of(out)


def _quoted(text: str) -> str:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(plain, escaped)
    return f'"{text}"'


def serialise(mapping: Mapping, base: str = "urn:map:") -> str:
    """A Turtle document that ``parse`` reads back to an equal mapping."""
    lines = [f"@prefix rr: <{RR}> .", f"@prefix rml: <{RML}> .", *(f"@prefix {k}: <{v}> ." for k, v in STANDARD.items()), ""]
    for m in mapping.maps.values():
        lines.append(f"<{base}{m.label}> a rr:TriplesMap ; rdfs:label {_quoted(m.label)} ;")
        lines.append(f"  rml:logicalSource [ rml:source {_quoted(m.source)} ; rml:referenceFormulation <{QL_CSV}> ] ;")
        lines.append(f"  rr:subjectMap [ rr:template {_quoted(m.subject.text)} ]" + (" ;" if m.properties else " ."))
        for i, po in enumerate(m.properties):
            objects = []
            for o in po.objects:
                if isinstance(o, Constant):
                    value = f"<{o.value}>" if o.kind == "iri" else _quoted(o.value)
                    objects.append(f"rr:objectMap [ rr:constant {value} ]")
                elif isinstance(o, Reference):
                    typed = f" ; rr:datatype <{o.datatype}>" if o.datatype else ""
                    objects.append(f"rr:objectMap [ rml:reference {_quoted(o.column)} ; rr:termType rr:{'IRI' if o.kind == 'iri' else 'Literal'}{typed} ]")
                elif isinstance(o, Join) and o.template is None:
                    on = " , ".join(f"[ rr:child {_quoted(c)} ; rr:parent {_quoted(p)} ]" for c, p in o.on)
                    joined = f" ; rr:joinCondition {on}" if on else ""
                    objects.append(f"rr:objectMap [ rr:parentTriplesMap <{base}{o.parent}>{joined} ]")
                else:
                    t = o.template if isinstance(o, Join) else o
                    objects.append(f"rr:objectMap [ rr:template {_quoted(t.text)} ; rr:termType rr:{'IRI' if t.kind == 'iri' else 'Literal'} ]")
            end = " ." if i == len(m.properties) - 1 else " ;"
            lines.append(f"  rr:predicateObjectMap [ rr:predicate <{po.predicate}> ; {' ; '.join(objects)} ]{end}")
        lines.append("")
    return "\n".join(lines)
