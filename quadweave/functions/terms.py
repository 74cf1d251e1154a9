"""RDF terms as column expressions: IRI encoding, templates, N-Quads text."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A template variable, {name}.
VARIABLE = re.compile(r"\{([^{}]+)\}")


def text_of(column: Column) -> Column:
    """The column as text, null where it is null or empty: such values make no term."""
    text = column.cast("string")
    return F.when(text != "", text)


def iri_encode(column: Column) -> Column:
    """Percent-encode the UTF-8 bytes of all but RFC 3986 unreserved characters."""
    encoded = F.url_encode(column.cast("string"))  # form encoding: three characters differ
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def variables(template: str) -> list[str]:
    """Names of a template's variables, in order."""
    return VARIABLE.findall(template)


def rename_variables(template: str, names: Mapping[str, str]) -> str:
    """The template with variables renamed."""
    return VARIABLE.sub(lambda m: "{" + names.get(m[1], m[1]) + "}", template)


def render(template: str, columns: Mapping[str, Column], encode: bool = True) -> Column:
    """The template filled from columns; null if any variable is null or empty."""
    parts: list[Column] = []
    at = 0
    for m in VARIABLE.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        value = text_of(columns[m[1]])
        parts.append(iri_encode(value) if encode else value)
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def escape_literal(column: Column) -> Column:
    """Backslash, quote and line ends escaped for a quoted N-Quads literal."""
    out = column
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def nquad(s: Column, p: Column, o: Column, kind: Column, datatype: Column) -> Column:
    """One N-Quads line (default graph)."""
    literal = F.concat(F.lit('"'), escape_literal(o), F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), datatype, F.lit(">")), F.lit("")))
    term = F.when(kind == "iri", F.concat(F.lit("<"), o, F.lit(">"))).otherwise(literal)
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), term, F.lit(" ."))
