"""The transit roles played by the driver's tables, and the mapping over them.

Every role table exists twice: as a DataFrame, and as DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import time_of
from .mapping.ir import RDF_TYPE, XSD, Constant, Join, Mapping, PredicateObjects, Reference, Template, TriplesMap
from .operators.changes import Feed
from .operators.diff import last_wins

BASE = "http://example.org/"
TERMS = "http://vocab.gtfs.org/terms#"
NAME, PAGE = "http://xmlns.com/foaf/0.1/name", "http://xmlns.com/foaf/0.1/page"
KEYS = ("trip_id", "stop_id", "supplier_id")
FEED = Feed(keys=KEYS, times=("arrival_time", "departure_time"), fresh="trip_id", ratio=0.1, seed=1)


def _time_sql(seconds: str) -> str:
    return f"printf('%02d:%02d:%02d', ({seconds}) // 3600, (({seconds}) // 60) % 60, ({seconds}) % 60)"


_ARRIVAL = "(l_partkey * 37 + l_suppkey * 11 + l_linenumber * 60) % 100000"
_LAST = "l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"

SQL = {
    "stop_times": f"""SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_partkey AS VARCHAR) AS stop_id, CAST(l_suppkey AS VARCHAR) AS supplier_id,
  CAST(l_linenumber AS VARCHAR) AS stop_sequence, {_time_sql(_ARRIVAL)} AS arrival_time, {_time_sql(f"{_ARRIVAL} + 30")} AS departure_time,
  l_returnflag AS pickup_type, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS headsign,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS distance
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey
  ORDER BY {", ".join(f"{c} DESC" for c in _LAST.split(", "))}) = 1""",
    "trips": "SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(o_custkey AS VARCHAR) AS route_id, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS start_date FROM orders",
    "routes": "SELECT CAST(c_custkey AS VARCHAR) AS route_id, CAST(c_nationkey AS VARCHAR) AS agency_id, c_name AS long_name, c_mktsegment AS route_type FROM customer",
    "agency": "SELECT CAST(n_nationkey AS VARCHAR) AS agency_id, n_name AS agency_name, CAST(n_regionkey AS VARCHAR) AS calendar_id FROM nation",
    "stops": "SELECT CAST(p_partkey AS VARCHAR) AS stop_id, p_name AS stop_name, CAST(p_partkey - p_partkey % 10 AS VARCHAR) AS parent_station, p_brand AS zone_id FROM part",
    "shapes": "SELECT CAST(conv_id AS VARCHAR) AS shape_id, CAST(turn AS VARCHAR) AS sequence, role FROM conversations",
    "services_a": "SELECT CAST(c_custkey AS VARCHAR) AS service_id FROM customer",
    "services_b": "SELECT CAST(o_custkey AS VARCHAR) AS service_id, o_orderpriority AS rule FROM orders",
    "pages": "SELECT CAST(page_id AS VARCHAR) AS page_id, url FROM pages",
    "documents": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents",
    "labels": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality FROM labels",
}


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role table of a data folder; all cells are text."""
    def read(t: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    if name == "stop_times":
        last = last_wins(read("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], [F.col(c) for c in _LAST.split(", ")])
        arrival = F.expr(_ARRIVAL)
        return last.select(
            _text("l_orderkey").alias("trip_id"), _text("l_partkey").alias("stop_id"), _text("l_suppkey").alias("supplier_id"),
            _text("l_linenumber").alias("stop_sequence"), time_of(arrival).alias("arrival_time"), time_of(arrival + 30).alias("departure_time"),
            F.col("l_returnflag").alias("pickup_type"), F.when(F.expr("l_linenumber % 3 = 0"), "").otherwise(F.col("l_linestatus")).alias("headsign"),
            F.when(F.expr("l_linenumber % 5 <> 0"), F.col("l_quantity").cast("long").cast("string")).alias("distance"),
        )
    if name == "trips":
        return read("orders").select(
            _text("o_orderkey").alias("trip_id"), _text("o_custkey").alias("route_id"), F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        )
    if name == "routes":
        return read("customer").select(_text("c_custkey").alias("route_id"), _text("c_nationkey").alias("agency_id"), F.col("c_name").alias("long_name"), F.col("c_mktsegment").alias("route_type"))
    if name == "agency":
        return read("nation").select(_text("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency_name"), _text("n_regionkey").alias("calendar_id"))
    if name == "stops":
        parent = F.expr("p_partkey - p_partkey % 10").cast("string")
        return read("part").select(_text("p_partkey").alias("stop_id"), F.col("p_name").alias("stop_name"), parent.alias("parent_station"), F.col("p_brand").alias("zone_id"))
    if name == "shapes":
        return read("conversations").select(_text("conv_id").alias("shape_id"), _text("turn").alias("sequence"), "role")
    if name == "services_a":
        return read("customer").select(_text("c_custkey").alias("service_id"))
    if name == "services_b":
        return read("orders").select(_text("o_custkey").alias("service_id"), F.col("o_orderpriority").alias("rule"))
    if name == "pages":
        return read("pages").select(_text("page_id").alias("page_id"), "url")
    if name == "documents":
        return read("documents").select(_text("doc_id").alias("doc_id"), "lang", "source")
    if name == "labels":
        return read("labels").select(_text("doc_id").alias("doc_id"), _text("quality").alias("quality"))
    raise KeyError(name)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Several role tables."""
    return {n: table(spark, sf_dir, n) for n in names}


def _p(predicate: str, *objects: Constant | Reference | Template | Join) -> PredicateObjects:
    return PredicateObjects(predicate if ":" in predicate else TERMS + predicate, objects)


def _type(name: str) -> PredicateObjects:
    return _p(RDF_TYPE, Constant(TERMS + name))


def _iri(path: str) -> Template:
    return Template(BASE + path)


MAPPING = Mapping.of(
    [
        TriplesMap(
            "stoptimes",
            "stop_times",
            _iri("stoptimes/{trip_id}-{stop_id}"),
            (
                _type("StopTime"),
                _p("arrivalTime", Reference("arrival_time", datatype=XSD + "duration")),
                _p("departureTime", Reference("departure_time", datatype=XSD + "duration")),
                _p("stopSequence", Reference("stop_sequence", datatype=XSD + "integer")),
                _p("pickupType", _iri("resource/PickupType/{pickup_type}")),
                _p("headsign", Reference("headsign")),
                _p("distanceTraveled", Reference("distance")),
                _p("trip", Join("trips", (("trip_id", "trip_id"),))),
                _p("stop", Join("stops", (("stop_id", "stop_id"),))),
            ),
        ),
        TriplesMap(
            "trips",
            "trips",
            _iri("trips/{trip_id}"),
            (
                _type("Trip"),
                _p("status", Reference("status")),
                _p("startDate", Reference("start_date", datatype=XSD + "date")),
                _p("route", Join("routes", (("route_id", "route_id"),))),
                _p("service", Join("services1", (("route_id", "service_id"),)), Join("services2", (("route_id", "service_id"),))),
            ),
        ),
        TriplesMap(
            "routes",
            "routes",
            _iri("routes/{route_id}"),
            (_type("Route"), _p("longName", Reference("long_name")), _p("routeType", _iri("resource/RouteType/{route_type}")), _p("agency", Join("agency", (("agency_id", "agency_id"),)))),
        ),
        TriplesMap("agency", "agency", _iri("agency/{agency_name}"), (_type("Agency"), _p(NAME, Reference("agency_name")))),
        TriplesMap(
            "stops",
            "stops",
            _iri("stops/{stop_id}"),
            (_type("Stop"), _p(NAME, Reference("stop_name")), _p("zone", Reference("zone_id")), _p("parentStation", Join("stops", (("parent_station", "stop_id"),)))),
        ),
        TriplesMap("shapes", "shapes", _iri("shape/{shape_id}"), (_type("Shape"), _p("shapePoint", Join("shape_points", (("shape_id", "shape_id"),))))),
        TriplesMap("shape_points", "shapes", _iri("shape_point/{shape_id}-{sequence}"), (_type("ShapePoint"), _p("pointSequence", Reference("sequence")))),
        TriplesMap("services1", "services_a", _iri("services/{service_id}"), (_type("Service"),)),
        TriplesMap("services2", "services_b", _iri("services/{service_id}"), (_type("Service"), _p("serviceRule", _iri("rules/{rule}")))),
        TriplesMap("pages", "pages", _iri("page/{page_id}"), (_p(PAGE, Reference("url", "iri")), _p("encoded", Template(BASE + "at/{url}")))),
        TriplesMap("documents", "documents", _iri("documents/{doc_id}"), (_type("Document"), _p("label", Join("labels", (("doc_id", "doc_id"),))))),
        TriplesMap("labels", "labels", _iri("labels/{doc_id}"), (_p("quality", Reference("quality", datatype=XSD + "boolean")),)),
    ]
)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def term_sql(term: Constant | Reference | Template, encode: bool = True, alias: str = "c") -> str:
    """A term as DuckDB SQL, null where it makes none."""
    if isinstance(term, Constant):
        return _literal(term.value)
    if isinstance(term, Reference):
        return f"nullif({alias}.{term.column}, '')"
    parts, at = [], 0
    for m in __import__("re").finditer(r"\{([^{}]+)\}", term.text):
        parts.append(_literal(term.text[at : m.start()]))
        value = f"nullif({alias}.{m[1]}, '')"
        parts.append(f"url_encode({value})" if encode else value)
        at = m.end()
    parts.append(_literal(term.text[at:]))
    return " || ".join(p for p in parts if p != "''")


def quads_sql(labels: list[str], sources: dict[str, str] | None = None, mapping: Mapping = MAPPING) -> str:
    """The graph of some maps as one query: every object map a SELECT, joins written out, UNION for the set."""
    sources = {**SQL, **(sources or {})}
    parts = []
    for label in labels:
        m = mapping.one(label)
        s = term_sql(m.subject)
        for po in m.properties:
            for o in po.objects:
                if isinstance(o, Join):
                    parent = mapping.one(o.parent)
                    on = " AND ".join(f"nullif(c.{a}, '') = nullif(q.{b}, '')" for a, b in o.on)
                    value, kind, datatype = term_sql(parent.subject, alias="q"), "iri", "NULL"
                    source = f"({sources[m.source]}) c JOIN ({sources[parent.source]}) q ON {on}"
                else:
                    value, kind = term_sql(o), getattr(o, "kind", "iri")
                    datatype = _literal(o.datatype) if isinstance(o, Reference) and o.datatype else "NULL"
                    source = f"({sources[m.source]}) c"
                parts.append(
                    f"SELECT {s} AS s, {_literal(po.predicate)} AS p, {value} AS o, {_literal(kind)} AS o_kind, CAST({datatype} AS VARCHAR) AS o_datatype "
                    f"FROM {source} WHERE {s} IS NOT NULL AND {value} IS NOT NULL"
                )
    return "\nUNION\n".join(parts)
