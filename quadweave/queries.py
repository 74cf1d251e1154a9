"""Named queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixtures as fx
from .functions import scalars, terms
from .mapping import turtle
from .mapping.compile import compile_mapping
from .mapping.ir import Mapping
from .mapping.rewrite import contained_in, dangling, eliminate_joins, join_report
from .operators import changes, commit, diff, graph, metrics, partition
from .plans import refresh
from .sources import logs, nquads, snapshots
from .streaming import refresh as streams
from .tables import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K, THRESHOLD, FACTOR = 4, 1.7, 4


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _sources(labels: list[str], mapping: Mapping) -> list[str]:
    maps = [mapping.one(x) for x in labels]
    return sorted({m.source for m in maps} | {mapping.one(j.parent).source for m in maps for _, j in m.joins()})


def _graph(spark: SparkSession, d: str, labels: list[str], rewrite: bool = False, check: bool = False, **replaced: DataFrame) -> DataFrame:
    """The graph of some maps."""
    narrowed = fx.MAPPING.narrowed(labels)
    tables = {**fx.tables(spark, d, *_sources(labels, fx.MAPPING)), **replaced}
    if rewrite:
        narrowed = eliminate_joins(narrowed, contained_in(tables) if check else None)
    return compile_mapping(narrowed, tables)


# mapping


@query(fx.quads_sql(["stoptimes"]))
def map_stop_times(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: stop times with typed literals, templates and links, joins reduced to semi-joins."""
    return _graph(spark, d, ["stoptimes"], rewrite=True)


@query(fx.quads_sql(["stoptimes"]))
def map_stop_times_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same with every join carried out."""
    return _graph(spark, d, ["stoptimes"])


@query(fx.quads_sql(["stoptimes"]))
def map_stop_times_checked(spark: SparkSession, d: str) -> DataFrame:
    """The same with references checked first, so that no join is left."""
    return _graph(spark, d, ["stoptimes"], rewrite=True, check=True)


@query(fx.quads_sql(["trips"]))
def map_trips_two_services(spark: SparkSession, d: str) -> DataFrame:
    """Two object maps under one predicate, linked to two maps with one subject template."""
    return _graph(spark, d, ["trips"])


@query(fx.quads_sql(["services1", "services2"]))
def map_services_union(spark: SparkSession, d: str) -> DataFrame:
    """Two maps that share their subjects."""
    return _graph(spark, d, ["services1", "services2"])


@query(fx.quads_sql(["routes", "agency"]))
def map_routes_join(spark: SparkSession, d: str) -> DataFrame:
    """A join that stays: the parent's subject isn't made of the join column."""
    return _graph(spark, d, ["routes", "agency"], rewrite=True)


@query(fx.quads_sql(["stops"]))
def map_stops_self_join(spark: SparkSession, d: str) -> DataFrame:
    """A self-join over differing columns, dangling parents left out."""
    return _graph(spark, d, ["stops"], rewrite=True)


@query(fx.quads_sql(["shapes", "shape_points"]))
def map_shapes_one_to_many(spark: SparkSession, d: str) -> DataFrame:
    """A shape's points by a join of one source with itself."""
    return _graph(spark, d, ["shapes", "shape_points"])


@query(fx.quads_sql(["shapes", "shape_points"]))
def map_shapes_linearised(spark: SparkSession, d: str) -> DataFrame:
    """The same without a join (rule E2)."""
    return _graph(spark, d, ["shapes", "shape_points"], rewrite=True)


@query(fx.quads_sql(["pages"]))
def map_pages_iris(spark: SparkSession, d: str) -> DataFrame:
    """IRIs by reference and by template from a column of URLs."""
    return _graph(spark, d, ["pages"])


@query(fx.quads_sql(["documents"]))
def map_documents_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Links only where the parent row exists: the semi-join must stay."""
    return _graph(spark, d, ["documents"], rewrite=True, check=True)


_ALL = ["stoptimes", "trips", "routes", "agency", "stops", "shapes", "shape_points", "services1", "services2"]


@query(f"SELECT p, count(*) AS quads, count(DISTINCT s) AS subjects FROM ({fx.quads_sql(_ALL)}) GROUP BY p")
def predicate_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Quads and subjects by predicate over the whole graph."""
    return graph.predicate_histogram(_graph(spark, d, _ALL, rewrite=True))


@query(f"SELECT degree, count(*) AS subjects FROM (SELECT s, count(*) AS degree FROM ({fx.quads_sql(_ALL)}) GROUP BY s) GROUP BY degree")
def subject_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of quads per subject."""
    return graph.subject_degrees(_graph(spark, d, _ALL, rewrite=True))


@query(f"SELECT * FROM ({fx.quads_sql(['stoptimes'])}) WHERE p = '{fx.TERMS}trip'")
def predicate_pruning(spark: SparkSession, d: str) -> DataFrame:
    """One predicate of a graph: the other properties are never computed."""
    narrowed = eliminate_joins(fx.MAPPING.narrowed(["stoptimes"])).only_predicates([fx.TERMS + "trip"])
    return compile_mapping(narrowed, fx.tables(spark, d, *_sources(["stoptimes"], fx.MAPPING)))


@query(f"""SELECT count(*) AS rows_with_blank, count(*) FILTER (WHERE distance IS NULL) AS null_distance, count(*) FILTER (WHERE headsign = '') AS empty_headsign,
  (SELECT count(*) FROM ({fx.quads_sql(["stoptimes"])}) WHERE p IN ('{fx.TERMS}headsign', '{fx.TERMS}distanceTraveled') AND coalesce(o, '') = '') AS blank_quads
FROM ({fx.SQL["stop_times"]}) WHERE distance IS NULL OR headsign = ''""")
def empty_term_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Rows with blank values, and the quads that come of them (none)."""
    rows = fx.table(spark, d, "stop_times").where("distance is null or headsign = ''")
    found = rows.agg(
        F.count("*").alias("rows_with_blank"), F.count_if(F.col("distance").isNull()).alias("null_distance"), F.count_if(F.col("headsign") == "").alias("empty_headsign")
    )
    blank = _graph(spark, d, ["stoptimes"]).where(F.col("p").isin(fx.TERMS + "headsign", fx.TERMS + "distanceTraveled") & (F.coalesce("o", F.lit("")) == ""))
    return found.withColumn("_j", F.lit(1)).join(blank.agg(F.count("*").alias("blank_quads")).withColumn("_j", F.lit(1)), "_j").drop("_j")


@query("""SELECT 'documents' AS child, 'labels' AS parent, count(*) AS dangling FROM (SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
UNION ALL SELECT 'lineitem', 'orders', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'part', 'part', count(DISTINCT p_partkey - p_partkey % 10) FROM part WHERE p_partkey - p_partkey % 10 NOT IN (SELECT p_partkey FROM part)""")
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """Child values without a parent, for three links."""
    t = fx.tables(spark, d, "documents", "labels", "stop_times", "trips", "stops")
    rows = (
        ("documents", "labels", dangling(t["documents"], t["labels"], (("doc_id", "doc_id"),))),
        ("lineitem", "orders", dangling(t["stop_times"], t["trips"], (("trip_id", "trip_id"),))),
        ("part", "part", dangling(t["stops"], t["stops"], (("parent_station", "stop_id"),))),
    )
    parts = [df.agg(F.count("*").alias("dangling")).select(F.lit(a).alias("child"), F.lit(b).alias("parent"), "dangling") for a, b, df in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ELIMINATED = ["documents", "stops", "shapes", "shape_points"]


@query(f"SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, count(*) AS quads, count(DISTINCT s) AS subjects FROM ({fx.quads_sql(_ELIMINATED)})")
def join_elimination_is_exact(spark: SparkSession, d: str) -> DataFrame:
    """Graph with joins against graph without: no quad differs, and there are as many as the oracle makes."""
    plain, rewritten = _graph(spark, d, _ELIMINATED), _graph(spark, d, _ELIMINATED, rewrite=True, check=True)
    return graph.difference(plain, rewritten).crossJoin(rewritten.agg(F.count("*").alias("quads"), F.countDistinct("s").alias("subjects")))  # one row each


# scalars


@query("SELECT page_id, url_encode(url) AS encoded, url_encode(html) AS encoded_html FROM pages")
def iri_encode_pages(spark: SparkSession, d: str) -> DataFrame:
    """Percent-encoding of URLs and of raw markup."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", terms.iri_encode(F.col("url")).alias("encoded"), terms.iri_encode(F.col("html")).alias("encoded_html"))


def _shift_sql(column: str, by: str) -> str:
    part = f"CAST(string_split(trim({column}), ':')[{{}}] AS BIGINT)"
    total = f"greatest(0, {part.format(1)} * 3600 + {part.format(2)} * 60 + {part.format(3)} + ({by}))"
    return f"CASE WHEN regexp_matches(trim({column}), '{scalars.TIME}') THEN {fx._time_sql(total)} END"


@query(f"""SELECT event_id, {_shift_sql("t", "user_id * 7 - 9000")} AS shifted, CASE WHEN regexp_matches(t, '{scalars.TIME}') THEN t END AS valid_time
FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN '12:60:00' ELSE {fx._time_sql("(event_id * 37) % 100000")} END AS t FROM events)""")
def shift_times(spark: SparkSession, d: str) -> DataFrame:
    """Times moved by seconds, hours beyond 23, invalid and blank ones left out."""
    t = F.when(F.expr("event_id % 7 = 0"), "").when(F.expr("event_id % 11 = 0"), "12:60:00").otherwise(scalars.time_of(F.expr("(event_id * 37) % 100000")))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", t.alias("t"))
    return rows.select(
        "event_id", scalars.shift_time(F.col("t"), F.expr("user_id * 7 - 9000")).alias("shifted"), F.when(F.col("t").rlike(scalars.TIME), F.col("t")).alias("valid_time")
    )


@query("""SELECT event_id, CASE WHEN regexp_matches(k, '^[0-9]{1,18}$') THEN CAST(CAST(k AS BIGINT) + 1000000 + event_id % 10 AS VARCHAR) ELSE k || '_new' || CAST(event_id % 10 AS VARCHAR) END AS fresh
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS k FROM events)""")
def fresh_keys(spark: SparkSession, d: str) -> DataFrame:
    """New keys of numbers and of other texts."""
    key = F.when(F.expr("event_id % 2 = 0"), F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.fresh_key(key, F.expr("event_id % 10")).alias("fresh"))


@query("""SELECT event_id, (event_id * 37) % 7200 AS seconds_expected,
  CASE WHEN event_id % 2 = 0 THEN CAST((event_id * 37) % 7200 AS DOUBLE) ELSE CAST((event_id * 37) % 3600 AS DOUBLE) + 0.25 END AS elapsed, event_id / 1024.0 AS mb, CAST(floor(value + 0.5) AS BIGINT) AS half_up
FROM events""")
def elapsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Elapsed texts to seconds, sizes to megabytes, rounding of halves."""
    n, m = F.expr("(event_id * 37) % 7200"), F.expr("(event_id * 37) % 3600")
    long = F.format_string("%d:%02d:%02d", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)
    short = F.format_string("%d:%02d.25", F.floor(m / 60), m % 60)
    text = F.when(F.expr("event_id % 2 = 0"), long).otherwise(short)
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", n.alias("seconds_expected"), scalars.elapsed_seconds(text).alias("elapsed"), scalars.kb_to_mb(F.col("event_id")).alias("mb"), scalars.half_up(F.col("value")).alias("half_up")
    )


def _md5_sql(text: str, k: int) -> str:
    out = "0"
    for at in (1, 9, 17, 25):
        out = f"(({out}) * 4294967296 + CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT)) % {k}"
    return f"CAST({out} AS INTEGER)"


@query(f"SELECT o_orderkey, {_md5_sql('CAST(o_orderkey AS VARCHAR)', 2)} AS by_2, {_md5_sql('CAST(o_orderkey AS VARCHAR)', 7)} AS by_7, {_md5_sql('o_orderpriority', 1000)} AS by_1000 FROM orders")
def md5_partition(spark: SparkSession, d: str) -> DataFrame:
    """Stable partition numbers."""
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", scalars.md5_mod(F.col("o_orderkey"), 2).alias("by_2"), scalars.md5_mod(F.col("o_orderkey"), 7).alias("by_7"), scalars.md5_mod(F.col("o_orderpriority"), 1000).alias("by_1000")
    )


@query("SELECT event_id, coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END, '') AS row_key FROM events")
def row_keys(spark: SparkSession, d: str) -> DataFrame:
    """Joined keys with null as empty."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", scalars.row_key([F.col("user_id"), F.when(F.expr("event_id % 3 <> 0"), F.col("event_type"))]).alias("row_key"))


# change feed and diff

_KEY = "trip_id || '|' || stop_id || '|' || supplier_id"
_MARKED = f"""st AS ({fx.SQL["stop_times"]}),
tot AS (SELECT count(*) AS n, max(CAST(trip_id AS BIGINT)) AS hi, greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) AS total FROM st),
q AS (SELECT n, hi, total, total // 4 AS share FROM tot),
marked AS (SELECT *, {_KEY} AS k, CASE WHEN rank < share THEN 'delete' WHEN rank < 2 * share THEN 'update' WHEN rank < total - share THEN 'composite' END AS op
  FROM (SELECT *, row_number() OVER (ORDER BY md5('1:' || {_KEY}), trip_id, stop_id, supplier_id) - 1 AS rank FROM st), q),
ins AS (SELECT m.*, j FROM marked m JOIN (SELECT j, CAST('0x' || substr(md5('1+' || j), 1, 12) AS BIGINT) % n AS r FROM (SELECT unnest(range(share)) AS j, n FROM q)) x ON x.r = m.rank),
aft AS (
  SELECT trip_id, stop_id, supplier_id, stop_sequence,
    coalesce(CASE op WHEN 'update' THEN {_shift_sql("arrival_time", "61")} WHEN 'composite' THEN {_shift_sql("arrival_time", "121")} END, arrival_time) AS arrival_time,
    coalesce(CASE op WHEN 'composite' THEN {_shift_sql("departure_time", "121")} END, departure_time) AS departure_time, pickup_type, headsign, distance
  FROM marked WHERE op IS DISTINCT FROM 'delete'
  UNION ALL
  SELECT CAST(hi + 1 + j AS VARCHAR), stop_id, supplier_id, stop_sequence, coalesce({_shift_sql("arrival_time", "3601 + 60 * j")}, arrival_time),
    coalesce({_shift_sql("departure_time", "3601 + 60 * j")}, departure_time), pickup_type, headsign, distance FROM ins)"""
_COLUMNS = ("trip_id", "stop_id", "supplier_id", "stop_sequence", "arrival_time", "departure_time", "pickup_type", "headsign", "distance")
_DIFF = f"""{_MARKED},
d AS (SELECT CASE WHEN b.trip_id IS NULL THEN 'inserted' WHEN a.trip_id IS NULL THEN 'deleted' ELSE 'updated' END AS change,
  {", ".join(f"b.{c} AS old_{c}, a.{c} AS new_{c}" for c in _COLUMNS)}
  FROM st b FULL OUTER JOIN aft a ON a.trip_id = b.trip_id AND a.stop_id = b.stop_id AND a.supplier_id = b.supplier_id
  WHERE b.trip_id IS NULL OR a.trip_id IS NULL OR ({", ".join(f"b.{c}" for c in _COLUMNS)}) IS DISTINCT FROM ({", ".join(f"a.{c}" for c in _COLUMNS)}))"""


def _feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    before = fx.table(spark, d, "stop_times")
    return (before, *changes.generate(before, fx.FEED))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    before, after, _ = _feed(spark, d)
    return diff.diff(before, after, fx.KEYS)


def _side_sql(side: str, kinds: str) -> str:
    return f"WITH {_DIFF} SELECT {', '.join(f'{side}_{c} AS {c}' for c in _COLUMNS)} FROM d WHERE change IN ({kinds})"


@query(f"WITH {_MARKED} SELECT * FROM aft")
def changed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The table after a generated change feed."""
    return _feed(spark, d)[1]


@query(f"""WITH {_MARKED}
SELECT op, k AS old_key, CASE WHEN op = 'delete' THEN '' ELSE k END AS new_key, CASE op WHEN 'update' THEN 'arrival_time' WHEN 'composite' THEN 'arrival_time,departure_time' ELSE '' END AS changed_fields
FROM marked WHERE op IS NOT NULL
UNION ALL SELECT 'insert', '', CAST(hi + 1 + j AS VARCHAR) || '|' || stop_id || '|' || supplier_id, '*' FROM ins""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Operations, old and new keys, changed fields."""
    return _feed(spark, d)[2]


@query(f"WITH {_MARKED} SELECT op, count(*) AS n FROM (SELECT op FROM marked WHERE op IS NOT NULL UNION ALL SELECT 'insert' FROM ins) GROUP BY op")
def change_log_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes by operation."""
    return _feed(spark, d)[2].groupBy("op").agg(F.count("*").alias("n"))


_SKEWED = f"""WITH st AS ({fx.SQL["stop_times"]}),
q AS (SELECT total, total // 4 AS share, total - 3 * (total // 4) AS comp, CAST(floor((total - total // 4) * 0.75 + 0.5) AS BIGINT) AS forced
  FROM (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) AS total FROM st)),
shares AS (SELECT name, n, n * forced // sum(n) OVER () AS f, n * forced % sum(n) OVER () AS r, forced FROM q, LATERAL (VALUES ('insert', share), ('update', share), ('composite', comp)) v(name, n)),
quota AS (SELECT name, n, f + CASE WHEN row_number() OVER (ORDER BY r DESC, name) <= forced - sum(f) OVER () THEN 1 ELSE 0 END AS f FROM shares),
u AS (SELECT n, f FROM quota WHERE name = 'update'), c AS (SELECT n, f FROM quota WHERE name = 'composite'),
ranked AS (SELECT *, {_KEY} AS k, CASE WHEN {_md5_sql("trip_id", K)} = 0 THEN 1 ELSE 0 END AS home FROM st),
placed AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY md5('1:' || k)) - 1 AS r FROM ranked),
moved AS (SELECT p.*, CASE WHEN home = 1 THEN CASE WHEN r < u.f THEN 'update' WHEN r < u.f + c.f THEN 'composite' END
  ELSE CASE WHEN r < u.n - u.f THEN 'update' WHEN r < u.n - u.f + c.n - c.f THEN 'composite' END END AS op0 FROM placed p, u, c),
marked AS (SELECT *, CASE WHEN op0 IS NULL AND row_number() OVER (PARTITION BY op0 IS NULL ORDER BY md5('1:' || k)) <= (SELECT share FROM q) THEN 'delete' ELSE op0 END AS op FROM moved)"""


def _skewed_log(spark: SparkSession, d: str) -> DataFrame:
    return changes.generate(fx.table(spark, d, "stop_times"), fx.FEED, changes.Skew("trip_id", K, 0.75))[1]


@query(f"{_SKEWED} SELECT op, k AS old_key, CASE WHEN op = 'delete' THEN '' ELSE k END AS new_key FROM marked WHERE op IS NOT NULL")
def skewed_change_log(spark: SparkSession, d: str) -> DataFrame:
    """Operations of a feed of which three quarters come from one partition."""
    return _skewed_log(spark, d).where("op <> 'insert'").select("op", "old_key", "new_key")


@query(f"{_SKEWED} SELECT op, home, count(*) AS n FROM marked WHERE op IN ('update', 'composite') GROUP BY ALL")
def skewed_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Moved rows of that feed by operation and partition."""
    trip = F.split("old_key", r"\|")[0]
    home = (scalars.md5_mod(trip, K) == 0).cast("int")
    return _skewed_log(spark, d).where("op in ('update', 'composite')").groupBy("op", home.alias("home")).agg(F.count("*").alias("n"))


@query(_side_sql("new", "'inserted'"))
def diff_inserted(spark: SparkSession, d: str) -> DataFrame:
    """Rows of keys that are new."""
    return _changes(spark, d).where("change = 'inserted'").select("new.*")


@query(_side_sql("old", "'deleted'"))
def diff_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Rows of keys that are gone."""
    return _changes(spark, d).where("change = 'deleted'").select("old.*")


@query(_side_sql("new", "'updated'"))
def diff_updated(spark: SparkSession, d: str) -> DataFrame:
    """New rows of keys whose row differs."""
    return _changes(spark, d).where("change = 'updated'").select("new.*")


@query(_side_sql("new", "'inserted', 'updated'"))
def delta_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows to map."""
    return diff.delta_rows(_changes(spark, d))


@query(_side_sql("old", "'deleted', 'updated'"))
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows to forget."""
    return diff.stale_rows(_changes(spark, d))


@query(f"WITH {_DIFF} SELECT change, count(*) AS n FROM d GROUP BY change")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes by kind."""
    return diff.summary(_changes(spark, d))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that aren't unique."""
    return diff.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS lost FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many keys repeat, in how many rows, and how many of these lose."""
    return diff.duplicate_totals(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


_LINES_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem"
_LAST_LINE = "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1"


@query(f"""WITH b AS ({_LINES_SQL} {_LAST_LINE}), a AS ({_LINES_SQL} WHERE l_suppkey % 5 <> 0 {_LAST_LINE})
SELECT CASE WHEN b.l_orderkey IS NULL THEN 'inserted' WHEN a.l_orderkey IS NULL THEN 'deleted' ELSE 'updated' END AS change, coalesce(b.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, a.l_linenumber) AS l_linenumber, b.l_suppkey AS old_supplier, a.l_suppkey AS new_supplier
FROM b FULL OUTER JOIN a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
WHERE b.l_orderkey IS NULL OR a.l_orderkey IS NULL OR (b.l_suppkey, b.l_quantity) IS DISTINCT FROM (a.l_suppkey, a.l_quantity)""")
def diff_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Changes between tables whose keys repeat: the last row of each key counts."""
    before = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    found = diff.diff(before, before.where("l_suppkey % 5 <> 0"), ["l_orderkey", "l_linenumber"], position=["l_partkey"])
    return found.select(
        "change", F.coalesce("old.l_orderkey", "new.l_orderkey").alias("l_orderkey"), F.coalesce("old.l_linenumber", "new.l_linenumber").alias("l_linenumber"),
        F.col("old.l_suppkey").alias("old_supplier"), F.col("new.l_suppkey").alias("new_supplier"),
    )


@query(f"""WITH {_DIFF}, gone AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 20 = 0),
t AS (SELECT 'agency' AS table_name, 0 AS delta_rows, 0 AS stale_rows
  UNION ALL SELECT 'routes', 0, n FROM gone
  UNION ALL SELECT 'stop_times', count(*) FILTER (WHERE change <> 'deleted'), count(*) FILTER (WHERE change <> 'inserted') FROM d)
SELECT table_name, CAST(delta_rows AS BIGINT) AS delta_rows, CAST(stale_rows AS BIGINT) AS stale_rows FROM t
UNION ALL SELECT NULL, CAST(sum(delta_rows) AS BIGINT), CAST(sum(stale_rows) AS BIGINT) FROM t""")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows to map and to forget of each table, and of all."""
    before = fx.tables(spark, d, "stop_times", "routes", "agency")
    after = {**before, "stop_times": _feed(spark, d)[1], "routes": before["routes"].where("cast(route_id as bigint) % 20 <> 0")}
    return diff.totals(diff.diff_snapshots(before, after, {"stop_times": fx.KEYS, "routes": ["route_id"], "agency": ["agency_id"]}))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_row_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each key."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return diff.last_wins(e, ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


_SUBJECT = fx.term_sql(fx.MAPPING.one("stoptimes").subject, alias="x")


@query(f"WITH {_DIFF}, stale AS (SELECT {', '.join(f'old_{c} AS {c}' for c in _COLUMNS)} FROM d WHERE change IN ('deleted', 'updated')) SELECT DISTINCT {_SUBJECT} AS s FROM stale x")
def stale_iris(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of stale rows, from the template alone."""
    return graph.subjects(fx.MAPPING.one("stoptimes"), diff.stale_rows(_changes(spark, d)))


# applying changes

_CORE = ["arrivalTime", "departureTime", "stopSequence", "headsign"]
_NARROW = fx.MAPPING.narrowed(["stoptimes"]).only_predicates([fx.TERMS + c for c in _CORE])


def _quads_of(cte: str, mapping: Mapping = _NARROW) -> str:
    return fx.quads_sql(["stoptimes"], {"stop_times": f"SELECT * FROM {cte}"}, mapping)


def _naive_sql(mapping: Mapping) -> str:
    return f"""WITH {_DIFF}, base AS ({_quads_of("st", mapping)}), delta AS (SELECT {', '.join(f'new_{c} AS {c}' for c in _COLUMNS)} FROM d WHERE change IN ('inserted', 'updated')),
stale AS (SELECT DISTINCT {_SUBJECT} AS s FROM (SELECT {', '.join(f'old_{c} AS {c}' for c in _COLUMNS)} FROM d WHERE change IN ('deleted', 'updated')) x),
added AS ({_quads_of("delta", mapping)}),
naive AS (SELECT * FROM base WHERE s NOT IN (SELECT s FROM stale) UNION ALL SELECT * FROM added)"""


_NAIVE = _naive_sql(_NARROW)


def _narrow(rows: DataFrame) -> DataFrame:
    return compile_mapping(_NARROW, {"stop_times": rows})


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The table before and after the feed, written: what reads them several times doesn't generate them again."""
    before = written(fx.table(spark, d, "stop_times"), "before")
    return before, written(changes.generate(before, fx.FEED)[0], "after")


def _apply_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    before, after = _snapshots(spark, d)
    found = written(diff.diff(before, after, fx.KEYS), "changes")
    stale = graph.subjects(fx.MAPPING.one("stoptimes"), diff.stale_rows(found))
    return before, after, found, stale, _narrow(diff.delta_rows(found))


@query(f"{_NAIVE} SELECT * FROM naive")
def apply_by_subject(spark: SparkSession, d: str) -> DataFrame:
    """Deletion by subject and addition of the delta."""
    before, _, _, stale, added = _apply_inputs(spark, d)
    return graph.apply_by_subject(_narrow(before), stale, added)


@query(f"WITH {_MARKED} {_quads_of('aft')}")
def apply_with_closure(spark: SparkSession, d: str) -> DataFrame:
    """The refreshed graph; the oracle is a rebuild."""
    before, after, found, _, _ = _apply_inputs(spark, d)
    return graph.refresh(_narrow(before), _NARROW, {"stop_times": found}, {"stop_times": after})


@query(f"""{_naive_sql(fx.MAPPING)}, full_graph AS ({_quads_of("aft", fx.MAPPING)})
SELECT (SELECT count(*) FROM (SELECT * FROM full_graph EXCEPT SELECT * FROM naive)) AS missing, (SELECT count(*) FROM (SELECT * FROM naive EXCEPT SELECT * FROM full_graph)) AS extra""")
def overdeletion(spark: SparkSession, d: str) -> DataFrame:
    """Quads, of all properties, that deletion by subject loses where rows share a subject."""
    before, after = _snapshots(spark, d)
    found = written(diff.diff(before, after, fx.KEYS), "changes")
    mapping = eliminate_joins(fx.MAPPING.narrowed(["stoptimes"]))
    m = mapping.one("stoptimes")
    stale = graph.subjects(m, diff.stale_rows(found))
    m, rows = graph.links_as_columns(m, mapping, fx.tables(spark, d, "trips", "stops"), [before, after, diff.delta_rows(found)])
    return graph.deletion_loss(m, rows[0], rows[1], stale, rows[2])


@query(f"WITH {_MARKED} SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, count(*) AS quads, count(DISTINCT s) AS subjects FROM ({_quads_of('aft')})")
def closure_equals_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Refresh against rebuild: nothing differs, and the graph is as large as the oracle's."""
    before, after, found, _, _ = _apply_inputs(spark, d)
    new = graph.refresh(_narrow(before), _NARROW, {"stop_times": found}, {"stop_times": after})
    return graph.difference(_narrow(after), new).crossJoin(new.agg(F.count("*").alias("quads"), F.countDistinct("s").alias("subjects")))  # one row each


@query(f"WITH {_MARKED} {_quads_of('aft')}")
def distributed_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A whole run with its checks: compare, deal out, split, refresh; the oracle is a rebuild."""
    before, after = _snapshots(spark, d)
    new, record = refresh.distributed(_narrow(before), _NARROW, "stop_times", {"stop_times": before}, {"stop_times": after}, fx.KEYS, "trip_id", K, THRESHOLD, FACTOR)
    if sum(record["task_rows"]) != record["delta_rows"]:
        raise AssertionError(record)
    return new


@query(f"""WITH {_DIFF}, base AS ({_quads_of("st")}), stale AS (SELECT DISTINCT {_SUBJECT} AS s FROM (SELECT {', '.join(f'old_{c} AS {c}' for c in _COLUMNS)} FROM d WHERE change IN ('deleted', 'updated')) x),
delta AS (SELECT {', '.join(f'new_{c} AS {c}' for c in _COLUMNS)} FROM d WHERE change IN ('inserted', 'updated'))
SELECT count(*) FILTER (WHERE s NOT IN (SELECT s FROM stale)) AS kept, count(*) FILTER (WHERE s IN (SELECT s FROM stale)) AS removed, (SELECT count(*) FROM ({_quads_of("delta")})) AS added FROM base""")
def apply_counts(spark: SparkSession, d: str) -> DataFrame:
    """Quads kept, removed and added."""
    before, _, _, stale, added = _apply_inputs(spark, d)
    return graph.apply_counts(_narrow(before), stale, added)


@query(fx.quads_sql(["trips", "routes"], {"routes": "SELECT * FROM (" + fx.SQL["routes"] + ") WHERE CAST(route_id AS BIGINT) % 20 <> 0"}))
def parent_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Deleted parents take their links from unchanged children; the oracle is a rebuild."""
    labels = ["trips", "routes"]
    mapping = fx.MAPPING.narrowed(labels)
    before = fx.tables(spark, d, *_sources(labels, fx.MAPPING))
    after = {**before, "routes": before["routes"].where("cast(route_id as bigint) % 20 <> 0")}
    found = diff.diff(before["routes"], after["routes"], ["route_id"])
    return graph.refresh(compile_mapping(mapping, before), mapping, {"routes": found}, after)


@query(f"WITH a AS ({fx.quads_sql(['agency'])}), b AS (SELECT * FROM a WHERE o <> 'KENYA' AND o <> 'CHINA') SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS extra")
def graph_equality(spark: SparkSession, d: str) -> DataFrame:
    """Quads that differ between two graphs, as bags."""
    a = _graph(spark, d, ["agency"])
    return graph.difference(a, a.where("o <> 'KENYA' and o <> 'CHINA'"))


# partitions and commits

_DELTA = f"delta AS (SELECT {', '.join(f'new_{c} AS {c}' for c in _COLUMNS)} FROM d WHERE change IN ('inserted', 'updated'))"
_ASSIGNED = f"WITH {_DIFF}, {_DELTA}, assigned AS (SELECT *, {_md5_sql('trip_id', K)} AS partition_id FROM delta)"
_HOT = "assigned AS (SELECT *, CASE WHEN CAST(trip_id AS BIGINT) % 3 <> 0 THEN 0 ELSE p END AS partition_id FROM (SELECT *, " + _md5_sql("trip_id", K) + " AS p FROM delta))"
_COUNTS = f"""counts AS (SELECT CAST(i AS INTEGER) AS partition_id, count(a.trip_id) AS row_count, CASE WHEN (SELECT count(*) FROM assigned) > 0 THEN count(a.trip_id) * CAST({K} AS DOUBLE) / (SELECT count(*) FROM assigned) ELSE 0 END AS skew
FROM range({K}) r(i) LEFT JOIN assigned a ON a.partition_id = i GROUP BY i)"""


def _assigned(spark: SparkSession, d: str, hot: bool = False) -> DataFrame:
    rows = partition.assign(diff.delta_rows(_changes(spark, d)), "trip_id", K)
    return rows.withColumn("partition_id", F.when(F.expr("cast(trip_id as bigint) % 3 <> 0"), 0).otherwise(F.col("partition_id"))) if hot else rows


@query(f"{_ASSIGNED}, {_COUNTS} SELECT * FROM counts")
def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and skew of each partition, empty ones included."""
    return partition.counts(_assigned(spark, d), K)


_PIECES = f"""WITH {_DIFF}, {_DELTA}, {_HOT}, {_COUNTS},
pieces AS (SELECT a.*, CASE WHEN c.skew > {THRESHOLD} AND c.row_count > 1 THEN CAST(ntile({FACTOR}) OVER (PARTITION BY a.partition_id ORDER BY a.trip_id, a.stop_id, a.supplier_id) - 1 AS INTEGER) END AS subpartition_id
  FROM assigned a JOIN counts c USING (partition_id))"""


@query(f"{_PIECES} SELECT partition_id, subpartition_id, count(*) AS row_count FROM pieces GROUP BY ALL")
def hot_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tasks after hot partitions are split evenly."""
    return partition.tasks(partition.split_hot(_assigned(spark, d, hot=True), K, THRESHOLD, FACTOR, fx.KEYS))


@query(f"""{_PIECES}, t AS (SELECT partition_id, subpartition_id, count(*) AS row_count FROM pieces GROUP BY ALL)
SELECT least(4, count(*) FILTER (WHERE row_count > 0)) AS barrier FROM t""")
def barrier_size(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that must be ready before commits begin."""
    split = partition.split_hot(_assigned(spark, d, hot=True), K, THRESHOLD, FACTOR, fx.KEYS)
    return partition.barrier_size(partition.tasks(split), 4)


_CONFLICTS = f"""{_ASSIGNED},
dealt AS (SELECT trip_id, stop_id, supplier_id, partition_id, false AS copied FROM assigned
  UNION ALL SELECT trip_id, stop_id, supplier_id, (partition_id + 1) % {K}, true FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || {_KEY})) - 1 AS r FROM assigned) WHERE r < (SELECT CAST(round_even(count(*) * 0.25, 0) AS BIGINT) FROM assigned))"""


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    return partition.inject_conflicts(_assigned(spark, d), K, 0.25, fx.KEYS).select(*fx.KEYS, "partition_id", "copied")


@query(f"{_CONFLICTS} SELECT * FROM dealt")
def conflict_injection(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the rows copied to the next partition."""
    return _conflicts(spark, d)


@query(f"{_CONFLICTS} SELECT a.partition_id AS task_a, b.partition_id AS task_b, count(*) AS shared_keys FROM dealt a JOIN dealt b ON a.trip_id = b.trip_id AND a.stop_id = b.stop_id AND a.supplier_id = b.supplier_id AND a.partition_id < b.partition_id GROUP BY ALL")
def overlapping_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose commits conflict."""
    return partition.overlapping_tasks(_conflicts(spark, d), fx.KEYS)


@query("""WITH c AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT name, n, n * 137 // sum(n) OVER () AS q, n * 137 % sum(n) OVER () AS r FROM c)
SELECT name, n, CAST(q + CASE WHEN row_number() OVER (ORDER BY r DESC, name) <= 137 - sum(q) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM s""")
def apportioned_quota(spark: SparkSession, d: str) -> DataFrame:
    """Largest-remainder quotas."""
    counts = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    return changes.apportion_frame(counts, "name", "n", 137)


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def commit_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Versions that serial commits write."""
    requests = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("task"))
    return commit.commit_in_order(requests).select("key", "task", F.col("version").cast("long").alias("version"))


@query("""WITH r AS (SELECT DISTINCT event_type AS task, user_id % 50 AS key FROM events), o AS (SELECT task, min(turn) = 1 AND max(turn) = 1 AS committed FROM (SELECT task, dense_rank() OVER (PARTITION BY key ORDER BY task) AS turn FROM r) GROUP BY task)
SELECT task, committed FROM o""")
def optimistic_round(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that commit in the first round of compare and set."""
    requests = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("task"), F.expr("user_id % 50").alias("key")).distinct().withColumn("expected", F.lit(0))
    versions = spark.createDataFrame([], "key long, version int")
    return commit.compare_and_set(versions, requests, ["task"])[1]


@query("""SELECT event_id AS task, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS attempts,
  CAST(count(*) OVER (PARTITION BY event_type) + CASE WHEN event_type = 'click' THEN 3 ELSE 0 END AS BIGINT) AS version FROM events""")
def commit_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of tasks that all want one of a few keys, one of which they read at an old version, and the keys' last versions."""
    requests = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("task"), F.col("event_type").alias("key"), F.lit(0).alias("expected"))
    final, done = commit.commit_all(spark.createDataFrame([("click", 3)], "key string, version int"), requests, ["task"])
    return requests.join(done, "task").join(final, "key").select("task", "attempts", F.col("version").cast("long").alias("version"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS version FROM events GROUP BY 1")
def version_store(spark: SparkSession, d: str) -> DataFrame:
    """Versions written by two runs, of which the highest counts."""
    path = new_path(spark, "versions")
    v = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"))
    commit.save_versions(v.where("version % 2 = 0"), path)
    commit.save_versions(v.where("version % 2 = 1"), path, keep=True)
    return commit.load_versions(spark, path)


@query("SELECT coalesce(c_custkey, o_custkey) AS key, c_custkey IS NOT NULL AS in_a, o_custkey IS NOT NULL AS in_b FROM customer FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0) ON c_custkey = o_custkey")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two tables and where they are."""
    a = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return partition.key_sets(a, spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")), ["key"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_report_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first report of each task."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return commit.first_report(e, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


# N-Quads

_TERM = "CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '\"' || replace(replace(replace(replace(replace(o, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"' || coalesce('^^<' || o_datatype || '>', '') END"
_LINES = f"SELECT '<' || s || '> <' || p || '> ' || {_TERM} || ' .' AS value FROM"


@query(f"{_LINES} ({fx.quads_sql(['stops', 'pages'])})")
def nquads_lines(spark: SparkSession, d: str) -> DataFrame:
    """N-Quads text of a graph."""
    return nquads.lines(_graph(spark, d, ["stops", "pages"]))


@query(f"SELECT DISTINCT split_part(value, ' ', 1) AS subject FROM ({_LINES} ({fx.quads_sql(['stops'])}))")
def nquads_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of N-Quads lines."""
    return nquads.lines(_graph(spark, d, ["stops"])).select(nquads.subject_of(F.col("value")).alias("subject")).distinct()


_LITERALS = "SELECT 'http://example.org/c/' || conv_id || '-' || turn AS s, 'http://example.org/text' AS p, text AS o, 'literal' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype FROM conversations WHERE text <> ''"


@query(_LITERALS)
def nquads_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Literals with quotes and line ends, written as text and parsed again."""
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text <> ''")
    quads = c.select(
        F.concat(F.lit("http://example.org/c/"), "conv_id", F.lit("-"), "turn").alias("s"), F.lit("http://example.org/text").alias("p"),
        F.col("text").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"),
    )
    return nquads.parse_lines(nquads.lines(quads))


# metrics

_REPORTS = "SELECT CAST(user_id % 4 AS INTEGER) AS partition_id, event_type AS worker, CAST(round(value * 10) AS BIGINT) AS mapped_ms, event_id AS finished_ms, CASE WHEN event_id % 3 = 0 THEN 1 END AS retries, CASE WHEN event_id % 5 = 0 THEN event_id % 50 END AS lock_wait_ms FROM events"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.expr("cast(user_id % 4 as int)").alias("partition_id"), F.col("event_type").alias("worker"), F.round(F.col("value") * 10).cast("long").alias("mapped_ms"),
        F.col("event_id").alias("finished_ms"), F.expr("case when event_id % 3 = 0 then 1 end").alias("retries"), F.expr("case when event_id % 5 = 0 then event_id % 50 end").alias("lock_wait_ms"),
    )


@query(f"""SELECT partition_id, CAST(sum(mapped_ms) AS BIGINT) AS mapped_ms, max(finished_ms) AS finished_ms, string_agg(DISTINCT worker, ',' ORDER BY worker) AS workers,
  CAST(sum(coalesce(retries, 0)) AS BIGINT) AS retries, CAST(sum(coalesce(lock_wait_ms, 0)) AS BIGINT) AS lock_wait_ms FROM ({_REPORTS}) GROUP BY partition_id""")
def partition_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Time, last finish, workers, retries and waits by partition."""
    return metrics.partition_metrics(_reports(spark, d))


@query(f"""SELECT worker, CAST(sum(mapped_ms) AS BIGINT) AS load_ms FROM ({_REPORTS}) GROUP BY worker""")
def worker_loads(spark: SparkSession, d: str) -> DataFrame:
    """Load by worker."""
    return metrics.worker_loads(_reports(spark, d))


@query(f"SELECT CAST(max(m) - min(m) AS BIGINT) AS duration_spread, max(f) - min(f) AS finish_spread FROM (SELECT partition_id, sum(mapped_ms) AS m, max(finished_ms) AS f FROM ({_REPORTS}) GROUP BY 1)")
def load_spread(spark: SparkSession, d: str) -> DataFrame:
    """Spread of time and finish over partitions."""
    m = metrics.partition_metrics(_reports(spark, d))
    return m.agg(metrics.spread("mapped_ms").alias("duration_spread"), metrics.spread("finished_ms").alias("finish_spread"))


_RUNS = "SELECT user_id % 5 AS p_code, user_id AS seed, CAST(count(*) AS DOUBLE) AS seconds FROM events WHERE event_type {} 'click' GROUP BY ALL"


def _runs(spark: SparkSession, d: str, clicks: bool) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == "click" if clicks else F.col("event_type") != "click")
    return e.groupBy(F.expr("user_id % 5").alias("p_code"), F.col("user_id").alias("seed")).agg(F.count("*").cast("double").alias("seconds"))


@query(f"SELECT p_code, seed, a.seconds AS single_s, b.seconds AS other_s, a.seconds / b.seconds AS speedup, (1 - b.seconds / a.seconds) * 100 AS reduction_pct FROM ({_RUNS.format('<>')}) a JOIN ({_RUNS.format('=')}) b USING (p_code, seed)")
def paired_speedup(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of paired runs."""
    return metrics.paired(_runs(spark, d, False), _runs(spark, d, True), ["p_code", "seed"])


@query(f"SELECT p_code, seed, 'single' AS only_in FROM (SELECT p_code, seed FROM ({_RUNS.format('<>')}) EXCEPT SELECT p_code, seed FROM ({_RUNS.format('=')})) UNION ALL SELECT p_code, seed, 'other' FROM (SELECT p_code, seed FROM ({_RUNS.format('=')}) EXCEPT SELECT p_code, seed FROM ({_RUNS.format('<>')}))")
def unpaired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs without a counterpart."""
    return metrics.unpaired(_runs(spark, d, False), _runs(spark, d, True), ["p_code", "seed"])


@query("""WITH r AS (SELECT o_orderstatus AS mode, o_custkey % 7 AS p, o_orderkey AS seed, CAST(o_custkey AS DOUBLE) AS a, CAST(o_orderkey % 97 AS DOUBLE) AS b FROM orders),
s AS (SELECT * FROM r QUALIFY seed <> min(seed) OVER (PARTITION BY mode, p))
SELECT mode, p, count(*) AS runs, round(avg(a), 6) AS a_mean, round(coalesce(stddev_samp(a), 0), 6) AS a_sd, round(avg(b), 6) AS b_mean, round(coalesce(stddev_samp(b), 0), 6) AS b_sd FROM s GROUP BY mode, p""")
def steady_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations per group without the first run."""
    runs = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderstatus").alias("mode"), F.expr("o_custkey % 7").alias("p"), F.col("o_orderkey").alias("seed"), F.col("o_custkey").cast("double").alias("a"), F.expr("o_orderkey % 97").cast("double").alias("b")
    )
    out = metrics.summarise(runs, ["mode", "p"], ["a", "b"], steady="seed")
    return out.select("mode", "p", "runs", *[F.round(c, 6).alias(c) for c in ("a_mean", "a_sd", "b_mean", "b_sd")])


@query("SELECT user_id, count(DISTINCT event_type) AS distinct_values FROM events GROUP BY user_id HAVING count(DISTINCT event_type) <> 1")
def broken_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Groups in which a constant isn't."""
    return metrics.one_value(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "event_type")


@query(f"{_PIECES}, t AS (SELECT partition_id, subpartition_id, count(*) AS row_count FROM pieces GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY coalesce(subpartition_id, 0), partition_id) AS turn FROM t")
def dispatch_order(spark: SparkSession, d: str) -> DataFrame:
    """Turns in which tasks are handed out."""
    split = partition.split_hot(_assigned(spark, d, hot=True), K, THRESHOLD, FACTOR, fx.KEYS)
    return partition.dispatch_order(partition.tasks(split))


@query(f"{_PIECES}, t AS (SELECT partition_id, subpartition_id, count(*) AS row_count FROM pieces GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY partition_id, coalesce(subpartition_id, -1)) AS turn FROM t")
def merge_order(spark: SparkSession, d: str) -> DataFrame:
    """Turns in which tasks' outputs are put together."""
    split = partition.split_hot(_assigned(spark, d, hot=True), K, THRESHOLD, FACTOR, fx.KEYS)
    return partition.merge_order(partition.tasks(split))


@query("SELECT key, value FROM (SELECT event_type AS key, CAST(event_id AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS value FROM events)")
def log_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Log lines parted at their first colon."""
    line = F.concat("event_type", F.lit(": "), F.col("event_id").cast("string"), F.lit(":"), F.col("user_id").cast("string"))
    return logs.pairs(spark.read.parquet(f"{d}/events.parquet").select(line.alias("value")))


@query("""SELECT event_id % 100 AS run, CAST(event_id AS VARCHAR) AS id, CAST(user_id % 4 AS INTEGER) AS partition_id, CAST(NULL AS INTEGER) AS subpartition_id, user_id AS rows, event_id AS mapped_ms, event_id + user_id AS mapped_finished_at_ms, event_type AS worker FROM events""")
def json_task_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Task metrics written as JSON arrays and read back."""
    task = F.struct(
        F.col("event_id").cast("string").alias("id"), F.expr("cast(user_id % 4 as int)").alias("partition_id"), F.lit(None).cast("int").alias("subpartition_id"),
        F.col("user_id").alias("rows"), F.col("event_id").alias("mapped_ms"), (F.col("event_id") + F.col("user_id")).alias("mapped_finished_at_ms"), F.col("event_type").alias("worker"),
    )
    runs = spark.read.parquet(f"{d}/events.parquet").groupBy(F.expr("event_id % 100").alias("run")).agg(F.to_json(F.collect_list(task)).alias("tasks"))
    return logs.task_metrics(runs, "tasks")


@query("SELECT event_id % 100 AS run, CAST(min_by(user_id, event_id) FILTER (WHERE event_type = 'click') AS VARCHAR) AS value FROM events GROUP BY 1")
def first_log_value(spark: SparkSession, d: str) -> DataFrame:
    """First value of a key in each run's log."""
    lines = spark.read.parquet(f"{d}/events.parquet").select(
        F.expr("event_id % 100").alias("run"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("position")
    )
    return lines.groupBy("run").agg(logs.first_value(lines, "click").alias("value"))


# files and reports


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations WHERE text <> ''")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Cells with quotes, commas and line ends, written as CSV and read as a snapshot."""
    folder = new_path(spark, "snapshot")
    snapshots.write_csv(spark.read.parquet(f"{d}/conversations.parquet").where("text <> ''").select("conv_id", "turn", "role", "text"), f"{folder}/turns.txt")
    return snapshots.read_snapshot(spark, folder, snapshots.table_names(spark, folder))[snapshots.resolve("TURNS.csv", ["turns"])]


@query("SELECT 'customer' AS table_name, count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE customer)) AS column_count FROM customer UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM (DESCRIBE orders)) FROM orders")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of tables."""
    return snapshots.shape({n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "orders")}).withColumn("column_count", F.col("column_count").cast("long"))


@query("SELECT DISTINCT source FROM documents WHERE trim(source) <> ''")
def distinct_cells(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of a column that aren't blank."""
    return snapshots.distinct_values(spark.read.parquet(f"{d}/documents.parquet"), "source")


@query(fx.quads_sql(["stops", "pages"]))
def nquads_files(spark: SparkSession, d: str) -> DataFrame:
    """A graph written as N-Quads files and read again."""
    path = new_path(spark, "nquads")
    nquads.write(_graph(spark, d, ["stops", "pages"]), path)
    return nquads.read(spark, path)


@query(f"SELECT DISTINCT s FROM ({fx.quads_sql(['stops', 'agency'])})")
def iri_lists(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of two kinds in one list of IRIs, written and read."""
    path = new_path(spark, "iris")
    nquads.write_iris(_graph(spark, d, ["stops"]).select("s"), path)
    nquads.write_iris(_graph(spark, d, ["agency"]).select("s"), path, append=True)
    return nquads.read_iris(spark, path)


@query(fx.quads_sql(["trips"]))
def turtle_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The graph of a mapping that was written as Turtle and parsed."""
    mapping = turtle.parse(turtle.serialise(fx.MAPPING)).narrowed(["trips"])
    return compile_mapping(mapping, fx.tables(spark, d, *_sources(["trips"], fx.MAPPING)))


@query("""SELECT 'routes' AS child, 'agency' AS parent, 'keep' AS rule, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS dangling,
  (SELECT count(*) FROM customer) * (SELECT count(*) FROM nation) AS pairs, (SELECT count(*) FROM customer) * (SELECT count(*) FROM nation) >= 5000000 AS warn
UNION ALL SELECT 'stops', 'stops', 'E1', (SELECT count(DISTINCT p_partkey - p_partkey % 10) FROM part WHERE p_partkey - p_partkey % 10 NOT IN (SELECT p_partkey FROM part)), (SELECT count(*) * count(*) FROM part), false""")
def join_costs(spark: SparkSession, d: str) -> DataFrame:
    """Each join's rule, dangling values, and pairs that nested loops would compare."""
    mapping = Mapping.of([fx.MAPPING.one(label) for label in ("routes", "stops", "agency")])
    rows = join_report(mapping, fx.tables(spark, d, *_sources(["routes", "stops"], fx.MAPPING)))
    return spark.createDataFrame([{k: r[k] for k in ("child", "parent", "rule", "dangling", "pairs", "warn")} for r in rows], "child string, parent string, rule string, dangling long, pairs long, warn boolean")


@query("""WITH a AS (SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS sum_a FROM orders GROUP BY 1), b AS (SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS sum_b FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, sum_a, sum_b FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey WHERE sum_a IS DISTINCT FROM sum_b""")
def unequal_sums(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose totals differ between two runs' tables."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return metrics.unequal_sums(orders, orders.where("o_orderkey % 7 <> 0"), ["o_custkey"], "o_orderkey")


@query("SELECT event_id, printf('%.3f', event_id / 8.0) AS eighths, CASE WHEN event_id % 2 = 0 THEN '' ELSE printf('%.1f', CAST(event_id AS DOUBLE)) END AS odd FROM events")
def shown_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as reports print them."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") / 8.0).alias("x"), F.expr("case when event_id % 2 = 1 then event_id end").alias("y"))
    return e.select("event_id", metrics.shown("x").alias("eighths"), metrics.shown("y", 1).alias("odd"))


@query("SELECT event_id, CAST((event_id * 37) % 7200 AS DOUBLE) AS seconds, event_id / 1024.0 AS mb FROM events")
def time_reports(spark: SparkSession, d: str) -> DataFrame:
    """Elapsed time and peak memory from whole ``time -v`` reports."""
    n = F.expr("(event_id * 37) % 7200")
    clock = F.format_string("%d:%02d:%02d", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)
    report = F.concat(F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), clock, F.lit("\n\tMaximum resident set size (kbytes): "), F.col("event_id").cast("string"), F.lit("\n"))
    elapsed, kb = logs.timings(report)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.elapsed_seconds(elapsed).alias("seconds"), scalars.kb_to_mb(kb).alias("mb"))


@query("SELECT 'orders' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'note', 'a: b' UNION ALL SELECT 'sizes', '[1, 2]'")
def run_log_files(spark: SparkSession, d: str) -> DataFrame:
    """A run's metrics written as a log and read by key."""
    path = new_path(spark, "run-log")
    logs.write_run_log(spark, {"orders": spark.read.parquet(f"{d}/orders.parquet").count(), "note": "a: b", "sizes": [1, 2]}, path)
    return logs.read_logs(spark, path).select("key", "value")


@query(f"SELECT 'md5' AS partition_hash, CAST({K} AS BIGINT) AS partition_k, 0.75 AS partition_skew_p, count(*) AS delta_rows FROM orders")
def manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    """A manifest written as JSON and read back with its fields checked."""
    path = new_path(spark, "manifest")
    logs.write_manifest(spark, {"partition_hash": "md5", "partition_k": K, "partition_skew_p": 0.75, "delta_rows": spark.read.parquet(f"{d}/orders.parquet").count()}, path)
    return spark.createDataFrame([logs.read_json_sidecar(spark, path)], "partition_hash string, partition_k long, partition_skew_p double, delta_rows long")


@query(f"{_PIECES} SELECT partition_id, subpartition_id, count(*) AS row_count, count(DISTINCT (trip_id, stop_id, supplier_id)) AS keys FROM pieces GROUP BY ALL")
def partition_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows and keys of each task, written to files of their own and read back."""
    path = new_path(spark, "partitions")
    partition.write_partitions(partition.split_hot(_assigned(spark, d, hot=True), K, THRESHOLD, FACTOR, fx.KEYS), fx.KEYS, path)
    by = ["partition_id", "subpartition_id"]
    rows = spark.read.parquet(f"{path}/rows").groupBy(*by).agg(F.count("*").alias("row_count"))
    keys = spark.read.text(f"{path}/keys").groupBy(*by).agg(F.countDistinct("value").alias("keys"))
    same = (rows.partition_id == keys.partition_id) & rows.subpartition_id.eqNullSafe(keys.subpartition_id)
    return rows.join(keys, same).select(rows.partition_id, rows.subpartition_id, "row_count", "keys")


@query("SELECT o_custkey AS task, o_orderkey, c_nationkey AS partition_id FROM orders JOIN customer ON c_custkey = o_custkey")
def matched_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports with their task's specification."""
    reports = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("task"), "o_orderkey")
    return commit.matched(reports, spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("partition_id")))


@query(fx.quads_sql(["routes"]))
def rebound_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The graph of a mapping whose source was given another name."""
    mapping = fx.MAPPING.narrowed(["routes"]).rebound({"routes": "ROUTES_NEW.csv"})
    tables = fx.tables(spark, d, "routes", "agency")
    return refresh.reconstruct(mapping, {"routes_new": tables["routes"], "agency": tables["agency"]})


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT DISTINCT user_id FROM events")
def streamed_first_reports(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose first report a stream let through, once each."""
    path = new_path(spark, "first-reports")
    first = streams.first_reports(_streamed(spark, d), "user_id", "ts", "36500 days").select("user_id")
    first.writeStream.option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return spark.read.parquet(path)


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and kind, counted by a stream, one micro-batch after another."""
    path = new_path(spark, "windows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    # files of a stream come once; the counts of its last batch are those of all
    counts = streams.windowed_counts(_streamed(spark, d), "ts", "event_type")
    writer = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", new_path(spark, "stream"))
    writer.trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(path)
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
