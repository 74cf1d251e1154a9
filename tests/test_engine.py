"""Units and invariants of the knowledge-graph engine."""

import hashlib
import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from quadweave import fixtures as fx
from quadweave import queries
from quadweave.functions import scalars, terms
from quadweave.mapping import turtle
from quadweave.mapping.compile import compile_mapping
from quadweave.mapping.ir import Constant, Join, Mapping, PredicateObjects, Reference, Template, TriplesMap
from quadweave.mapping.rewrite import COST_LIMIT, eliminate_joins, join_report, verdict
from quadweave.operators import changes, commit, diff, graph, metrics, partition
from quadweave.plans import refresh
from quadweave.sources import logs, nquads, snapshots
from quadweave.tables import written


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def bag(df):
    return sorted(map(tuple, df.select("s", "p", "o", "o_kind", "o_datatype").collect()), key=str)


def test_iri_encode(spark):
    texts = ["a b", "x:y*~+/?", "é日本", "", "A-z_0.9~"]
    got = [r[0] for r in column(spark, texts).select(terms.iri_encode(F.col("v"))).collect()]
    assert got == [quote(t, safe="") for t in texts]


def test_templates(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", ""), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(terms.render("u/{a}-{b}!", {"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == ["u/1-a%20b!", None, None]
    assert terms.rename_variables("{a}{b}", {"a": "c"}) == "{c}{b}"


@pytest.mark.parametrize("k", [1, 2, 7, 1000, 2**31 - 1])
def test_md5_mod(spark, k):
    texts = ["", "1", "trip-77", "é"]
    got = [r[0] for r in column(spark, texts).select(scalars.md5_mod(F.col("v"), k)).collect()]
    assert got == [int(hashlib.md5(t.encode()).hexdigest(), 16) % k for t in texts]


def test_shift_time(spark):
    df = column(spark, ["23:59:30", "25:00:00", "0:00:10", "", "1:60:00", None, "100:00:00"])
    assert [r[0] for r in df.select(scalars.shift_time(F.col("v"), 60)).collect()] == ["24:00:30", "25:01:00", "00:01:10", None, None, None, "100:01:00"]
    assert [r[0] for r in df.select(scalars.shift_time(F.col("v"), -60)).collect()][2] == "00:00:00"


def test_fresh_key(spark):
    got = [r[0] for r in column(spark, ["12", "x", ""]).select(scalars.fresh_key(F.col("v"), 3)).collect()]
    assert got == ["1000015", "x_new3", "_new3"]


def test_turtle_round_trip():
    assert turtle.parse(turtle.serialise(fx.MAPPING)) == Mapping(
        {
            k: TriplesMap(m.label, m.source, m.subject, m.properties) for k, m in fx.MAPPING.maps.items()
        }
    )


def test_turtle_reads_nodes_and_blank_nodes():
    text = """
    @prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ex: <http://e/> .
    ex:trips a rr:TriplesMap ; rdfs:label "trips" ; rml:logicalSource ex:src ; rr:subjectMap ex:s ; rr:predicateObjectMap ex:po1, ex:po2 .
    ex:src rml:source "TRIPS.csv"^^xsd:string . # a comment
    ex:s rr:template "http://x/{id}" ; rr:class ex:Trip .
    ex:po1 rr:predicateMap [ rr:constant ex:p ] ; rr:objectMap [ rml:reference "a" ; rr:datatype xsd:integer ; rr:termType rr:Literal ] .
    ex:po2 rr:predicate ex:q ; rr:objectMap [ rr:parentTriplesMap ex:routes ; rr:joinCondition [ rr:child "r" ; rr:parent "rid" ] ] .
    ex:routes rdfs:label "routes" ; a rr:TriplesMap ; rml:logicalSource [ rml:source "ROUTES.csv" ] ; rr:subjectMap [ rr:template "http://x/r/{rid}" ] .
    """
    m = turtle.parse(text)
    trips = m.one("trips")
    assert trips.source == "TRIPS.csv" and trips.subject.text == "http://x/{id}"
    assert trips.properties[0].objects == (Constant("http://e/Trip"),)
    assert trips.properties[1].objects == (Reference("a", "literal", "http://www.w3.org/2001/XMLSchema#integer"),)
    assert trips.properties[2].objects == (Join("routes", (("r", "rid"),)),)
    with pytest.raises(KeyError):
        m.one("none")
    with pytest.raises(ValueError):
        turtle.parse("<a> <b> %%% .")


def test_source_lookup():
    assert snapshots.resolve("STOP_TIMES.csv", ["stop_times.txt", "trips.txt"]) == "stop_times.txt"
    with pytest.raises(LookupError):
        snapshots.resolve("x.csv", ["y"])
    assert fx.MAPPING.subject_template("stop_times") == fx.MAPPING.one("stoptimes").subject.text
    with pytest.raises(LookupError):
        fx.MAPPING.subject_template("s")
    with pytest.raises(LookupError):
        fx.MAPPING.rebound({"nowhere": "x"})


def test_join_rules():
    m = fx.MAPPING
    assert verdict(m.one("stoptimes"), m.one("trips"), Join("trips", (("trip_id", "trip_id"),))) == "E1"
    assert verdict(m.one("shapes"), m.one("shape_points"), Join("shape_points", (("shape_id", "shape_id"),))) == "E2"
    assert verdict(m.one("routes"), m.one("agency"), Join("agency", (("agency_id", "agency_id"),))) == "keep"
    stop = eliminate_joins(m).one("stops").properties[-1].objects[0]
    assert stop.template.text.endswith("{parent_station}") and stop.semi


def test_join_report(spark):
    t = {"c": spark.createDataFrame([("1", "x"), ("2", "z"), ("3", "")], "id string, r string"), "p": spark.createDataFrame([("x", "n")], "r string, name string")}
    m = Mapping.of(
        [
            TriplesMap("child", "c", Template("c/{id}"), (PredicateObjects("q", (Join("parent", (("r", "r"),)),)),)),
            TriplesMap("parent", "p", Template("p/{name}")),
        ]
    )
    (row,) = join_report(m, t)
    assert row["rule"] == "keep" and row["dangling"] == 1 and row["pairs"] == 3 < COST_LIMIT and not row["warn"]
    assert bag(compile_mapping(m, t)) == [("c/1", "q", "p/n", "iri", None)]


def test_diff_and_duplicates(spark):
    before = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "k string, v string")
    after = spark.createDataFrame([("1", "a"), ("2", "c"), ("4", "d"), ("3", None)], "k string, v string")
    got = {(r.change, r.old and r.old.k, r.new and r.new.k) for r in diff.diff(before, after, ["k"]).collect()}
    assert got == {("updated", "2", "2"), ("inserted", None, "4")}
    assert diff.duplicate_keys(before.union(before), ["k"]).count() == 3
    some = diff.diff_snapshots({"t": before, "gone": before, "feed": before}, {"t": after, "new": after, "feed": after}, {"t": ["k"], "gone": ["k"], "new": ["k"], "feed": []})
    assert set(some) == {"t", "gone", "new"}
    assert {r.change for r in some["gone"].collect()} == {"deleted"} and {r.change for r in some["new"].collect()} == {"inserted"}
    with pytest.raises(KeyError):
        diff.diff(before, after, ["nope"])


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("ratio", [0.05, 0.5])
def test_refresh_equals_rebuild(spark, seed, ratio):
    labels = ["stoptimes", "trips", "routes"]
    mapping = fx.MAPPING.narrowed(labels)
    names = sorted({m.source for m in mapping.maps.values()})
    before = {n: df.persist() for n, df in fx.tables(spark, "/root/testdata/sf0.001", *names).items()}
    feed = changes.Feed(fx.KEYS, fx.FEED.times, "trip_id", ratio, seed)
    after = {**before, "stop_times": changes.generate(before["stop_times"], feed)[0].persist()}
    after["routes"] = before["routes"].where(f"cast(route_id as bigint) % 7 <> {seed}")
    found = {"stop_times": diff.diff(before["stop_times"], after["stop_times"], fx.KEYS), "routes": diff.diff(before["routes"], after["routes"], ["route_id"])}
    got = graph.refresh(compile_mapping(mapping, before), mapping, found, after)
    assert graph.difference(got, compile_mapping(mapping, after)).first().asDict() == {"missing": 0, "extra": 0}


def test_incremental_plan(spark):
    mapping = fx.MAPPING.narrowed(["routes"])
    before = fx.tables(spark, "/root/testdata/sf0.001", "routes", "agency")
    after = {**before, "routes": before["routes"].where("route_id <> '5'")}
    got = refresh.incremental(refresh.reconstruct(mapping, before), mapping, before, after, {"routes": ["route_id"]})
    assert bag(got) == bag(refresh.reconstruct(mapping, after, verify_references=True))
    gone = refresh.incremental(refresh.reconstruct(mapping, before), mapping, before, {"routes": before["routes"]}, {"routes": ["route_id"], "agency": ["agency_id"]})
    assert bag(gone) == bag(refresh.reconstruct(mapping, {**before, "agency": before["agency"].limit(0)}))


def test_partitioned_delta_is_independent_of_dealing(spark):
    before = fx.table(spark, "/root/testdata/sf0.001", "stop_times").persist()
    found = diff.diff(before, changes.generate(before, fx.FEED)[0], fx.KEYS).persist()
    mapping = fx.MAPPING.narrowed(["stoptimes"]).only_predicates([fx.TERMS + "arrivalTime"])

    def quads(rows):
        return compile_mapping(mapping, {"stop_times": rows})

    want = bag(quads(diff.delta_rows(found)))
    for k, threshold in ((1, None), (4, None), (4, 0.5)):
        got, tasks = refresh.partitioned_delta(found, "trip_id", k, quads, threshold, 3, fx.KEYS)
        assert bag(got) == want
        assert tasks.agg(F.sum("row_count")).first()[0] == diff.delta_rows(found).count()


def test_quotas():
    assert changes.plan(100, 0.1) == changes.Quotas(2, 2, 2, 4)
    assert changes.plan(25, 0.1).mapped + changes.plan(25, 0.1).delete == 2  # half to even
    assert changes.apportion({"b": 1, "a": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert changes.apportion({"a": 0}, 3) == {"a": 0}
    forced, split = changes.skewed_quotas(changes.Quotas(10, 10, 10, 12), 0.5)
    assert forced == 16 == sum(split.values())
    with pytest.raises(ValueError):
        changes.plan(3, 0)


def test_generate_is_deterministic_and_exact(spark):
    base = fx.table(spark, "/root/testdata/sf0.001", "stop_times").persist()
    a, log = changes.generate(base, fx.FEED)
    b, _ = changes.generate(base.repartition(7), fx.FEED)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    n = changes.plan(base.count(), 0.1)
    assert {r["op"]: r["count"] for r in log.groupBy("op").count().collect()} == {"insert": n.insert, "delete": n.delete, "update": n.update, "composite": n.composite}
    after, log = changes.generate(base, fx.FEED, changes.Skew("trip_id", 4, 0.75))
    assert after.count() == base.count() - n.delete + n.insert
    home = scalars.md5_mod(F.split("old_key", r"\|")[0], 4) == 0
    forced = changes.skewed_quotas(n, 0.75)[1]
    got = {r["op"]: r["n"] for r in log.where(home).where("op in ('update', 'composite')").groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert got == {"update": forced["update"], "composite": forced["composite"]}
    with pytest.raises(ValueError):
        changes.generate(base, changes.Feed(fx.KEYS, fx.FEED.times, "trip_id", 1.0, 1), changes.Skew("trip_id", 1000, 1.0))


def hot_rows(spark):
    """Nine rows of partition 0 of 2 and one of partition 1."""
    names = [f"t{i}" for i in range(200)]
    home = {h: [n for n in names if int(hashlib.md5(n.encode()).hexdigest(), 16) % 2 == h] for h in (0, 1)}
    return spark.createDataFrame([(t, str(i)) for i, t in enumerate(home[0][:9] + home[1][:1])], "trip_id string, stop_sequence string")


def test_hot_partition_split(spark):
    rows = partition.assign(hot_rows(spark), "trip_id", 2)
    assert sorted((r.partition_id, r.row_count) for r in partition.counts(rows, 2).collect()) == [(0, 9), (1, 1)]
    split = partition.split_hot(rows, 2, 1.7, 2, ["trip_id"])
    assert sorted((r.partition_id, r.subpartition_id, r.row_count) for r in partition.tasks(split).collect() if r.partition_id == 0) == [(0, 0, 5), (0, 1, 4)]
    assert partition.tasks(split).count() == 3
    partition.conserved(split, 10)
    with pytest.raises(AssertionError):
        partition.conserved(split, 11)
    partition.require_unique(rows, ["trip_id", "stop_sequence"])
    with pytest.raises(ValueError):
        partition.require_unique(rows.union(rows), ["trip_id"])
    assert sorted(r.row_count for r in partition.tasks(partition.split_hot(rows, 2, 9.0, 4, ["trip_id"])).collect()) == [1, 9]
    assert sorted(r.row_count for r in partition.tasks(partition.split_hot(rows, 2, 1.7, 4, ["trip_id"])).collect()) == [1, 2, 2, 2, 3]


def test_conflicts_and_barrier(spark):
    rows = partition.assign(hot_rows(spark), "trip_id", 2)
    dealt = partition.inject_conflicts(rows, 2, 0.25, ["trip_id", "stop_sequence"])
    assert dealt.where("copied").count() == 2  # two and a half, half to even
    assert partition.overlapping_tasks(dealt, ["trip_id", "stop_sequence"]).first().shared_keys == 2
    assert partition.inject_conflicts(partition.assign(rows.drop("partition_id"), "trip_id", 1), 1, 0.5, ["trip_id"]).count() == 10
    tasks = spark.createDataFrame([(5,), (0,), (1,)], "row_count long")
    assert partition.barrier_size(tasks, 4).first().barrier == 2 and partition.barrier_size(tasks, 1).first().barrier == 1


def test_commits(spark):
    versions = spark.createDataFrame([("k1", 3)], "key string, version int")
    requests = spark.createDataFrame([("a", "k1", 3), ("a", "k2", 0), ("b", "k2", 0), ("c", "k3", 0), ("d", "k1", 2)], "task string, key string, expected int")
    new, outcome = commit.compare_and_set(versions, requests, ["task"])
    assert {r.task: r.committed for r in outcome.collect()} == {"a": True, "b": False, "c": True, "d": False}
    assert {r.key: r.version for r in new.collect()} == {"k1": 4, "k2": 1, "k3": 1}
    final, done = commit.commit_all(versions, requests, ["task"])
    assert {r.key: r.version for r in final.collect()} == {"k1": 5, "k2": 2, "k3": 1}
    assert {r.task: r.attempts for r in done.collect()} == {"a": 1, "b": 2, "c": 1, "d": 2}


def test_commits_of_many_tasks_against_single_rounds(spark):
    import random

    rnd = random.Random(4)
    wants = {t: sorted(rnd.sample("abcde", rnd.choice([1, 1, 2]))) for t in range(40)} | {t: ["hot"] for t in range(100, 160)}
    read = {(t, k): rnd.choice([0, 0, 0, 1]) for t, ks in wants.items() for k in ks}
    requests = spark.createDataFrame([(t, k, v) for (t, k), v in read.items()], "task long, key string, expected int")
    final, done = commit.commit_all(spark.createDataFrame([], "key string, version int"), requests, ["task"])
    left, versions, attempts, at = dict(wants), {}, {}, 0
    while left:
        at += 1
        won = [t for t, ks in left.items() if all(min(o for o, other in left.items() if k in other) == t and (at > 1 or read[t, k] == 0) for k in ks)]
        for t in won:
            attempts[t] = at
            for k in left.pop(t):
                versions[k] = versions.get(k, 0) + 1
    assert {r.task: r.attempts for r in done.collect()} == attempts and max(attempts.values()) > 20
    assert {r.key: r.version for r in final.collect()} == versions


def test_tables_that_repeat_keys(spark):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 3), ("2", "c", 4)], "k string, v string, place int")
    assert diff.diff(df, df, ["k"], position=["place"]).isEmpty() and diff.diff(df, df, ["k"], position=[]).isEmpty()
    (row,) = diff.diff(df, df.where("place <> 2"), ["k"], position=["place"]).collect()
    assert (row.change, row.old.v, row.new.v) == ("updated", "b", "a")
    assert diff.duplicate_totals(df, ["k"]).first().asDict() == {"groups": 2, "rows": 4, "lost": 2}
    assert diff.diff_snapshots({"t": df}, {"t": df}, {"t": ["k"]})["t"].isEmpty()


def test_runs_record_phases_and_check_rows(spark):
    before = fx.tables(spark, "/root/testdata/sf0.001", "routes", "agency")
    after = {**before, "routes": before["routes"].where("route_id <> '5'").withColumn("route_type", F.when(F.col("route_id") == "7", "X").otherwise(F.col("route_type")))}
    mapping = fx.MAPPING.narrowed(["routes"])
    new, record = refresh.distributed(compile_mapping(mapping, before), mapping, "routes", before, after, ["route_id"], "route_id", 4)
    assert graph.difference(new, compile_mapping(mapping, after)).first().asDict() == {"missing": 0, "extra": 0}
    assert (record["delta_rows"], record["stale_rows"], record["task_rows"]) == (1, 2, [1]) and {"diff_s", "partition_s", "refresh_s"} <= record.keys()


def test_tasks_map_the_rows_that_were_dealt_to_them(spark, monkeypatch):
    before = hot_rows(spark).select("trip_id", F.lit("g").alias("g"), "stop_sequence", F.lit("whole").alias("piece"))
    # one row stays, and shares its subject with all that change; of two rows with a key the last counts as changed
    fixed = spark.createDataFrame([("fixed", "g", "x", "whole"), ("twice", "g", "a", "whole")], before.schema)
    twice = spark.createDataFrame([("twice", "g", "b", "whole")], before.schema)
    before, after = before.union(fixed), before.withColumn("stop_sequence", F.lit("new")).union(fixed).union(twice)
    properties = tuple(PredicateObjects(f"http://p/{c}", (Reference(c),)) for c in ("trip_id", "stop_sequence", "piece"))
    mapping = Mapping.of([TriplesMap("m", "t", Template("http://x/{g}"), properties)])

    def run(threshold):
        return refresh.distributed(compile_mapping(mapping, {"t": before}), mapping, "t", {"t": before}, {"t": after}, ["trip_id"], "trip_id", 2, threshold, 3)

    want = bag(compile_mapping(mapping, {"t": after}))
    whole, split = run(None), run(1.5)
    assert bag(whole[0]) == bag(split[0]) == want
    assert split[1]["tasks"] > whole[1]["tasks"] and sum(split[1]["task_rows"]) == sum(whole[1]["task_rows"]) == 11
    found, real = [], partition.split_hot

    def marked(*args):
        found.append(written(real(*args).withColumn("piece", F.coalesce(F.concat(F.lit("piece "), "subpartition_id"), "piece")), "split"))
        return found[0]

    monkeypatch.setattr(partition, "split_hot", marked)
    pieces = {r.o for r in run(1.5)[0].where("p = 'http://p/piece'").collect()}
    assert pieces == {"piece 0", "piece 1", "piece 2", "whole"}
    sizes = partition.by_task(found[0]).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in sizes) == sorted(split[1]["task_rows"])


def test_maps_that_share_no_subject_are_not_read(spark):
    m = fx.MAPPING
    assert graph.may_share_subjects(m.one("services1"), m.one("services2")) and not graph.may_share_subjects(m.one("trips"), m.one("routes"))
    assert graph.affected_maps(m, ["routes"]) == ["trips", "routes"]


def test_reports_and_versions(spark, tmp_path):
    reports = spark.createDataFrame([("a", 1), ("b", 2)], "task string, ms int")
    specs = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "task string, partition_id int")
    assert commit.matched(reports, specs).count() == 2
    with pytest.raises(LookupError):
        commit.matched(reports, specs.where("task = 'c'"))
    path = str(tmp_path / "versions")
    commit.save_versions(spark.createDataFrame([("k", 3)], "key string, version int"), path)
    commit.save_versions(spark.createDataFrame([("k", 4), ("l", 1)], "key string, version int"), path, keep=True)
    assert {r.key: r.version for r in commit.load_versions(spark, path).collect()} == {"k": 4, "l": 1}
    logs.write_manifest(spark, {"partition_hash": "md5", "partition_k": 4, "partition_skew_p": 0.5, "delta_rows": 3}, str(tmp_path / "m.json"))
    assert logs.read_json_sidecar(spark, str(tmp_path / "m.json"))["partition_k"] == 4
    logs.write_manifest(spark, {"a": 1}, str(tmp_path / "n.json"))
    with pytest.raises(ValueError):
        logs.read_json_sidecar(spark, str(tmp_path / "n.json"))
    assert logs.read_scalar(spark, str(tmp_path / "none")) is None
    split = partition.split_hot(partition.assign(hot_rows(spark), "trip_id", 2), 2, 1.7, 2, ["trip_id"])
    partition.write_partitions(split, ["trip_id", "stop_sequence"], str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts/rows")).count() == spark.read.text(str(tmp_path / "parts/keys")).count() == 10


def test_nquads(spark, tmp_path):
    quads = spark.createDataFrame(
        [("http://a", "http://p", 'say "hi"\\\n\tnow', "literal", None), ("http://a", "http://q", "http://o", "iri", None), ("http://b", "http://p", "5", "literal", "http://int")],
        "s string, p string, o string, o_kind string, o_datatype string",
    )
    path = str(tmp_path / "graph")
    nquads.write(quads, path)
    assert bag(nquads.read(spark, path)) == bag(quads)
    assert all(re.fullmatch(r"<[^>]*> <[^>]*> .* \.", r.value) for r in nquads.lines(quads).collect())
    nquads.write_iris(quads.select("s").distinct(), str(tmp_path / "iris"))
    nquads.write_iris(quads.select("s").limit(1), str(tmp_path / "iris"), append=True)
    assert sorted(r.s for r in nquads.read_iris(spark, str(tmp_path / "iris")).collect()) == ["http://a", "http://b"]
    assert nquads.empty_iris(spark).isEmpty()


def test_csv_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c'), ("2", "line\nbreak"), ("3", "")], "k string, v string")
    snapshots.write_csv(df, str(tmp_path / "t.txt"))
    back = snapshots.read_snapshot(spark, str(tmp_path), snapshots.table_names(spark, str(tmp_path)))["t"]
    assert {(r.k, r.v or "") for r in back.collect()} == {(r.k, r.v) for r in df.collect()}
    assert snapshots.shape({"t": back}).first().row_count == 3
    assert snapshots.distinct_values(back, "v").count() == 2
    logs.write_run_log(spark, {"k": 4, "partition_rows": [1, 2], "note": "a: b"}, str(tmp_path / "run.log"))
    got = {r.key: r.value for r in logs.read_logs(spark, str(tmp_path / "run.log")).collect()}
    assert got == {"k": "4", "partition_rows": "[1, 2]", "note": "a: b"}
    assert snapshots.environment(spark, [str(tmp_path / "run.log")]).first().length > 0
    report = column(spark, ["\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n\tMaximum resident set size (kbytes): 2048\n"])
    elapsed, kb = logs.timings(F.col("v"))
    row = report.select(scalars.elapsed_seconds(elapsed).alias("s"), scalars.kb_to_mb(kb).alias("mb")).first()
    assert (row.s, row.mb) == (62.5, 2.0)


def test_metrics(spark):
    runs = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 3.0)], "g string, seed int, x double")
    got = {r.g: (r.runs, r.x_mean, r.x_sd) for r in metrics.summarise(runs, ["g"], ["x"]).collect()}
    assert got["b"] == (1, 3.0, 0.0) and got["a"][:2] == (2, 3.0)
    assert {r.g for r in metrics.summarise(runs, ["g"], ["x"], steady="seed").collect()} == {"a"}


def test_streaming(spark, tmp_path):
    from quadweave.streaming import refresh as streams

    source = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(source).schema
    folder = tmp_path / "in"
    spark.read.parquet(source).write.parquet(str(folder))
    seen = []
    q = streams.refresh_stream(spark.readStream.schema(schema).parquet(str(folder)), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == spark.read.parquet(source).count()
    counts = streams.latest_versions(spark.readStream.schema(schema).parquet(str(folder)), "user_id")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("versions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("versions").agg(F.sum("version")).first()[0] == sum(seen)
    first = streams.first_reports(spark.readStream.schema(schema).parquet(str(folder)), "user_id", "ts", "10000 days")
    q = first.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == spark.read.parquet(source).select("user_id").distinct().count()


def test_windowed_stream(spark, tmp_path):
    from quadweave.streaming import refresh as streams

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    counts = streams.windowed_counts(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), "ts", "event_type")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == source.count()


def test_quads_of_a_map_without_joins_are_not_shuffled(spark):
    rows = spark.createDataFrame([("1", "a", "x"), ("1", "b", "x"), ("2", "", None)], "k string, v string, w string")
    m = TriplesMap("m", "t", Template("http://x/{k}"), (PredicateObjects("http://p/v", (Reference("v"),)), PredicateObjects("http://p/w", (Reference("w"),))))
    made = compile_mapping(Mapping.of([m]), {"t": rows})
    assert sorted((r.s, r.p, r.o) for r in made.collect()) == [("http://x/1", "http://p/v", "a"), ("http://x/1", "http://p/v", "b"), ("http://x/1", "http://p/w", "x")]
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])
    assert len(shuffles) == 1 and shuffles[0].startswith("subject of row")


def test_graph_difference_is_of_bags(spark):
    quad = ("s", "p", "o", "iri", None)
    a, b = (spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string") for rows in ([quad, quad, ("t", *quad[1:])], [quad, ("u", *quad[1:])]))
    assert tuple(graph.difference(a, b).first()) == (2, 1) and tuple(graph.difference(a, a).first()) == (0, 0)
    assert tuple(graph.difference(a.limit(0), b.limit(0)).first()) == (0, 0)


@pytest.mark.parametrize("size", [0, 64 << 20])
def test_deletion_loss_counts_quads_of_all_properties(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "BROADCAST_BYTES", size)
    columns = "trip_id string, stop_id string, supplier_id string, stop_sequence string, arrival_time string, departure_time string, pickup_type string, headsign string, distance string"
    time = ("00:00:01", "00:00:02")
    stays = [("1", "1", "a", "1", *time, "N", "", "5"), ("1", "1", "b", "2", *time, "R", "O", None), ("3", "1", "a", "3", *time, "", "O", "6"), ("4", "9", "a", "4", *time, "N", "O", "7")]
    before = spark.createDataFrame([*stays, ("1", "1", "c", "1", *time, "A", "F", "8"), ("3", "1", "c", "3", *time, "A", "F", "9"), ("2", "2", "c", "3", *time, "A", "F", "9")], columns)
    after = spark.createDataFrame([*stays, ("1", "1", "c", "1", *time, "A", "F", "9"), ("9", "1", "c", "1", *time, "A", "F", "8")], columns)
    parents = {"trips": spark.createDataFrame([("1",), ("2",), ("4",), ("",)], "trip_id string"), "stops": spark.createDataFrame([("1",), ("2",)], "stop_id string")}
    found = diff.diff(before, after, fx.KEYS)
    mapping = eliminate_joins(fx.MAPPING.narrowed(["stoptimes"]))
    stale = graph.subjects(mapping.one("stoptimes"), diff.stale_rows(found))

    def quads(rows):
        return compile_mapping(mapping, {"stop_times": rows, **parents})

    want = graph.difference(quads(after), graph.apply_by_subject(quads(before), stale, quads(diff.delta_rows(found))).distinct()).first().asDict()
    m, rows = graph.links_as_columns(mapping.one("stoptimes"), mapping, parents, [before, after, diff.delta_rows(found)])
    assert graph.deletion_loss(m, rows[0], rows[1], stale, rows[2]).first().asDict() == want
    # of 1-1: a's distance and pickup type, b's sequence and pickup type, headsign O; all of 3-1, which has no trip
    assert want == {"missing": 5 + 7, "extra": 0}
    with pytest.raises(ValueError):
        graph.links_as_columns(fx.MAPPING.one("routes"), fx.MAPPING, {}, [])


def test_overdeletion_covers_the_whole_map(spark):
    before, after = (df.persist() for df in queries._snapshots(spark, "/root/testdata/sf0.001"))
    found = diff.diff(before, after, fx.KEYS)
    mapping = fx.MAPPING.narrowed(["stoptimes"])
    parents = fx.tables(spark, "/root/testdata/sf0.001", "trips", "stops")
    base, full, added = (compile_mapping(mapping, {"stop_times": rows, **parents}) for rows in (before, after, diff.delta_rows(found)))
    want = graph.difference(full, graph.apply_by_subject(base, graph.subjects(mapping.one("stoptimes"), diff.stale_rows(found)), added).distinct())
    assert queries.overdeletion(spark, "/root/testdata/sf0.001").first().asDict() == want.first().asDict()


def test_written_tables_leave_no_shuffle_files(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert tracker.shuffleStatuses().size() <= before
