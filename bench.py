"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import statistics
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

ROOT = Path(__file__).resolve().parent
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, str(ROOT))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from quadweave import fixtures as fx  # noqa: E402
from quadweave.mapping.compile import compile_mapping  # noqa: E402
from quadweave.mapping.rewrite import eliminate_joins  # noqa: E402
from quadweave.operators import changes, diff, graph, partition  # noqa: E402
from quadweave.tables import written  # noqa: E402

REPEATS = 3


def main() -> None:
    """Time each query (median of REPEATS after a warm run), inputs cached as a maintained graph's would be."""
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="quadweave-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, list[float]] = {}

    def done(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    def time_all(queries: dict[str, Callable[[], DataFrame]]) -> None:
        """A warm run of each, then REPEATS rounds in an order that changes from round to round."""
        for at in range(REPEATS + 1):
            names = list(queries)
            random.Random(at).shuffle(names)
            for name in names:
                began = time.perf_counter()
                done(queries[name]())
                if at:
                    found.setdefault(name, []).append(time.perf_counter() - began)

    def cached(df: DataFrame) -> DataFrame:
        df = df.persist()
        df.count()
        return df

    mapping = eliminate_joins(fx.MAPPING.narrowed(["stoptimes"]))
    names = sorted({m.source for m in mapping.maps.values()})
    before = {n: cached(df) for n, df in fx.tables(spark, sf, *names).items()}
    # before the graph is cached: Spark would answer an equal plan from the cache
    time_all({"rebuild": lambda: compile_mapping(mapping, before), "rebuild_with_joins": lambda: compile_mapping(fx.MAPPING.narrowed(["stoptimes"]), before)})
    base = cached(compile_mapping(mapping, before))
    for percent in (10, 25, 50):
        feed = changes.Feed(fx.KEYS, fx.FEED.times, "trip_id", percent / 100, 1)
        # a snapshot comes from files
        new = cached(written(changes.generate(before["stop_times"], feed)[0], "snapshot"))
        after = {**before, "stop_times": new}
        some = cached(diff.diff(before["stop_times"], new, fx.KEYS))
        time_all(
            {
                f"rebuild_{percent}": lambda after=after: compile_mapping(mapping, after),
                f"diff_{percent}": lambda new=new: diff.diff(before["stop_times"], new, fx.KEYS),
                f"refresh_{percent}": lambda after=after, some=some: graph.refresh(base, mapping, {"stop_times": some}, after),
                # the whole plan: compare, write the changes, refresh
                f"incremental_{percent}": lambda after=after, new=new: graph.refresh(
                    base, mapping, {"stop_times": written(diff.diff(before["stop_times"], new, fx.KEYS), "changes")}, after
                ),
            }
        )
        if percent == 50:
            rows = cached(partition.assign(diff.delta_rows(some), "trip_id", 4))
            time_all({"skewed_split": lambda rows=rows: partition.split_hot(rows, 4, 1.7, 4, fx.KEYS)})
            rows.unpersist()
        some.unpersist()
        new.unpersist()
    times = {name: round(statistics.median(seconds), 3) for name, seconds in found.items()}
    print(json.dumps({"metric": "seconds, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
