"""Command line: load | query | stats | strings | generate | shuffle.

    python -m strail.cli generate --output U -n 100000 -m 1000 -l 100
    python -m strail.cli load --input U --output I --layout str_lf
    python -m strail.cli query --index I -r 0,500,0,500,0,MAX -l 1,2 -r MIN,MAX,MIN,MAX,MIN,MAX -l 3
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from strail.operators import index as I
from strail.operators import joins as J
from strail.operators import prune as P
from strail.operators import query as Q
from strail.operators import stats as K
from strail.schema import IndexConfig
from strail.sources import units as U


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strail")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="random walks")
    g.add_argument("--output", required=True)
    for short, name, default in (("-n", "--units", 100_000), ("-m", "--per-trajectory", 1000), ("-l", "--labels", 1000), ("-x", "--width", 1000), ("-y", "--height", 1000), ("-s", "--seed", 1)):
        g.add_argument(short, name, type=int, default=default)
    load = sub.add_parser("load", help="build an index")
    load.add_argument("--input", required=True)
    load.add_argument("--output", required=True)
    load.add_argument("--layout", default="str_lf")
    load.add_argument("--beta", type=float, default=0.5)
    load.add_argument("--beta-mode", default="normal")
    load.add_argument("--id-set", default="exact")
    load.add_argument("--leaf-fanout", type=int, default=113)
    load.add_argument("--internal-fanout", type=int, default=127)
    load.add_argument("--lambda", dest="lambda_", type=int, default=40)
    load.add_argument("--offset", type=int, default=0)
    load.add_argument("--limit", type=int)
    q = sub.add_parser("query", help="a sequenced query; repeat -r and -l pairwise")
    q.add_argument("--index", required=True)
    q.add_argument("-r", "--rect", action="append", default=[])
    q.add_argument("-l", "--labels", action="append", default=[])
    q.add_argument("--monotone", action="store_true", help="time never runs backwards: prune by time windows")
    q.add_argument("--stats", action="store_true", help="counts and duration as JSON instead of units")
    for name in ("stats", "dump"):
        sub.add_parser(name).add_argument("--index", required=True)
    s = sub.add_parser("strings", help="the label dictionary")
    s.add_argument("--input", required=True)
    s.add_argument("--json", action="store_true")
    x = sub.add_parser("shuffle", help="permute trajectory ids")
    x.add_argument("--input", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--seed", type=int, default=1)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strail").getOrCreate()
    begun = time.perf_counter()
    if a.command == "generate":
        U.write_units(U.random_walk(spark, a.units, a.per_trajectory, a.labels, a.width, a.height, a.seed), a.output)
    elif a.command == "load":
        units = U.read_units(spark, a.input)
        if a.offset or a.limit is not None:
            units = U.offset_limit(units, a.offset, a.limit)
        config = IndexConfig(a.layout, a.leaf_fanout, a.internal_fanout, a.lambda_, a.id_set, a.beta, a.beta_mode)
        index = I.build(units, config)
        I.save(index, a.output)
        print(json.dumps({"units": index.size, "height": index.height, "duration": time.perf_counter() - begun}))
    elif a.command == "query":
        index = I.open_index(spark, a.index)
        matches = P.find_pruned(index, Q.parse_query(a.rect, a.labels), a.monotone)
        if a.stats:
            row = Q.counts(matches).first()
            print(json.dumps({"units": row["units"], "trajectories": row["trajectories"], "duration": time.perf_counter() - begun, "leaf_fanout": index.config.leaf_fanout, "internal_fanout": index.config.internal_fanout}))
        else:
            last, n = None, 0
            for r in Q.as_text(matches).orderBy("trajectory_id", "unit_index").toLocalIterator():
                if r["trajectory_id"] != last:
                    last, n = r["trajectory_id"], n + 1
                    print(f"Trajectory {last}:")
                print(f"  {r['line']}")
            print(f"Found {n} trajectories.")
    elif a.command == "stats":
        print(K.tree_stats(I.open_index(spark, a.index)).toJSON().first())
    elif a.command == "dump":
        for r in I.dump_text(I.open_index(spark, a.index)).toLocalIterator():
            print(r["line"])
    elif a.command == "strings":
        labels = spark.read.parquet(a.input)
        if a.json:
            print(I.dictionary_json(labels).first()["json"])
        else:
            for r in I.dictionary_text(labels).collect():
                print(r["label_id"], r["name"])
    elif a.command == "shuffle":
        U.write_units(J.shuffle_ids(U.read_units(spark, a.input), a.seed), a.output)


if __name__ == "__main__":
    main()
