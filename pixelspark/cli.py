"""python -m pixelspark.cli process|info|bench|bench-out-of-core|bench-ordering FILES..."""

from __future__ import annotations

import argparse
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from pixelspark import api
from pixelspark.config import ALGORITHMS, ClusteringConfig, ExtractionConfig
from pixelspark.operators import clustering, extraction
from pixelspark.sources import sinks, tpx3


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pixelspark")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output", required=True)
    b, o = sub.add_parser("bench"), sub.add_parser("bench-out-of-core")
    for s in (p, b, o):
        s.add_argument("--algorithm", default="all" if s is b else "abs")
        s.add_argument("--radius", type=float, default=5.0)
        s.add_argument("--window-ns", type=float, default=75.0)
        s.add_argument("--min-cluster-size", type=int, default=1)
    p.add_argument("--super-resolution", type=float, default=8.0)
    p.add_argument("--min-tot", type=int, default=10)
    for s, n in ((b, 5), (o, 3), (sub.add_parser("bench-ordering"), 3)):
        s.add_argument("inputs", nargs=1)
        s.add_argument("--iterations", type=int, default=n)
    o.add_argument("--memory-fraction", type=float, default=0.5)
    o.add_argument("--memory-budget-bytes", type=int)
    sub.add_parser("info").add_argument("inputs", nargs=1)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "info":
        print(tpx3.metadata(a.inputs[0]))
        for row in extraction.file_info(api.read_hits(spark, a.inputs[0])).collect():
            print(row.asDict())
        return 0
    config = None if a.command == "bench-ordering" else ClusteringConfig(a.radius, a.window_ns, a.min_cluster_size)
    if a.command == "process":
        found = None
        for path in a.inputs:
            one = api.process_neutrons(spark, path, None, config, ExtractionConfig(a.super_resolution, True, a.min_tot), algorithm=a.algorithm)
            found = one if found is None else found.unionByName(one)
        sinks.write_neutrons(found, a.output)
        return 0
    path = a.inputs[0]
    if a.command == "bench-ordering":
        words = tpx3.metadata(path)["packet_count"]
        took = timed(lambda: run(api.read_hits(spark, path)), a.iterations)
        print(f"{summary(took)}, {words / min(took) / 1e3:.2f} M words/s, {words / min(took) / 1e3 / spark.sparkContext.defaultParallelism:.2f} per core")
        return 0
    if a.command == "bench-out-of-core":
        memory = {k: v for k, v in (("memory_fraction", a.memory_fraction), ("memory_budget_bytes", a.memory_budget_bytes)) if v is not None}
        whole = timed(lambda: run(api.process_neutrons(spark, path, None, config, algorithm=a.algorithm)), a.iterations)
        cut = timed(lambda: run(api.process_neutrons(spark, path, None, config, algorithm=a.algorithm, out_of_core=True, **memory)), a.iterations)
        print(f"whole pulses: {summary(whole)}")
        print(f"slices: {summary(cut)}")
        print(f"ratio: {statistics.mean(whole) / statistics.mean(cut):.2f}x")
        return 0
    hits = api.read_hits(spark, path).cache()
    print(f"{hits.count()} hits, {a.iterations} iterations")
    for name in ALGORITHMS if a.algorithm == "all" else (a.algorithm,):
        took = timed(lambda name=name: run(clustering.cluster_hits(hits, config, name)), a.iterations)
        print(f"{name:<10} {summary(took)}")
    hits.unpersist()
    return 0


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work, iterations: int) -> list[float]:
    """Milliseconds of each run after one to warm up."""
    work()
    took = []
    for _ in range(iterations):
        began = time.perf_counter()
        work()
        took.append((time.perf_counter() - began) * 1000)
    return took


def summary(took: list[float]) -> str:
    return f"mean {statistics.mean(took):.2f} ms, min {min(took):.2f} ms, max {max(took):.2f} ms"


if __name__ == "__main__":
    raise SystemExit(main())
