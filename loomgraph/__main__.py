"""Command line: ``python -m loomgraph parse IN.gfa STEM`` and ``python -m loomgraph distances -E ... -Q ...``."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from .functions.scalars import elapsed
from .plans import runs
from .plans.options import Options


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("parse", help="GFA1 files to unitigs, edges, counts, presence and genome paths")
    p.add_argument("gfa")
    p.add_argument("stem")
    d = commands.add_parser("distances", help="distances of vertex pairs, and outliers among them")
    add = d.add_argument
    add("-E", "--edges-file", default="")
    add("-U", "--unitigs-file", default="")
    add("-k", "--k-mer-length", dest="k", type=int, default=0)
    add("-S", "--sgg-paths-file", dest="genomes_file", default="")
    add("-Q", "--queries-file", default="")
    add("-o", "--output-stem", default="out")
    add("-n", "--n-queries", type=int, default=-1)
    add("-q", "--queries-format", type=int, default=-1)
    add("-d", "--max-distance", type=float, default=float("inf"))
    add("-t", "--threads", type=int, default=None, help="cores of a local session; a cluster's own setting otherwise")
    add("-Cc", "--sgg-count-threshold", dest="count_threshold", type=int, default=10)
    add("-l", "--ld-distance", type=int, default=-1)
    add("-lm", "--ld-distance-min", type=int, default=1000)
    add("-ls", "--ld-distance-score", type=float, default=0.8)
    add("-ln", "--ld-distance-nth-score", type=int, default=10)
    add("-ot", "--outlier-threshold", type=float, default=-1.0)
    add("-1g", "--graphs-one-based", dest="graph_one_based", action="store_true")
    add("-1q", "--queries-one-based", action="store_true")
    add("-1o", "--output-one-based", action="store_true")
    add("-1", "--all-one-based", action="store_true")
    add("-r", "--run-sggs-only", dest="genomes_only", action="store_true")
    add("-x", "--output-outliers", dest="outliers", action="store_true")
    add("-v", "--verbose", action="store_true")
    return top


def options(args: argparse.Namespace) -> Options:
    given = {k: v for k, v in vars(args).items() if k not in ("command", "threads", "all_one_based", "verbose")}
    if args.all_one_based:
        given |= dict(graph_one_based=True, queries_one_based=True, output_one_based=True)
    return Options(**given)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    given = options(args) if args.command == "distances" else None
    if getattr(args, "verbose", False):
        logging.basicConfig(level=logging.INFO)
    builder = SparkSession.builder.appName(f"loomgraph-{args.command}")
    if getattr(args, "threads", None):
        builder = builder.master(f"local[{args.threads}]")
    spark = builder.getOrCreate()
    began = time.time()
    if given is None:
        runs.parse_gfa(spark, args.gfa, args.stem)
    else:
        runs.run(spark, given)
    logging.getLogger(__name__).info("done in %s", elapsed(time.time() - began))


if __name__ == "__main__":
    main()
