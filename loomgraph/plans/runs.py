"""Whole runs: GFA files to tables, and queries to distances and outliers."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import grouped_digits as spaced
from ..operators import counts, distances, graph, links, outliers
from ..scratch import materialize, narrow
from ..sources import gfa as gfa_source
from ..sources import sinks, tables
from ..sources.errors import InputError
from .options import Mode, Options

log = logging.getLogger(__name__)


def parse_gfa(spark: SparkSession, path: str | list[str], stem: str) -> gfa_source.Gfa:
    """Parse GFA1 files and write <stem>.edges .unitigs .fasta .counts .paths and <stem>_paths/<reference>.edges .counts.

    Files per reference are written with one pass over all genomes, as folders ``reference=<name>``, as the listing has them.
    """
    found = gfa_source.read_gfa(spark, path)
    if found.segments.isEmpty() and not found.paths.isEmpty():
        raise InputError([(None, "paths, but no segments")])
    log.info("%s segments, %s links, %s references, %s path lines", *(spaced(x.count()) for x in (found.segments, found.links, found.references, found.paths)))
    sinks.write_lines(sinks.link_lines(found.links), f"{stem}.edges", ["from_id", "seq"])
    sinks.write_lines(sinks.unitig_lines(found.segments), f"{stem}.unitigs", ["id"])
    if found.references.isEmpty():
        return found
    per_genome = materialize(counts.unitig_counts(found.paths), "counts")
    n = found.segments.count()
    strings = found.references.join(counts.presence_strings(per_genome, n), "ref_id", "left").withColumn("presence", F.coalesce("presence", F.expr(f"repeat('a', {n})")))
    fasta = counts.fasta_rows(strings, "sequence", keep=("ref_id",))
    sinks.write_lines(fasta.select("ref_id", F.col("fasta").alias("value")), f"{stem}.fasta", ["ref_id"])
    sinks.write_lines(sinks.count_lines(counts.max_counts(per_genome)), f"{stem}.counts", ["unitig"])
    names = found.references.select("ref_id", "reference")
    along = materialize(gfa_source.genome_links(found).join(narrow(names), "ref_id"), "genome-links")
    _write_by_reference(along.select("reference", F.col("from_id").alias("a"), F.col("seq").alias("b"), sinks.link_text().alias("value")), f"{stem}_paths/edges")
    often = per_genome.filter("cnt > 1").join(narrow(names), "ref_id")
    _write_by_reference(often.select("reference", F.col("unitig").alias("a"), F.lit(0).alias("b"), F.concat_ws(" ", "unitig", "cnt").alias("value")), f"{stem}_paths/counts")
    # A listing is as long as there are genomes, and its files are opened from the driver; so it may as well be made there.
    listed = names.join(along.select("ref_id").distinct().withColumn("there", F.lit(True)), "ref_id", "left").orderBy("ref_id").collect()
    paths = [f"{stem}_paths/edges/{sinks.partition_folder(spark, 'reference', r.reference)}" for r in listed]
    for r, p in zip(listed, paths):
        if not r.there:
            sinks.empty_table(spark, p)
    sinks.write_lines(spark.createDataFrame(list(enumerate(paths)), "ref_id long, value string"), f"{stem}.paths", ["ref_id"])
    return found


def _write_by_reference(lines: DataFrame, path: str) -> None:
    """lines (reference, a, b, value) as text in folders by reference, each in the order of a and b over its parts.

    A range of (reference, a, b) goes to a task, so a genome with most of the lines is split.
    """
    order = ["reference", "a", "b"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("reference", "value").write.mode("overwrite").partitionBy("reference").text(path)


@dataclass
class Results:
    """What a run found; None where a stage didn't run."""

    main: DataFrame | None = None
    genomes: DataFrame | None = None
    main_outliers: DataFrame | None = None
    genome_outliers: DataFrame | None = None
    thresholds: dict[str, outliers.Thresholds] = field(default_factory=dict)


def main_graph(spark: SparkSession, options: Options) -> DataFrame:
    """The edges of the graph that the options name; empty graphs are errors."""
    if Mode.GENERAL in options.mode:
        edges = graph.ordinary_graph(tables.read_edges(spark, options.edges_file), options.graph_one_based)
    else:
        weights = graph.self_weights(tables.read_unitigs(spark, options.unitigs_file, options.k), options.k)
        edges = graph.two_sided_graph(weights, links.nonzero_overlap(tables.read_links(spark, options.edges_file, options.graph_one_based)))
    edges = materialize(edges, "main-graph")
    if edges.isEmpty():
        raise InputError([(None, "the graph is empty")])
    if log.isEnabledFor(logging.INFO):
        size = graph.summary(edges, Mode.GENERAL not in options.mode).first()
        log.info("graph: %s nodes, %s edges, average degree %s, largest degree %s", spaced(size.n_nodes), spaced(size.n_edges), size.avg_degree, size.max_degree)
    return edges


def genome_graphs(spark: SparkSession, options: Options) -> DataFrame:
    weights = graph.self_weights(tables.read_unitigs(spark, options.unitigs_file, options.k), options.k)
    kept = links.nonzero_overlap(tables.read_genome_links(spark, options.genomes_file, options.graph_one_based))
    edges = materialize(graph.genome_graphs(weights, kept), "genome-graphs")
    if edges.isEmpty():
        raise InputError([(None, "the graphs of all genomes are empty")])
    if log.isEnabledFor(logging.INFO):
        size = graph.average_size(edges).first()
        log.info("graphs of genomes: %.2f nodes, %.2f edges on average", size.avg_nodes, size.avg_edges)
    return edges


def _outliers(spark: SparkSession, found: DataFrame, options: Options, kind: str, results: Results, means: bool, write: bool) -> DataFrame | None:
    if "score" not in found.columns:
        log.warning("queries without scores have no outliers")
        return None
    settings = options.settings if means else replace(options.settings, count_threshold=0 if Mode.OUTLIERS != options.mode else options.settings.count_threshold)
    pairs = found if "cnt" in found.columns else found.withColumn("cnt", F.lit(1).cast("bigint"))
    thresholds = outliers.find_thresholds(pairs, settings)
    results.thresholds[kind] = thresholds
    log.info("%s: cutoff %s, outliers from %g, extreme ones from %g, background of %s vertices", kind, thresholds.ld_distance, thresholds.outlier, thresholds.extreme, spaced(thresholds.coverage))
    got = materialize(outliers.collect_outliers(pairs, thresholds, settings.count_threshold), "outliers")
    if write and not got.isEmpty():
        sinks.write_lines(sinks.distance_lines(got, means, options.output_one_based), options.output_name(f"{kind}_outliers"), ["qid"])
        sinks.write_lines(sinks.stats_line(outliers.outlier_stats(spark, thresholds, settings.count_threshold)), options.output_name(f"{kind}_outlier_stats"), ["qid"])
    return got


def run(spark: SparkSession, options: Options, write: bool = True) -> Results:
    """Distances over genomes, then in the main graph, and outliers of each if wanted."""
    results = Results()
    only = options.mode == Mode.OUTLIERS
    queries = materialize(tables.read_queries(spark, options.queries_file, options.queries_format, options.n_queries, options.queries_one_based, only), "queries")
    if queries.isEmpty():
        raise InputError([(None, "there are no queries")])
    log.info("mode %s, %s queries, columns %s", options.mode, spaced(queries.count()), ", ".join(queries.columns))
    if only:
        stored = distances.single_moments(queries.withColumn("distance", F.when(F.col("distance") >= 0, F.col("distance"))))
        results.main_outliers = _outliers(spark, stored, options, "ud", results, False, write)
        return results
    if Mode.GENOMES in options.mode:
        found = distances.genome_moments(queries.drop("cnt"), genome_graphs(spark, options), "genome", options.max_distance)
        results.genomes = materialize(found, "genome-distances")
        if write:
            sinks.write_lines(sinks.distance_lines(results.genomes, True, options.output_one_based), options.output_name("ud_sgg"), ["qid"])
        if options.outliers:
            results.genome_outliers = _outliers(spark, results.genomes, options, "ud_sgg", results, True, write)
    if not options.genomes_only:
        edges = main_graph(spark, options)
        found = distances.single_moments(distances.main_distances(queries.drop("cnt"), edges, Mode.GENERAL not in options.mode, options.max_distance))
        results.main = materialize(found, "main-distances")
        if write:
            sinks.write_lines(sinks.distance_lines(results.main, False, options.output_one_based), options.output_name("ud"), ["qid"])
        if options.outliers:
            results.main_outliers = _outliers(spark, results.main, options, "ud", results, False, write)
    return results
