"""The star schema read as genomes: an order is a path through parts, a nation is a genome.

Segments and unitigs are parts (sequence: the name, k = 5), steps are line items in order, the line status is the
orientation, the quantity the overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, links
from ..scratch import materialize, scratch_path

K = 5
#: Parts for one source of the queries' pairs, and a source's targets.
PARTS_PER_SOURCE, N_TARGETS = 100, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A step's columns; steps of a path are in their order.
STEP = ("l_linenumber", "seg", "l_suppkey", "l_extendedprice", "orient", "overlap")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, *STEP)"""
    orient = F.when(F.col("l_linestatus") == "F", "-").otherwise("+").alias("orient")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("path"), "l_linenumber", F.col("l_partkey").cast("bigint").alias("seg"), "l_suppkey", "l_extendedprice", orient, F.col("l_quantity").cast("bigint").alias("overlap"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, genome)"""
    found = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return found.select(F.col("o_orderkey").cast("bigint").alias("path"), F.col("c_nationkey").cast("bigint").alias("genome"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome, path, steps, overlaps): steps array<struct<seg, orient>>."""
    walks = steps(spark, sf_dir).select("path", F.struct(*STEP).alias("s")).groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("s"))
    along = F.expr("transform(s, x -> struct(x.seg AS seg, x.orient AS orient))")
    return walks.join(owners(spark, sf_dir), "path").select("genome", "path", along.alias("steps"), F.col("s.overlap").alias("overlaps"))


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome, path, pos, from_id, to_id, from_orient, to_orient, overlap)"""
    return links.adjacency(paths(spark, sf_dir)).withColumnsRenamed({"from_seg": "from_id", "to_seg": "to_id"})


def canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome, path, pos, overlap, from_id, to_id, edge_type)"""
    return links.canonical(raw_links(spark, sf_dir))


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("unitig"), F.col("p_name").alias("sequence"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.self_weights(unitigs(spark, sf_dir), K)


def main_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = canonical_links(spark, sf_dir).select("from_id", "to_id", "edge_type").distinct()
    return graph.two_sided_graph(weights(spark, sf_dir), kept)


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, a, b) of all links, as often as they stand in paths. Steps that differ in their overlap only join the same sides."""
    minus = (F.col("orient") == "-").alias("minus")
    order = (*STEP[:-2], "minus")
    return links.adjacent_sides(steps(spark, sf_dir).select("path", *STEP[:-2], minus), order)


def main_links(spark: SparkSession, sf_dir: str) -> graph.Links:
    """The graph of main_edges, not built."""
    return graph.Links(_sides(spark, sf_dir).join(owners(spark, sf_dir), "path", "left_semi").select("a", "b"), weights(spark, sf_dir))


def genome_links(spark: SparkSession, sf_dir: str) -> graph.Links:
    """The graphs of genome_edges, not built."""
    return graph.Links(_sides(spark, sf_dir).join(owners(spark, sf_dir), "path").select("genome", "a", "b"), weights(spark, sf_dir))


def genome_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A graph reads its links twice, for the edges and for the unitigs that they name, and takes equal ones as one.
    found = links.adjacent_rows(steps(spark, sf_dir), STEP).join(owners(spark, sf_dir), "path")
    found = links.canonical(found, "from_seg", "to_seg")
    kept = materialize(found.select("genome", "from_id", "to_id", "edge_type"), "genome-links")
    return graph.genome_graphs(weights(spark, sf_dir), kept)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, v, w, score): N_TARGETS pairs for each PARTS_PER_SOURCE parts, some of a vertex with itself."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_retailprice").alias("price"))
    n = parts.agg((F.max("id") + 1).alias("n"))
    n_pairs = F.ceil(F.col("n") / PARTS_PER_SOURCE) * N_TARGETS
    grid = n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), n_pairs - 1)).alias("qid"))
    i, j = F.floor(F.col("qid") / N_TARGETS), F.col("qid") % N_TARGETS
    pairs = grid.select("qid", ((i * 97 + 5) % F.col("n")).alias("v"), ((i * 97 + 5 + j * 37) % F.col("n")).alias("w"))
    priced = pairs.join(parts.select(F.col("id").alias("v"), F.col("price").alias("pv")), "v").join(parts.select(F.col("id").alias("w"), F.col("price").alias("pw")), "w")
    return priced.select("qid", "v", "w", F.round(F.col("pv") / (F.col("pv") + F.col("pw")), 6).alias("score"))


def gfa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, key, pos, value): the star schema as GFA1 text. S lines for parts, L lines for the links of every third order, P
    lines for orders, the nation being the reference."""
    signed = lambda seg, orient: F.concat(F.col(seg).cast("string"), F.lit("\t"), F.col(orient))
    walks = paths(spark, sf_dir)
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["seg"].cast("string"), s["orient"])), ",")
    # A path of one step has no overlap, which is written as a star.
    gaps = F.when(F.size("overlaps") > 1, F.array_join(F.transform(F.slice("overlaps", F.lit(2), F.greatest(F.size("overlaps") - 1, F.lit(1))), lambda o: F.concat(o.cast("string"), F.lit("M"))), ",")).otherwise("*")
    s = unitigs(spark, sf_dir).select(F.lit(0).alias("rec"), F.col("unitig").alias("key"), F.lit(0).alias("pos"), F.concat_ws("\t", F.lit("S"), F.col("unitig").cast("string"), F.replace("sequence", F.lit(" "), F.lit(""))).alias("value"))
    l = raw_links(spark, sf_dir).filter("path % 3 = 0").select(F.lit(1).alias("rec"), F.col("path").alias("key"), "pos", F.concat_ws("\t", F.lit("L"), signed("from_id", "from_orient"), signed("to_id", "to_orient"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    p = walks.select(F.lit(2).alias("rec"), F.col("path").alias("key"), F.lit(0).alias("pos"), F.concat(F.lit("P\tReference:n"), F.col("genome").cast("string"), F.lit("_Sequence:o"), F.col("path").cast("string"), F.lit("\t"), steps, F.lit("\t"), gaps).alias("value"))
    return s.unionByName(l).unionByName(p)


def write_gfa(spark: SparkSession, sf_dir: str) -> str:
    """A folder of GFA1 text in many parts, in the order of records, keys and positions."""
    path = scratch_path(spark, "gfa")
    gfa_lines(spark, sf_dir).repartitionByRange(8, "rec", "key", "pos").sortWithinPartitions("rec", "key", "pos").select("value").write.text(path)
    return path


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, v, w, score, distance, cnt) from line items, for outliers without a search: distance from the price, -1 as null."""
    items = table(spark, sf_dir, "lineitem")
    price = F.floor(F.col("l_extendedprice")).cast("bigint")
    return items.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("qid"),
        F.col("l_partkey").cast("bigint").alias("v"),
        (F.col("l_suppkey") + 1000000).cast("bigint").alias("w"),
        F.round(F.lit(1000.0) / (1 + F.col("l_orderkey") * 7919 % 9973), 4).alias("score"),
        F.when(price % 11 != 0, price.cast("double")).alias("distance"),
        (F.col("l_quantity").cast("bigint") % 13).alias("cnt"),
    )
