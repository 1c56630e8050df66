"""Undirected weighted graphs as symmetric edge tables (a, b, w), for one graph or keyed by genome.

A two-sided graph has the nodes 2u (left) and 2u+1 (right) for a unitig u. They are joined by an edge of weight
``length - k``; each link is an edge of weight 1 between two sides.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import source_side, target_side, truncated_ratio


def merge_edges(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Loops go, parallel edges become the lightest, and both directions are stored."""
    least = edges.filter("a <> b").groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    return least.select(*by, both, "w").select(*by, "e.a", "e.b", "w")


def ordinary_graph(edges: DataFrame, one_based: bool = False) -> DataFrame:
    """edges: (v, w, weight)."""
    shift = int(one_based)
    return merge_edges(edges.select((F.col("v") - shift).alias("a"), (F.col("w") - shift).alias("b"), F.col("weight").alias("w")))


def self_weights(unitigs: DataFrame, k: int) -> DataFrame:
    """unitigs: (unitig, sequence). (unitig, self_w); a negative weight means that k is wrong."""
    return unitigs.select("unitig", (F.length("sequence") - k).cast("double").alias("self_w"))


def link_edges(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """links: (from_id, to_id, edge_type). (by, a, b, 1.0)."""
    kind = F.col("edge_type")
    return links.select(*by, source_side(F.col("from_id"), kind).alias("a"), target_side(F.col("to_id"), kind).alias("b"), F.lit(1.0).alias("w"))


def _self_edges(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return weights.select(*by, (F.col("unitig") * 2).alias("a"), (F.col("unitig") * 2 + 1).alias("b"), F.col("self_w").alias("w"))


def two_sided_graph(weights: DataFrame, links: DataFrame) -> DataFrame:
    """The graph of all unitigs, weights: (unitig, self_w), and of the links, those with overlap 0 left out before."""
    return merge_edges(_self_edges(weights).unionByName(link_edges(links)))


def genome_graphs(weights: DataFrame, links: DataFrame, genome: str = "genome") -> DataFrame:
    """A two-sided graph per genome: its links, and the unitigs that stand in one of them."""
    mentioned = links.select(genome, F.explode(F.array("from_id", "to_id")).alias("unitig")).distinct()
    own = mentioned.join(weights, "unitig").select(genome, "unitig", "self_w")
    return merge_edges(_self_edges(own, (genome,)).unionByName(link_edges(links, (genome,))), (genome,))


class Links(NamedTuple):
    """A two-sided graph, or one for each genome, that isn't built yet: the sides (genome, a, b) that links join, which may repeat in
    either direction, and weights (unitig, self_w)."""

    sides: DataFrame
    weights: DataFrame


def sided_graph(weights: DataFrame, sides: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As genome_graphs, of links as (by, a, b)."""
    unit = lambda c: F.floor(F.col(c) / 2).cast("bigint")
    own = sides.select(*by, F.explode(F.array(unit("a"), unit("b"))).alias("unitig")).distinct().join(weights, "unitig")
    return merge_edges(_self_edges(own, by).unionByName(sides.select(*by, "a", "b", F.lit(1.0).alias("w"))), by)


def degrees(edges: DataFrame, two_sided: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, degree); a two-sided node is the unitig, and its own edge doesn't count."""
    node = F.floor(F.col("a") / 2) if two_sided else F.col("a")
    sums = edges.groupBy(*by, node.alias("node")).agg(F.count("*").alias("degree"))
    return sums.withColumn("degree", F.when(F.col("degree") >= 2, F.col("degree") - 2).otherwise(F.col("degree"))) if two_sided else sums


def summary(edges: DataFrame, two_sided: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_nodes, n_edges, avg_degree, max_degree) of the nodes that have a neighbour."""
    d = degrees(edges, two_sided, by)
    total, n = F.sum("degree"), F.sum((F.col("degree") > 0).cast("bigint"))
    return d.groupBy(*by).agg(n.alias("n_nodes"), F.floor(total / 2).alias("n_edges"), truncated_ratio(total, n).alias("avg_degree"), F.max("degree").alias("max_degree"))


def average_size(edges: DataFrame, genome: str = "genome") -> DataFrame:
    """(avg_nodes, avg_edges) over the graphs of genomes."""
    sizes = edges.groupBy(genome).agg(F.count_distinct("a").alias("nodes"), (F.count("*") / 2).alias("edges"))
    return sizes.agg(F.avg("nodes").alias("avg_nodes"), F.avg("edges").alias("avg_edges"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those of gone (a, b), in either direction."""
    both = gone.select("a", "b").unionByName(gone.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.join(both, ["a", "b"], "left_anti")


def disconnect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges without any at the given (node)."""
    return edges.join(nodes, F.col("a") == F.col("node"), "left_anti").join(nodes, F.col("b") == F.col("node"), "left_anti")


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with connected."""
    found = edges.select("a", "b").withColumn("connected", F.lit(True))
    return pairs.join(found, ["a", "b"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return merge_edges(edges.select("a", "b", "w").unionByName(more.select("a", "b", "w")))


def n_vertices(frame: DataFrame, v: str = "v", w: str = "w") -> DataFrame:
    """(largest): the largest vertex of any pair."""
    return frame.agg(F.max(F.greatest(v, w)).alias("largest"))
