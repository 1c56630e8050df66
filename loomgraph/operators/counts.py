"""Occurrences of unitigs in genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import presence
from ..scratch import materialize, narrow


def unitig_counts(paths: DataFrame, genome: str = "ref_id", steps: str = "steps") -> DataFrame:
    """(genome, unitig, cnt) over path lines that don't have exactly one step."""
    long = paths.filter(F.size(steps) != 1).select(genome, F.explode(steps).alias("s"))
    return long.groupBy(genome, F.col("s.seg").alias("unitig")).agg(F.count("*").alias("cnt"))


def max_counts(counts: DataFrame) -> DataFrame:
    """(unitig, cnt): the most occurrences in any genome."""
    return counts.groupBy("unitig").agg(F.max("cnt").alias("cnt"))


def repeated(counts: DataFrame) -> DataFrame:
    return counts.filter("cnt > 1")


def dense_counts(counts: DataFrame, genomes: DataFrame, unitigs: DataFrame, genome: str = "ref_id") -> DataFrame:
    """(genome, unitig, cnt) for every genome and unitig, 0 where there is none.

    The grid is the result itself, genomes times unitigs; the genomes are sent to all tasks if they are within bounds.
    """
    grid = unitigs.select("unitig").withColumn("__one", F.lit(1)).join(narrow(materialize(genomes.select(genome).withColumn("__one", F.lit(1)), "genomes")), "__one")
    return grid.join(counts, [genome, "unitig"], "left").select(genome, "unitig", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def presence_matrix(counts: DataFrame, genomes: DataFrame, unitigs: DataFrame, genome: str = "ref_id") -> DataFrame:
    """(genome, unitig, presence): c where the genome has the unitig, else a."""
    return dense_counts(counts, genomes, unitigs, genome).select(genome, "unitig", presence(F.col("cnt")).alias("presence"))


def presence_strings(counts: DataFrame, n_unitigs: int, genome: str = "ref_id") -> DataFrame:
    """(genome, presence): one character a unitig 0 to n_unitigs - 1, made from each genome's own unitigs only."""
    have = counts.filter("cnt > 0").groupBy(genome).agg(F.sort_array(F.collect_set(F.col("unitig").cast("bigint"))).alias("have"))
    # Between neighbours stand as many a as ids are left out.
    gaps = F.expr(f"transform(concat(have, array(CAST({n_unitigs} AS BIGINT))), (x, i) -> repeat('a', CAST(x - IF(i = 0, -1L, have[i - 1]) - 1 AS INT)))")
    return have.select(genome, F.array_join(gaps, "c").alias("presence"))


def fasta_rows(presence: DataFrame, header: str, width: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, header, fasta): >header, then the presence string in lines of so many columns; a row for each of presence."""
    wrapped = F.regexp_replace("presence", f"(.{{{width}}})(?=.)", "$1\n")
    return presence.select(*keep, header, F.concat(F.lit(">"), F.col(header).cast("string"), F.lit("\n"), wrapped).alias("fasta"))
