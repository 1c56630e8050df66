"""Text outputs. Lines are made by ``*_lines`` functions, (order columns..., value), and stored by ``write_lines``.

Files are folders of parts in order, as Spark writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fixed_distance, significant, whole

#: How an unreached minimum or maximum of the main graph is printed in compatible files: the largest double.
UNREACHED = "1.79769e+308"


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def partition_folder(spark: SparkSession, column: str, value: str | None) -> str:
    """The name of the folder in which Spark's writer puts a partition's rows."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}={spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}"


def empty_table(spark: SparkSession, path: str) -> None:
    """A folder with an empty part, so that it can be read like others."""
    spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(path)


def link_text() -> Column:
    """``from to TT overlapM``"""
    return F.concat_ws(" ", "from_id", "to_id", "edge_type", F.concat(F.col("overlap").cast("string"), F.lit("M")))


def link_lines(links: DataFrame) -> DataFrame:
    """Lines of (from_id, to_id, edge_type, overlap, seq)."""
    return links.select("from_id", "seq", link_text().alias("value"))


def unitig_lines(segments: DataFrame) -> DataFrame:
    return segments.select("id", F.concat_ws(" ", "id", "sequence").alias("value"))


def count_lines(counts: DataFrame) -> DataFrame:
    """``id count`` of repeated unitigs."""
    return counts.filter("cnt > 1").select("unitig", F.concat_ws(" ", "unitig", "cnt").alias("value"))


def _number(c: str, missing: str) -> Column:
    return F.coalesce(significant(F.col(c)), F.lit(missing))


def distance_lines(found: DataFrame, means: bool, one_based: bool = False, compat: bool = True) -> DataFrame:
    """``v w distance [flag] [score] [count] M2 min max``, with what columns found has; the count goes with means.

    Unreached pairs print -1 for the distance. Their moments are -1 over genomes; in the main graph M2 is 0 and minimum
    and maximum are the largest double, as they are for a distance of 0 (compat), else -1.
    """
    shift = int(one_based)
    lost = F.col("distance").isNull()
    parts = [F.col("v") + shift, F.col("w") + shift, whole(fixed_distance(F.col("distance")))]
    if "flag" in found.columns:
        parts.append(F.col("flag").cast("int"))
    if "score" in found.columns:
        parts.append(significant(F.col("score")))
    if means:
        parts += [F.col("cnt"), *(_number(c, "-1") for c in ("m2", "min_d", "max_d"))]
    elif compat:
        low = F.when(lost | (F.col("distance") == 0), UNREACHED).otherwise(_number("min_d", "-1"))
        high = F.when(lost, UNREACHED).otherwise(_number("max_d", "-1"))
        parts += [F.lit("0"), low, high]
    else:
        parts += [F.lit("0"), _number("min_d", "-1"), _number("max_d", "-1")]
    return found.select("qid", F.concat_ws(" ", *(p.cast("string") for p in parts)).alias("value"))


def stats_line(stats: DataFrame) -> DataFrame:
    """``ld outlier extreme count_threshold``"""
    return stats.select(F.lit(0).alias("qid"), F.concat_ws(" ", F.col("ld").cast("string"), significant(F.col("outlier")), significant(F.col("extreme")), F.col("count_threshold").cast("string")).alias("value"))
