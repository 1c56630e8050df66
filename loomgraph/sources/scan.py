"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_fields
from ..scratch import materialize, narrow


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, line_no, value, file): source is the place in the list of paths (0 for one path), line_no goes from 1 within it;
    lines end at ``\\n`` only; file is the one that the line stands in.

    A path is a file, or a folder whose files are parts of one table: they come in the order of their part numbers, else of
    their names, and numbers go on from part to part. Spark reads a file as blocks, and rows of a block come in order.
    Lines are counted per block, and only the table of blocks is summed up in order; the lines themselves aren't sorted or
    shuffled.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = materialize(lines, "lines")
    blocks = materialize(lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n")), "file-blocks")
    blocks = _with_source(spark, blocks, paths)
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    ahead = F.sum("n").over(Window.partitionBy("source").orderBy(part, "file", "block")) - F.col("n")
    blocks = narrow(materialize(blocks.select("file", "block", "source", "first", ahead.alias("ahead")), "blocks"))
    return lines.join(blocks, ["file", "block"]).select("source", (F.col("ahead") + F.col("row") - F.col("first") + 1).alias("line_no"), "value", "file")


def _with_source(spark: SparkSession, blocks: DataFrame, paths: str | list[str]) -> DataFrame:
    """blocks with source. Of several paths, it's the one that is the file or the folder that it is in."""
    if isinstance(paths, str) or len(paths) == 1:
        return blocks.withColumn("source", F.lit(0).cast("bigint"))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(i, qualified(spark, p)) for i, p in enumerate(paths)], "source long, at string").select("source", plain("at").alias("at"))
    file = plain("file")
    known = blocks.withColumn("at", F.explode(F.array(file, F.regexp_replace(file, "/[^/]*$", ""))))
    return known.join(listed, "at").drop("at")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, as Spark's file metadata have it but for the number of slashes after the scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString().rstrip("/")


def field_lines(spark: SparkSession, paths: str | list[str], delimiter: str = " ") -> DataFrame:
    """(source, line_no, fields)"""
    return numbered_lines(spark, paths).select("source", "line_no", split_fields(F.col("value"), delimiter).alias("fields"))


def check_readable(spark: SparkSession, paths: list[str]) -> None:
    """FileNotFoundError naming every path that isn't there, before any work starts."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            missing.append(p)
    if missing:
        raise FileNotFoundError(", ".join(missing))
