"""Dense ids in an order, without sorting all rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines whose segments are registered first, links second, paths last.
BLOCK_LINES = 10_000_000
#: Lines of a bucket, the unit that is sorted in one task.
BUCKET_LINES = 1 << 16


def dense_ids(rows: DataFrame, order: list[Column | str], bucket: list[Column], out: str = "id", start: int = 0) -> DataFrame:
    """rows with out: their place, from start on, by bucket, then order. Buckets must be in line with the order.

    Sizes of buckets are summed up first, so only the table of buckets passes through one task.
    """
    names = [f"__b{i}" for i in range(len(bucket))]
    keyed = rows.select("*", *(b.alias(n) for b, n in zip(bucket, names)))
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("__n"))
    ahead = sizes.select(*(F.col(n).alias(n + "_") for n in names), (F.sum("__n").over(Window.orderBy(*names)) - F.col("__n")).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    placed = keyed.withColumn("__place", place).join(ahead, reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(n + "_")) for n in names)))
    return placed.select(*rows.columns, (F.col("__ahead") + F.col("__place") + start).cast("bigint").alias(out))


def first_seen(names: DataFrame, name: str = "name", block_lines: int = BLOCK_LINES) -> DataFrame:
    """names: (name, line_no, class, pos), class 0 for segments and 1 for links. (name, id): ids by first appearance,
    where a block's segments come before its links."""
    key = F.struct(F.floor((F.col("line_no") - 1) / block_lines).alias("block"), F.col("class"), F.col("line_no"), F.col("pos"))
    seen = names.groupBy(name).agg(F.min(key).alias("k"))
    out = dense_ids(seen, ["k", name], [F.col("k.block"), F.col("k.class"), F.floor(F.col("k.line_no") / BUCKET_LINES)])
    return out.select(name, "id")


def references(paths: DataFrame) -> DataFrame:
    """paths: (reference, sequence, line_no). (ref_id, reference, sequence) by first line; the first line's sequence stays."""
    first = paths.groupBy("reference").agg(F.min("line_no").alias("line_no"), F.min_by("sequence", "line_no").alias("sequence"))
    return dense_ids(first, ["line_no"], [F.floor(F.col("line_no") / BUCKET_LINES)], "ref_id").select("ref_id", "reference", "sequence")
