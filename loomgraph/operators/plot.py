"""Data of a Manhattan plot of scores by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import axis_exponent, thousands


def with_counts(rows: DataFrame, counts: DataFrame, criterion: int) -> DataFrame:
    """rows (line_no, ...) whose count, in the line of the same number, reaches the criterion. counts: (line_no, cnt).

    counts that are shorter than rows are ignored.
    """
    if counts.count() < rows.count():
        return rows
    return rows.join(counts.select("line_no", "cnt"), "line_no").filter(F.col("cnt") >= criterion).drop("cnt")


def connected(rows: DataFrame) -> DataFrame:
    return rows.filter("distance <> -1")


def disconnected(rows: DataFrame) -> DataFrame:
    return rows.filter("distance = -1")


def extents(rows: DataFrame) -> DataFrame:
    """(min_score, max_score, max_distance, exponent) of connected rows."""
    found = connected(rows).agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.max("distance").alias("max_distance"))
    return found.withColumn("exponent", axis_exponent(F.col("max_distance")))


def annotations(rows: DataFrame) -> DataFrame:
    """(connected_k, disconnected_k): thousands of rows."""
    there = F.sum((F.col("distance") != -1).cast("bigint"))
    return rows.agg(thousands(there).alias("connected_k"), thousands(F.count("*") - there).alias("disconnected_k"))


def direct(rows: DataFrame) -> DataFrame:
    return rows.filter("flag")


def indirect(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT flag")


def raster(rows: DataFrame, width: int = 1200, height: int = 700) -> DataFrame:
    """(x, y, flag, n): connected rows by the picture's points that they fall on, distance to the right and score upwards.

    All rows count, and there are no more rows than points, whatever the size of the input.
    """
    found = connected(rows)
    ends = found.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.max("distance").alias("far"))
    at = lambda value, low, high, n: F.least(F.floor(F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    placed = found.join(F.broadcast(ends)).select(at(F.col("distance"), F.lit(0.0), F.col("far"), width).alias("x"), at(F.col("score"), F.col("low"), F.col("high"), height).alias("y"), "flag")
    return placed.groupBy("x", "y", "flag").agg(F.count("*").alias("n"))


def draw(rows: DataFrame, path: str, outlier: float | None = None, extreme: float | None = None, width: int = 1200, height: int = 700) -> None:
    """A PNG of all connected rows, if matplotlib is there; the driver gets a row a point of the picture."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    ends, counts = extents(rows).first(), annotations(rows).first()
    points = raster(rows, width, height).toPandas()
    fig, ax = plt.subplots(figsize=(width / 100, height / 100))
    for flag, colour in ((False, "#9aa5b1"), (True, "#1f4e79")):
        part = points[points["flag"] == flag]
        ax.scatter(part["x"] / width * ends.max_distance, ends.min_score + part["y"] / height * (ends.max_score - ends.min_score), s=3, c=colour, label="direct" if flag else "indirect")
    for level in (outlier, extreme):
        if level is not None:
            ax.axhline(level, linestyle="--", linewidth=0.8)
    ax.set_xlabel("distance")
    ax.set_ylabel("score")
    ax.set_title(f"{counts.connected_k} K connected, {counts.disconnected_k} K disconnected")
    ax.legend()
    fig.savefig(path, dpi=150)
    plt.close(fig)
