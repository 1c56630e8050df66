"""Edge, unitig, genome, query and count files; query layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import edge_weight, field, leading_integer
from .errors import InputError, raise_if_any
from .scan import check_readable, field_lines

# What the columns of a query file are, by layout.
LAYOUTS = {
    0: ("v", "w"),
    1: ("v", "w", "score"),
    2: ("v", "w", "distance", "score"),
    3: ("v", "w", "distance", "flag", "score"),
    4: ("v", "w", "distance", "score", "cnt"),
    5: ("v", "w", "distance", "flag", "score", "cnt"),
}
LAYOUT_NAMES = {k: " ".join("count" if c == "cnt" else c for c in v) for k, v in LAYOUTS.items()}


def infer_layout(n_fields: int, outliers_only: bool = False) -> int:
    """The layout by the number of fields of the first line; -1 if none fits. Result files with moments don't tell by their
    number of fields which columns they have, so their layout has to be given."""
    return {2: 0, 3: 1, 4: 2, 5: 4 if outliers_only else 3, 6: 5}.get(n_fields, -1)


def layout_columns(layout: int, with_distance: bool = False) -> dict[str, int]:
    """Where the columns stand that are read. The distance is computed anew, so it is read only for outliers alone."""
    return {c: i for i, c in enumerate(LAYOUTS[layout]) if c != "distance" or with_distance}


def minimum_fields(layout: int) -> int:
    return len(LAYOUTS[layout])


def project_layout(lines: DataFrame, layout: int, with_distance: bool = False, one_based: bool = False) -> DataFrame:
    """lines (line_no, fields) as queries (qid, v, w, ...), qid from 0. A distance loses its decimals."""
    f = F.col("fields")
    cast = {
        "v": lambda x: x.cast("bigint") - int(one_based),
        "w": lambda x: x.cast("bigint") - int(one_based),
        "score": lambda x: x.cast("double"),
        "distance": lambda x: x.cast("double").cast("bigint").cast("double"),
        "flag": lambda x: x.cast("bigint") != 0,
        "cnt": lambda x: x.cast("bigint"),
    }
    return lines.select((F.col("line_no") - 1).alias("qid"), *(cast[c](field(f, i)).alias(c) for c, i in layout_columns(layout, with_distance).items()))


def read_queries(spark: SparkSession, path: str, layout: int = -1, n_queries: int = -1, one_based: bool = False, outliers_only: bool = False) -> DataFrame:
    """Queries of a file, the first n_queries if that is above 0. cnt is 1 where the layout has no count."""
    check_readable(spark, [path])
    lines = field_lines(spark, path)
    if layout < 0:
        first = lines.filter("line_no = 1").select(F.size("fields")).first()
        layout = infer_layout(first[0] if first else 0, outliers_only)
        if layout < 0:
            raise InputError([(1, "the layout of the queries is unknown; name it")])
    if n_queries > 0:
        lines = lines.filter(F.col("line_no") <= n_queries)
    need = minimum_fields(layout)
    raise_if_any(lines.filter(F.size("fields") < need).select("line_no", F.lit(f"fewer than {need} columns").alias("message")))
    found = project_layout(lines, layout, outliers_only, one_based)
    return found if "cnt" in found.columns else found.withColumn("cnt", F.lit(1).cast("bigint"))


def _at_least(lines: DataFrame, n: int) -> DataFrame:
    raise_if_any(lines.filter(F.size("fields") < n).select("line_no", F.lit(f"fewer than {n} columns").alias("message")))
    return lines


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(v, w, weight) of an ordinary graph; a negative weight is an error."""
    check_readable(spark, [path])
    f = F.col("fields")
    lines = _at_least(field_lines(spark, path), 2)
    edges = lines.select("line_no", field(f, 0).cast("bigint").alias("v"), field(f, 1).cast("bigint").alias("w"), edge_weight(field(f, 2)).alias("weight"))
    raise_if_any(edges.filter("weight < 0").select("line_no", F.lit("negative weight").alias("message")))
    return edges.drop("line_no")


def read_unitigs(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(unitig, sequence); the line's place, not its id, is the unitig."""
    check_readable(spark, [path])
    lines = _at_least(field_lines(spark, path), 2).select("line_no", field(F.col("fields"), 1).alias("sequence"))
    raise_if_any(lines.filter(F.length("sequence") < k).select("line_no", F.lit("a unitig is shorter than k; is k right?").alias("message")))
    return lines.select((F.col("line_no") - 1).alias("unitig"), "sequence")


def read_links(spark: SparkSession, paths: str | list[str], one_based: bool = False) -> DataFrame:
    """(source, from_id, to_id, edge_type, overlap) of two-sided graphs; source is the place in the list of paths; overlap is
    null where the column is missing."""
    check_readable(spark, [paths] if isinstance(paths, str) else paths)
    f = F.col("fields")
    lines = _at_least(field_lines(spark, paths), 3)
    shift = int(one_based)
    return lines.select("source", (field(f, 0).cast("bigint") - shift).alias("from_id"), (field(f, 1).cast("bigint") - shift).alias("to_id"), field(f, 2).alias("edge_type"), leading_integer(field(f, 3)).alias("overlap"))


def read_listing(spark: SparkSession, path: str) -> list[str]:
    """The paths of a listing, one a line. A listing is as long as there are genomes, and its paths are opened by the driver."""
    check_readable(spark, [path])
    rows = field_lines(spark, path, "\n").orderBy("line_no").collect()
    if not rows:
        raise InputError([(None, "the listing names no genome")])
    return [r.fields[0] for r in rows if r.fields]


def read_genome_links(spark: SparkSession, listing: str, one_based: bool = False) -> DataFrame:
    """Links of all genomes of a listing, with genome: the 0-based line of its file or folder. Names may repeat in different
    folders; a genome that is listed twice is one genome, as its first line."""
    paths = list(dict.fromkeys(read_listing(spark, listing)))
    return read_links(spark, paths, one_based).withColumnRenamed("source", "genome")


def read_plot_rows(spark: SparkSession, path: str, n_rows: int = 0) -> DataFrame:
    """(line_no, v, w, distance, flag, score) for a plot; all rows if n_rows is 0."""
    f = F.col("fields")
    lines = field_lines(spark, path)
    lines = lines.filter(F.col("line_no") <= n_rows) if n_rows > 0 else lines
    return lines.select("line_no", field(f, 0).cast("bigint").alias("v"), field(f, 1).cast("bigint").alias("w"), field(f, 2).cast("double").alias("distance"), (field(f, 3).cast("bigint") != 0).alias("flag"), field(f, 4).cast("double").alias("score"))


def read_plot_counts(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, cnt): the third column."""
    return field_lines(spark, path).select("line_no", field(F.col("fields"), 2).cast("double").alias("cnt"))
