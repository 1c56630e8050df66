"""GFA1 text: segments, links and paths.

Records other than S, L and P are left out. Errors are found by queries over the parsed records, not line by line.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import edge_type, field, leading_integer, path_reference, path_sequence, split_fields, step_name, step_orientation
from ..operators import ids, links
from ..scratch import materialize, narrow
from .errors import raise_if_any
from .scan import numbered_lines


@dataclass(frozen=True)
class Gfa:
    """segments (id, name, sequence); links (from_id, to_id, edge_type, overlap, seq); references (ref_id, reference,
    sequence); paths (ref_id, line_no, steps, overlaps), steps with segment ids."""

    segments: DataFrame
    links: DataFrame
    references: DataFrame
    paths: DataFrame


def records(lines: DataFrame) -> DataFrame:
    """(line_no, rec, fields) of S, L and P lines."""
    return lines.select("line_no", F.substring("value", 1, 1).alias("rec"), split_fields(F.col("value"), "\t").alias("fields")).filter(F.col("rec").isin("S", "L", "P"))


def segment_records(found: DataFrame) -> DataFrame:
    f = F.col("fields")
    return found.filter("rec = 'S'").select("line_no", F.size(f).alias("n"), field(f, 1).alias("name"), field(f, 2).alias("sequence"))


def link_records(found: DataFrame) -> DataFrame:
    f = F.col("fields")
    first = lambda i: F.substring(field(f, i), 1, 1)
    return found.filter("rec = 'L'").select("line_no", F.size(f).alias("n"), field(f, 1).alias("from_name"), first(2).alias("from_orient"), field(f, 3).alias("to_name"), first(4).alias("to_orient"), field(f, 5).alias("overlap_text"), leading_integer(field(f, 5)).alias("overlap"))


def path_records(found: DataFrame) -> DataFrame:
    f = F.col("fields")
    steps = F.transform(split_fields(field(f, 2), ","), lambda s: F.struct(step_name(s).alias("seg"), step_orientation(s).alias("orient")))
    overlaps = F.transform(split_fields(field(f, 3), ","), leading_integer)
    return found.filter("rec = 'P'").select("line_no", F.size(f).alias("n"), field(f, 1).alias("name"), path_reference(field(f, 1)).alias("reference"), path_sequence(field(f, 1)).alias("sequence"), steps.alias("steps"), overlaps.alias("overlaps"))


def conflicting_sequences(segments: DataFrame) -> DataFrame:
    """(name, n_sequences) of names that are given several sequences. segments: (name, sequence)."""
    return segments.filter("sequence <> ''").groupBy("name").agg(F.count_distinct("sequence").alias("n_sequences")).filter("n_sequences > 1")


def undefined_segments(used: DataFrame, segments: DataFrame) -> DataFrame:
    """(name) of segments that are used, but never defined. Both: (name)."""
    return used.select("name").distinct().join(segments.select("name").distinct(), "name", "left_anti")


def bad_overlap_counts(paths: DataFrame) -> DataFrame:
    """Paths of several steps whose overlaps are neither one a pair nor one a step."""
    n = F.size("steps")
    return paths.filter((n > 1) & ~F.size("overlaps").isin(0) & (F.size("overlaps") != n) & (F.size("overlaps") != n - 1) | (n > 1) & (F.size("overlaps") == 0))


def errors(lines: DataFrame, segments: DataFrame, link_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(line_no, message) of everything that is wrong."""
    said = lambda df, text, no="line_no": df.select(F.col(no).alias("line_no") if no else F.lit(None).cast("bigint").alias("line_no"), (text if isinstance(text, F.Column) else F.lit(text)).alias("message"))
    used = link_rows.select(F.explode(F.array("from_name", "to_name")).alias("name"))
    stepped = paths.select(F.explode("steps.seg").alias("name"))
    signs = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("+", "-")
    n = F.size("steps")
    found = [
        said(lines.filter("value = ''"), "empty line"),
        said(segments.filter("n < 3"), "a segment needs a name and a sequence"),
        said(link_rows.filter("n < 6"), "a link needs two segments, two orientations and an overlap"),
        said(link_rows.filter((F.col("n") >= 6) & F.col("overlap").isNull()), "a link's overlap isn't a number"),
        said(link_rows.filter((F.col("n") >= 6) & (signs("from_orient") | signs("to_orient"))), "a link's orientation is neither + nor -"),
        said(paths.filter("n < 4"), "a path needs a name, segments and overlaps"),
        said(paths.filter("n >= 4 AND (instr(name, 'Reference:') = 0 OR instr(name, '_Sequence:') = 0 OR (reference = '' AND sequence = ''))"), "a path's name needs Reference: and _Sequence:"),
        said(bad_overlap_counts(paths.filter("n >= 4")), "a path has neither an overlap for each pair of steps nor one for each step"),
        said(paths.filter((F.col("n") >= 4) & (n > 1) & F.exists("overlaps", F.isnull)), "a path's overlap isn't a number"),
        said(conflicting_sequences(segments), F.concat(F.lit("several sequences for the segment "), "name"), None),
        said(undefined_segments(used.filter("name IS NOT NULL"), segments), F.concat(F.lit("a link names the undefined segment "), "name"), None),
        said(undefined_segments(stepped, segments.select("name").unionByName(used)), F.concat(F.lit("a path names the unknown segment "), "name"), None),
    ]
    return reduce(DataFrame.unionByName, found)


def read_gfa(spark: SparkSession, path: str | list[str], validate: bool = True) -> Gfa:
    """Parse GFA1 files; InputError if something is wrong with them."""
    lines = materialize(numbered_lines(spark, path).drop("file"), "gfa-lines")
    found = records(lines)
    segment_rows, link_rows, path_rows = segment_records(found), link_records(found), path_records(found)
    if validate:
        raise_if_any(errors(lines, segment_rows, link_rows, path_rows))
    names = segment_rows.select("name", "line_no", F.lit(0).alias("class"), F.lit(0).alias("pos")).unionByName(
        link_rows.select("line_no", F.lit(1).alias("class"), F.posexplode(F.array("from_name", "to_name")).alias("pos", "name")).select("name", "line_no", "class", "pos")
    )
    sequences = segment_rows.groupBy("name").agg(F.max("sequence").alias("sequence"))
    segments = materialize(ids.first_seen(names).join(sequences, "name", "left").select("id", "name", F.coalesce("sequence", F.lit("")).alias("sequence")), "segments")
    known = narrow(segments.select("name", "id"))
    named = link_rows.join(known.select(F.col("name").alias("from_name"), F.col("id").alias("from_id")), "from_name").join(known.select(F.col("name").alias("to_name"), F.col("id").alias("to_id")), "to_name")
    made = links.distinct_links(links.canonical(named.select("line_no", "from_id", "to_id", "from_orient", "to_orient", "overlap")), F.col("line_no"))
    references = materialize(ids.references(path_rows.select("reference", "sequence", "line_no")), "references")
    steps = path_rows.select("line_no", "reference", "overlaps", F.posexplode("steps").alias("pos", "s")).join(known, F.col("s.seg") == F.col("name"))
    steps = steps.groupBy("line_no", "reference", "overlaps").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("seg"), F.col("s.orient").alias("orient")))).alias("steps"))
    paths = steps.withColumn("steps", F.expr("transform(steps, s -> struct(s.seg AS seg, s.orient AS orient))")).join(narrow(references.select("reference", "ref_id")), "reference").select("ref_id", "line_no", "steps", "overlaps")
    return Gfa(segments, materialize(made, "links"), references, materialize(paths, "paths"))


def genome_links(gfa: Gfa) -> DataFrame:
    """(ref_id, from_id, to_id, edge_type, overlap, seq) along the paths of each reference."""
    along = links.adjacency(gfa.paths).select("ref_id", "line_no", "pos", F.col("from_seg").alias("from_id"), F.col("to_seg").alias("to_id"), "from_orient", "to_orient", "overlap")
    return links.distinct_links(links.canonical(along), F.struct("line_no", "pos"), ("ref_id",))


__all__ = ["Gfa", "read_gfa", "genome_links", "records", "segment_records", "link_records", "path_records", "errors", "conflicting_sequences", "undefined_segments", "bad_overlap_counts", "edge_type"]
