"""Links between segments: adjacency along paths, canonical form, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_type, edge_type


def adjacency(paths: DataFrame, steps: str = "steps", overlaps: str | None = "overlaps") -> DataFrame:
    """Links between consecutive steps of each path; paths keep their other columns.

    steps: array<struct<seg, orient>>; overlaps: array<bigint> with an entry a pair, or (older files) an entry a step,
    where a pair's is that of its second step. Adds pos (of the first step, from 0), from_seg, from_orient, to_seg,
    to_orient, overlap. Works on arrays, so it needs no shuffle.
    """
    keep = [c for c in paths.columns if c not in (steps, overlaps)]
    n = F.size(steps)

    def link(i: Column) -> Column:
        a, b = F.get(steps, i), F.get(steps, i + 1)
        overlap = F.lit(None).cast("bigint")
        if overlaps:
            overlap = F.get(overlaps, F.when(F.size(overlaps) == n, i + 1).otherwise(i))
        return F.struct(i.alias("pos"), a["seg"].alias("from_seg"), a["orient"].alias("from_orient"), b["seg"].alias("to_seg"), b["orient"].alias("to_orient"), overlap.alias("overlap"))

    links = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), link))
    return paths.select(*keep, F.explode(links).alias("__link")).select(*keep, "__link.*")


def adjacent_rows(steps: DataFrame, order: tuple[str, ...], path: str = "path") -> DataFrame:
    """As adjacency, of steps (path, seg, orient, overlap, ...) that are rows, in the given order within a path (nulls first,
    as in sorted structs): (path, pos, from_seg, from_orient, to_seg, to_orient, overlap), where the overlap is that of the
    second step. Rows are sorted once; no path is gathered into an array."""
    along = Window.partitionBy(path).orderBy(*order)
    told = steps.select(path, (F.row_number().over(along) - 1).alias("pos"), F.col("seg").alias("from_seg"), F.col("orient").alias("from_orient"), F.lead(F.struct("seg", "orient", "overlap")).over(along).alias("__next"))
    return told.filter("__next IS NOT NULL").select(path, "pos", "from_seg", "from_orient", F.col("__next.seg").alias("to_seg"), F.col("__next.orient").alias("to_orient"), F.col("__next.overlap").alias("overlap"))


def adjacent_sides(steps: DataFrame, order: tuple[str, ...], path: str = "path") -> DataFrame:
    """The sides (path, a, b) that links join, which don't depend on a link's canonical form, of steps (path, seg, minus, ...): the
    right side of a step that isn't minus, and the left one of its next, else the others. As in the canonical form, a missing
    segment is that of the other step. Rows that are equal by order must have the same seg and minus."""
    along = Window.partitionBy(path).orderBy(*order)
    told = steps.select(path, "seg", "minus", F.lead("seg").over(along).alias("__seg"), F.lead("minus").over(along).alias("__minus")).filter("__minus IS NOT NULL")
    a, b = F.coalesce("seg", "__seg") * 2 + (~F.col("minus")).cast("bigint"), F.coalesce("__seg", "seg") * 2 + F.col("__minus").cast("bigint")
    return told.select(path, a.alias("a"), b.alias("b"))


def canonical(links: DataFrame, from_id: str = "from_id", to_id: str = "to_id") -> DataFrame:
    """links with from_orient and to_orient: ids in order, and edge_type instead of orientations."""
    kind = canonical_type(F.col(from_id), F.col(to_id), edge_type(F.col("from_orient"), F.col("to_orient")))
    rest = [c for c in links.columns if c not in (from_id, to_id, "from_orient", "to_orient")]
    return links.select(*rest, F.least(from_id, to_id).alias("from_id"), F.greatest(from_id, to_id).alias("to_id"), kind.alias("edge_type"))


def distinct_links(links: DataFrame, seen: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per (by, from_id, to_id, edge_type, overlap) with seq, the least of seen. Different overlaps stay apart."""
    return links.groupBy(*by, "from_id", "to_id", "edge_type", "overlap").agg(F.min(seen).alias("seq"))


def nonzero_overlap(links: DataFrame) -> DataFrame:
    """Links whose overlap isn't 0; a missing overlap passes."""
    return links.filter("overlap IS NULL OR overlap <> 0")
