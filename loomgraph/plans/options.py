"""Options of a run, and what they imply."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from ..operators.outliers import Settings


class Mode(enum.IntFlag):
    GENERAL = enum.auto()
    TWO_SIDED = enum.auto()
    GENOMES = enum.auto()
    OUTLIERS = enum.auto()


@dataclass(frozen=True)
class Options:
    """Inputs are paths, or "" where there is none. n_queries of 0 or less takes all; queries_format -1 infers the layout.

    An edges file without unitigs is an ordinary graph; with unitigs and k it is a two-sided one; with a listing of
    genomes, distances are also averaged over them; outliers without edges works on the distances in the queries.
    """

    queries_file: str
    edges_file: str = ""
    unitigs_file: str = ""
    k: int = 0
    genomes_file: str = ""
    output_stem: str = "out"
    n_queries: int = -1
    queries_format: int = -1
    max_distance: float = float("inf")
    count_threshold: int = 10
    ld_distance: int = -1
    ld_distance_min: int = 1000
    ld_distance_score: float = 0.8
    ld_distance_nth_score: int = 10
    outlier_threshold: float = -1.0
    graph_one_based: bool = False
    queries_one_based: bool = False
    output_one_based: bool = False
    genomes_only: bool = False
    outliers: bool = False
    #: As the documentation has it, the count threshold also holds for outliers of stored distances; the original
    #: program sets it to 0 unless a listing of genomes is given.
    compat: bool = False

    def __post_init__(self):
        problems = []
        if not self.queries_file:
            problems.append("a queries file is needed")
        if self.queries_format > 5:
            problems.append("a queries format is 0 to 5")
        if not self.edges_file and not self.outliers:
            problems.append("an edges file is needed unless outliers of stored distances are wanted")
        if self.edges_file and self.unitigs_file and self.k <= 0:
            problems.append("k must be above 0 with unitigs")
        if not self.edges_file and self.outliers and self.queries_format in (0, 1, 2, 3):
            problems.append("outliers of stored distances need queries of format 4 or 5")
        if self.genomes_only and not self.genomes_file:
            problems.append("without a listing of genomes there is nothing to do for genomes only")
        if self.genomes_file and not self.unitigs_file:
            problems.append("genomes need unitigs")
        if problems:
            raise ValueError("; ".join(problems))

    @classmethod
    def all_one_based(cls, **options) -> Options:
        return cls(**options, graph_one_based=True, queries_one_based=True, output_one_based=True)

    @property
    def mode(self) -> Mode:
        mode = Mode.OUTLIERS if self.outliers else Mode(0)
        if not self.edges_file:
            return mode
        if not self.unitigs_file:
            return mode | Mode.GENERAL
        return mode | Mode.TWO_SIDED | (Mode.GENOMES if self.genomes_file else Mode(0))

    @property
    def settings(self) -> Settings:
        threshold = self.count_threshold if self.genomes_file or not self.compat else 0
        return Settings(self.ld_distance, self.ld_distance_min, self.ld_distance_score, self.ld_distance_nth_score, self.outlier_threshold, threshold)

    def output_name(self, kind: str) -> str:
        """kind: ud, ud_sgg, ud_outliers, ud_sgg_outliers (with the base), ud_outlier_stats, ud_sgg_outlier_stats."""
        suffix = "" if kind.endswith("stats") else f"_{int(self.output_one_based)}_based"
        return f"{self.output_stem}.{kind}{suffix}"
