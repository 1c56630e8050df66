"""Outliers among scored pairs: linkage cutoff, background distribution, Tukey fences.

pairs has (qid, v, w, score, distance, cnt); distance is null where the pair isn't connected. Cutoffs compare with -1 in
that case, so any cutoff of 0 or more drops such pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


#: Parts of the scores' span that are counted before any is sorted.
RANGES = 4096


@dataclass(frozen=True)
class Settings:
    ld_distance: int = -1
    ld_distance_min: int = 1000
    ld_distance_score: float = 0.8
    nth_score: int = 10
    outlier_threshold: float = -1.0
    count_threshold: int = 0


@dataclass(frozen=True)
class Thresholds:
    ld_distance: int
    outlier: float
    extreme: float
    max_score: float = 0.0
    coverage: int = 0


def _fixed() -> F.Column:
    return F.coalesce(F.col("distance"), F.lit(-1.0))


def passing(pairs: DataFrame, ld_distance: float, count_threshold: int) -> DataFrame:
    """Pairs with enough genomes, at the cutoff or beyond."""
    return pairs.filter((F.col("cnt") >= count_threshold) & (_fixed() >= ld_distance))


def vertex_maxima(pairs: DataFrame) -> DataFrame:
    """(vertex, score): the background distribution, each vertex's best score where above 0."""
    ends = pairs.select(F.explode(F.array("v", "w")).alias("vertex"), "score")
    return ends.groupBy("vertex").agg(F.max("score").alias("score")).filter("score > 0")


def score_summary(pairs: DataFrame) -> DataFrame:
    """(n_vertices, largest_score), the score being 0 at least."""
    ends = pairs.select(F.explode(F.array("v", "w")).alias("vertex"), "score")
    return ends.agg(F.count_distinct("vertex").alias("n_vertices"), F.greatest(F.max("score"), F.lit(0.0)).alias("largest_score"))


def largest_distance(pairs: DataFrame, count_threshold: int) -> DataFrame:
    """(largest_distance) over pairs with enough genomes, 0 at least."""
    return pairs.filter(F.col("cnt") >= count_threshold).agg(F.greatest(F.coalesce(F.max(_fixed()), F.lit(0.0)), F.lit(0.0)).alias("largest_distance"))


def order_statistics(values: DataFrame, ranks: dict[str, F.Column], value: str = "score") -> DataFrame:
    """One row: for each name, the value at that 0-based rank in ascending order, with n.

    ranks are expressions of n, the number of values. Equal values are summed up, then counted by RANGES equal parts of
    their span; only the table of parts is summed up in one task, and only the parts that ranks fall into are sorted, each
    by itself.
    """
    sums = values.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("k"))
    span = sums.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    part = F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * RANGES), F.lit(RANGES - 1))
    placed = sums.join(F.broadcast(span)).select("x", "k", part.alias("part"))
    parts = placed.groupBy("part").agg(F.sum("k").alias("k"))
    upto, all_ = F.sum("k").over(Window.orderBy("part")), F.sum("k").over(Window.partitionBy())
    # One row a part and rank, so as many rows as there are ranks.
    parts = parts.select("part", (upto - F.col("k")).alias("ahead"), upto.alias("upto"), all_.alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items())))
    asked = parts.select("*", asked.alias("r")).filter("r.rank >= ahead AND r.rank < upto").select("part", "ahead", "n", "r.name", "r.rank")
    inside = placed.join(F.broadcast(asked), "part")
    before = F.sum("k").over(Window.partitionBy("name").orderBy("x")) + F.col("ahead")
    found = inside.select("n", "name", "rank", "x", before.alias("upto")).filter("upto > rank").groupBy("name").agg(F.max("n").alias("n"), F.min("x").alias("x"))
    return found.agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks))


def tukey(maxima: DataFrame, nth: int = 10) -> DataFrame:
    """(n, q1, q3, outlier, extreme, nth_score) of the background distribution; no values give n null."""
    n = F.col("n")
    ranks = {"q1": F.least(n - 1, F.floor(n / 4)), "q3": F.least(n - 1, F.floor(3 * n / 4)), "nth_score": n - 1 - F.least(n - 1, F.lit(nth))}
    found = order_statistics(maxima, ranks)
    iqr = F.col("q3") - F.col("q1")
    return found.select("n", "q1", "q3", (F.col("q3") + 1.5 * iqr).alias("outlier"), (F.col("q3") + 3 * iqr).alias("extreme"), "nth_score")


def vertex_steps(pairs: DataFrame, count_threshold: int) -> DataFrame:
    """(vertex, distance, score): what can be a vertex's best score at some cutoff, that is its pairs that no other one with a
    better score is as far as or farther than. Pairs without enough genomes are left out."""
    far = pairs.filter(F.col("cnt") >= count_threshold).select(F.explode(F.array("v", "w")).alias("vertex"), _fixed().alias("distance"), "score")
    best = far.groupBy("vertex", "distance").agg(F.max("score").alias("score"))
    beyond = F.max("score").over(Window.partitionBy("vertex").orderBy(F.desc("distance")).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("beyond", beyond).filter("beyond IS NULL OR score > beyond").drop("beyond")


def _thresholds(maxima: DataFrame, ld_distance: int, settings: Settings, last: Thresholds) -> Thresholds:
    """Thresholds at a cutoff, from its background. Without any, only max_score changes and the rest stays as it was last."""
    row = tukey(maxima, settings.nth_score).first()
    if row is None or row.n is None:
        return replace(last, ld_distance=ld_distance, max_score=0.0)
    return Thresholds(ld_distance, row.outlier, row.extreme, row.nth_score, row.n)


def find_thresholds(pairs: DataFrame, settings: Settings) -> Thresholds:
    """Thresholds for the given cutoff, or for one found by bisection if it is negative.

    Bisection is over whole distances between ld_distance_min (0 if no distance is as large) and the largest distance; a
    cutoff is too large once the nth best background score falls under ld_distance_score times the best score. What
    counts is the last cutoff that was tried. Pairs are read once, for ``vertex_steps``; its few rows a vertex are what the
    some 20 cutoffs are tried on.
    """
    last = Thresholds(settings.ld_distance, settings.outlier_threshold, settings.outlier_threshold)
    if settings.ld_distance >= 0:
        if settings.outlier_threshold >= 0:
            return last
        return _thresholds(vertex_maxima(passing(pairs, settings.ld_distance, settings.count_threshold)), settings.ld_distance, settings, last)
    top = score_summary(pairs).first().largest_score or 0.0
    need = settings.ld_distance_score * top
    steps = materialize(vertex_steps(pairs, settings.count_threshold), "steps")
    b = int(max(steps.agg(F.max("distance")).first()[0] or 0, 0))
    a = settings.ld_distance_min if b >= settings.ld_distance_min else 0
    while b - a > 1:
        middle = (a + b) // 2
        maxima = steps.filter(F.col("distance") >= middle).groupBy("vertex").agg(F.max("score").alias("score")).filter("score > 0")
        last = _thresholds(maxima, middle, settings, last)
        a, b = (a, middle) if last.max_score < need else (middle, b)
    return last


def collect_outliers(pairs: DataFrame, thresholds: Thresholds, count_threshold: int) -> DataFrame:
    """Pairs that pass with a score at the outlier threshold or above, marked extreme beyond the second one."""
    found = passing(pairs, thresholds.ld_distance, count_threshold).filter(F.col("score") >= thresholds.outlier)
    return found.withColumn("extreme", F.col("score") >= thresholds.extreme)


def outlier_stats(spark, thresholds: Thresholds, count_threshold: int) -> DataFrame:
    """(ld, outlier, extreme, count_threshold), one row."""
    return spark.createDataFrame([(int(thresholds.ld_distance), float(thresholds.outlier), float(thresholds.extreme), int(count_threshold))], "ld long, outlier double, extreme double, count_threshold long")
