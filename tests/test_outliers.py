import glob
import random

import pytest

from loomgraph.operators import outliers, plot
from loomgraph.plans import runs
from loomgraph.plans.options import Options
from loomgraph.sources import tables

ROWS = """0 1 10 1 5
2 3 10 1 5
4 5 10 1 5
6 7 10 2 5
8 9 10 2 5
10 11 10 2 5
12 13 10 10 5
14 15 2 50 5
16 17 -1 60 0
"""


def lines(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))).splitlines()


def test_golden_outliers(spark, tmp_path):
    (tmp_path / "q").write_text(ROWS)
    options = Options(str(tmp_path / "q"), queries_format=4, ld_distance=5, outliers=True, output_stem=str(tmp_path / "out"), compat=True)
    got = runs.run(spark, options)
    assert [r.qid for r in got.main_outliers.collect()] == [6]
    assert lines(f"{tmp_path}/out.ud_outliers_0_based") == ["12 13 10 10 0 10 10"]
    assert lines(f"{tmp_path}/out.ud_outlier_stats") == ["5 3.5 5 0"]
    # The documented count threshold holds unless the original program's behaviour is asked for.
    strict = runs.run(spark, Options(str(tmp_path / "q"), queries_format=4, ld_distance=5, outliers=True, count_threshold=6), write=False)
    assert strict.main_outliers.count() == 0


@pytest.mark.parametrize("n, q1, q3, nth, nth_value", [(8, 3, 7, 10, 1), (8, 3, 7, 2, 6), (1, 1, 1, 10, 1), (5, 2, 4, 0, 5)])
def test_order_statistics(spark, n, q1, q3, nth, nth_value):
    maxima = spark.createDataFrame([(i, float(i)) for i in range(1, n + 1)], "vertex long, score double")
    r = outliers.tukey(maxima, nth).first()
    assert (r.q1, r.q3, r.nth_score) == (q1, q3, nth_value)
    assert r.outlier == q3 + 1.5 * (q3 - q1) and r.extreme == q3 + 3 * (q3 - q1)


def brute_thresholds(rows, s):
    """rows: (v, w, score, distance or -1, cnt)."""
    state = dict(ld=s.ld_distance, outlier=s.outlier_threshold, extreme=s.outlier_threshold, best=0.0)

    def at(ld):
        top = {}
        for v, w, score, d, cnt in rows:
            if cnt >= s.count_threshold and d >= ld:
                for x in (v, w):
                    top[x] = max(top.get(x, 0.0), score)
        x = sorted(y for y in top.values() if y > 0)
        state["ld"] = ld
        if not x:
            state["best"] = 0.0
            return
        n = len(x)
        q1, q3 = x[min(n - 1, n // 4)], x[min(n - 1, 3 * n // 4)]
        state.update(outlier=q3 + 1.5 * (q3 - q1), extreme=q3 + 3 * (q3 - q1), best=x[n - 1 - min(n - 1, s.nth_score)])

    if s.ld_distance >= 0:
        if s.outlier_threshold < 0:
            at(s.ld_distance)
        return state
    need = s.ld_distance_score * max(0.0, max((r[2] for r in rows), default=0.0))
    b = int(max(0.0, max((r[3] for r in rows if r[4] >= s.count_threshold), default=0.0)))
    a = s.ld_distance_min if b >= s.ld_distance_min else 0
    while b - a > 1:
        m = (a + b) // 2
        at(m)
        a, b = (a, m) if state["best"] < need else (m, b)
    return state


@pytest.mark.parametrize("settings", [
    outliers.Settings(ld_distance_min=10, ld_distance_score=0.5, count_threshold=2),
    outliers.Settings(ld_distance_min=100000, ld_distance_score=0.9),
    outliers.Settings(ld_distance_min=10, ld_distance_score=0.0),
    outliers.Settings(ld_distance=50),
    outliers.Settings(ld_distance=50, outlier_threshold=7.5),
    outliers.Settings(ld_distance_min=5, ld_distance_score=0.7, count_threshold=1000),
])
def test_thresholds_match_brute_force(spark, settings):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60), round(rng.expovariate(0.3), 3), float(rng.choice([-1, rng.randrange(400)])), rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame([(i, v, w, s, None if d < 0 else d, c) for i, (v, w, s, d, c) in enumerate(rows)], "qid long, v long, w long, score double, distance double, cnt long")
    got, want = outliers.find_thresholds(df, settings), brute_thresholds(rows, settings)
    assert (got.ld_distance, got.outlier, got.extreme) == (want["ld"], pytest.approx(want["outlier"]), pytest.approx(want["extreme"]))
    found = outliers.collect_outliers(df, got, settings.count_threshold).collect()
    assert {r.qid for r in found} == {i for i, r in enumerate(rows) if r[4] >= settings.count_threshold and r[3] >= want["ld"] and r[2] >= want["outlier"]}


def test_no_outliers_write_no_files(spark, tmp_path):
    (tmp_path / "q").write_text("0 1 10 1 5\n2 3 10 1 5\n")
    got = runs.run(spark, Options(str(tmp_path / "q"), queries_format=4, ld_distance=50, outliers=True, outlier_threshold=9.0, output_stem=str(tmp_path / "out")))
    assert got.main_outliers.count() == 0 and not glob.glob(f"{tmp_path}/out*")


def test_plot_data(spark, tmp_path):
    (tmp_path / "p").write_text("1 2 100 1 0.5\n3 4 -1 0 0.9\n5 6 31 0 0.1\n")
    (tmp_path / "c").write_text("1 2 7\n3 4 9\n5 6 2\n")
    rows = tables.read_plot_rows(spark, str(tmp_path / "p"))
    assert plot.connected(rows).count() == 2 and plot.disconnected(rows).count() == 1
    e = plot.extents(rows).first()
    assert (e.min_score, e.max_score, e.max_distance, e.exponent) == (0.1, 0.5, 100.0, 1)
    counts = tables.read_plot_counts(spark, str(tmp_path / "c"))
    assert [r.v for r in plot.with_counts(rows, counts, 5).orderBy("line_no").collect()] == [1, 3]
    assert plot.with_counts(rows, counts.filter("line_no < 3"), 5).count() == 3
    assert plot.direct(rows).count() == 1 and plot.indirect(rows).count() == 2
    assert tables.read_plot_rows(spark, str(tmp_path / "p"), 2).count() == 2
