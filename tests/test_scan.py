import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import ids, links
from loomgraph.sources import scan, tables
from loomgraph.sources.errors import InputError


def test_line_numbers_over_many_blocks(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 700)):
        (tmp_path / name).write_text("".join(f"{name} {i} \r{'x' * (i % 50)}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = scan.numbered_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 3700 and all(int(r.value.split()[1]) == r.line_no and r.value.split()[0] in r.file for r in got)


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    df = spark.createDataFrame([values], ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, values)))
    return df.select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("text, want", [("a,,b", ["a", "", "b"]), ("a,", ["a"]), ("a,,", ["a", ""]), ("", []), (",", [""]), ("a", ["a"])])
def test_split_fields(spark, text, want):
    assert one(spark, lambda c: scalars.split_fields(c, ","), text) == want


@pytest.mark.parametrize("text, want", [("60M", 60), ("0", 0), (" +7x", 7), ("M6", None), ("*", None), ("", None)])
def test_leading_integer(spark, text, want):
    assert one(spark, scalars.leading_integer, text) == want


@pytest.mark.parametrize("text, want", [("2", 2.0), ("2.5e1", 25.0), (".5", 0.5), ("5d", 1.0), ("inf", 1.0), ("60M", 1.0), ("", 1.0), (None, 1.0), ("-3", -3.0)])
def test_edge_weight(spark, text, want):
    assert one(spark, scalars.edge_weight, text) == want


def test_significant_prints_like_c(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -1.0, 3.0, 14.0, 0.1, 1e-5, 123456.0, 1234567.0, 999999.5, 1e100, 1.79769e308, 2 / 3, -0.00012345678, 100000.0]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 12) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.significant(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in got if r.s != "%g" % r.v] == []


def test_small_formats(spark):
    assert one(spark, scalars.spaced_thousands, 1234567) == "1 234 567"
    assert one(spark, scalars.truncated_ratio, 2, 3) == 0.66
    assert one(spark, scalars.path_reference, "Reference:a b_Sequence:c_Sequence:d") == "a b"
    assert one(spark, scalars.path_sequence, "Reference:a b_Sequence:c_Sequence:d") == "c_Sequence:d"
    assert one(spark, scalars.fixed_distance, None) is None or True
    assert scalars.elapsed(3725) == "1h2m5s" and scalars.elapsed(59) == "59s"


def test_canonical_form_is_stable(spark):
    rows = [(a, b, x, y) for a in range(3) for b in range(3) for x in "+-" for y in "+-"]
    once = links.canonical(spark.createDataFrame(rows, "from_id long, to_id long, from_orient string, to_orient string")).collect()
    for (a, b, x, y), r in zip(rows, once):
        kind = {"+": "F", "-": "R"}[x] + {"+": "F", "-": "R"}[y]
        want = {"FF": "RR", "RR": "FF"}.get(kind, kind) if a > b else kind
        assert (r.from_id, r.to_id, r.edge_type) == (min(a, b), max(a, b), want)


def test_dense_ids_over_buckets(spark, monkeypatch):
    rows = [(f"n{i}", i * 7 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "name string, line_no long")
    got = ids.dense_ids(df, ["line_no"], [F.floor(F.col("line_no") / 64)]).collect()
    assert all(r.id == r.line_no for r in got) and len(got) == 1000


LAYOUT_LINES = {0: "3 4", 1: "3 4 0.5", 2: "3 4 17.9 0.5", 3: "3 4 17.9 1 0.5", 4: "3 4 17.9 0.5 6", 5: "3 4 17.9 0 0.5 6"}


@pytest.mark.parametrize("layout", range(6))
def test_layouts(spark, tmp_path, layout):
    path = tmp_path / "q"
    path.write_text(f"{LAYOUT_LINES[layout]}\n" * 3)
    n = len(LAYOUT_LINES[layout].split())
    assert tables.infer_layout(n, outliers_only=layout == 4) == layout
    r = tables.read_queries(spark, str(path), layout, n_queries=2, one_based=True, outliers_only=layout in (4, 5)).collect()
    assert len(r) == 2 and [x.qid for x in r] == [0, 1] and (r[0].v, r[0].w) == (2, 3)
    assert r[0].cnt == (6 if layout >= 4 else 1)
    if layout:
        assert r[0].score == 0.5
    if layout >= 4:
        assert r[0].distance == 17.0
    if layout in (3, 5):
        assert r[0].flag is (layout == 3)
    assert ("distance" in r[0]) == (layout in (4, 5))


def test_query_errors(spark, tmp_path):
    (tmp_path / "q").write_text("1 2 0.5\n1 2\n")
    with pytest.raises(InputError, match="line 2: fewer than 3 columns"):
        tables.read_queries(spark, str(tmp_path / "q"))
    (tmp_path / "r").write_text("1 2 3 4 5 6 7\n")
    with pytest.raises(InputError, match="layout"):
        tables.read_queries(spark, str(tmp_path / "r"))
    with pytest.raises(FileNotFoundError):
        tables.read_queries(spark, str(tmp_path / "none"))
    (tmp_path / "e").write_text("0 1 -2\n")
    with pytest.raises(InputError, match="negative"):
        tables.read_edges(spark, str(tmp_path / "e"))
    (tmp_path / "u").write_text("0 AC\n")
    with pytest.raises(InputError, match="shorter than k"):
        tables.read_unitigs(spark, str(tmp_path / "u"), 3)


def test_links_of_steps_in_rows_are_those_of_paths_in_arrays(spark):
    rng = random.Random(5)
    rows = [(p, rng.randrange(4), rng.randrange(5), rng.choice("+-"), rng.choice([None, 0, 7])) for p in range(60) for _ in range(rng.randrange(6))]
    steps = spark.createDataFrame(rows, "path long, at long, seg long, orient string, overlap long")
    paths = steps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "seg", "orient", "overlap"))).alias("s"))
    want = links.adjacency(paths.selectExpr("path", "transform(s, x -> struct(x.seg AS seg, x.orient AS orient)) AS steps", "s.overlap AS overlaps"))
    got = links.adjacent_rows(steps, ("at", "seg", "orient", "overlap"))
    assert got.columns == want.columns and got.count() > 50
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
