import glob

import pytest

from loomgraph import __main__ as cli
from loomgraph.plans.options import Mode


def test_defaults_and_flags():
    args = cli.parser().parse_args("distances -E e -Q q -1 -x -l 5 -Cc 3 -ot 2.5 -d 9".split())
    o = cli.options(args)
    assert o.mode == Mode.GENERAL | Mode.OUTLIERS and o.graph_one_based and o.queries_one_based and o.output_one_based
    assert (o.ld_distance, o.count_threshold, o.outlier_threshold, o.max_distance, o.n_queries, o.output_stem) == (5, 3, 2.5, 9.0, -1, "out")
    with pytest.raises(ValueError):
        cli.options(cli.parser().parse_args(["distances"]))


def test_parse_then_distances(spark, tmp_path):
    (tmp_path / "g").write_text("S\ta\tACGT\nS\tb\tGTAA\nL\ta\t+\tb\t+\t2M\n")
    cli.main(["parse", str(tmp_path / "g"), str(tmp_path / "o")])
    (tmp_path / "q").write_text("1 2 0.25\n")
    cli.main(["distances", "-E", str(tmp_path / "o.edges"), "-U", str(tmp_path / "o.unitigs"), "-k", "3", "-Q", str(tmp_path / "q"), "-1q", "-o", str(tmp_path / "r")])
    (part,) = glob.glob(f"{tmp_path}/r.ud_0_based/part-*")
    assert open(part).read() == "0 1 1 0.25 0 1 1\n"
