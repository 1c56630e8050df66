import glob

import pytest

from loomgraph.plans import runs
from loomgraph.sources.errors import InputError
from loomgraph.sources.gfa import genome_links, read_gfa

GFA = """S\t10\tACGTA
S\t20\tGTAC
S\t30\tTTT
S\t40\tGGGGGG
H\tVN:Z:1.0
L\t10\t+\t20\t+\t2M
L\t20\t-\t10\t-\t2M
L\t20\t+\t30\t-\t2M
L\t40\t+\t20\t+\t2M
L\t10\t-\t30\t+\t0M
P\tReference:1_Sequence:g1\t10+,20+,30-\t2M,2M
P\tReference:2_Sequence:g2\t40+,20+,30-\t2M,2M
P\tReference:2_Sequence:g2c2\t20+,30-\t2M
P\tReference:2_Sequence:g2c3\t10+\t*
"""


@pytest.fixture
def gfa_file(tmp_path):
    def write(text=GFA):
        (tmp_path / "in.gfa").write_text(text)
        return str(tmp_path / "in.gfa")

    return write


def lines(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))).splitlines()


def test_golden_outputs(spark, gfa_file, tmp_path):
    stem = str(tmp_path / "out")
    found = runs.parse_gfa(spark, gfa_file(), stem)
    assert {r.name: r.id for r in found.segments.collect()} == {"10": 0, "20": 1, "30": 2, "40": 3}
    assert lines(f"{stem}.unitigs") == ["0 ACGTA", "1 GTAC", "2 TTT", "3 GGGGGG"]
    assert lines(f"{stem}.edges") == ["0 1 FF 2M", "0 2 RF 0M", "1 2 FR 2M", "1 3 RR 2M"]
    assert lines(f"{stem}.fasta") == [">g1", "ccca", ">g2", "accc"]
    assert lines(f"{stem}.counts") == ["1 2", "2 2"]
    assert lines(f"{stem}_paths/edges/reference=1") == ["0 1 FF 2M", "1 2 FR 2M"]
    assert lines(f"{stem}_paths/edges/reference=2") == ["1 3 RR 2M", "1 2 FR 2M"] or lines(f"{stem}_paths/edges/reference=2") == ["1 2 FR 2M", "1 3 RR 2M"]
    assert lines(f"{stem}_paths/counts/reference=2") == ["1 2", "2 2"] and not glob.glob(f"{stem}_paths/counts/reference=1/part-*")
    assert lines(f"{stem}.paths") == [f"{stem}_paths/edges/reference=1", f"{stem}_paths/edges/reference=2"]


def test_genome_links_keep_insertion_order(spark, gfa_file):
    got = genome_links(read_gfa(spark, gfa_file())).orderBy("ref_id", "from_id", "seq").collect()
    assert [(r.ref_id, r.from_id, r.to_id, r.edge_type) for r in got] == [(0, 0, 1, "FF"), (0, 1, 2, "FR"), (1, 1, 3, "RR"), (1, 1, 2, "FR")]


def test_ids_by_first_appearance_with_segments_first(spark, gfa_file):
    got = read_gfa(spark, gfa_file("L\tb\t+\ta\t+\t1M\nS\ta\tAC\nS\tb\tCG\nS\tc\tGT\n"))
    assert {r.name: r.id for r in got.segments.collect()} == {"a": 0, "b": 1, "c": 2}
    assert [(r.from_id, r.to_id, r.edge_type) for r in got.links.collect()] == [(0, 1, "RR")]


def test_same_sequence_twice_and_overlap_a_step(spark, gfa_file):
    got = read_gfa(spark, gfa_file("S\ta\tAC\nS\ta\tAC\nS\tb\tCG\nP\tReference:r_Sequence:s\ta+,b-\t0M,7M\n"))
    assert [(r.from_id, r.to_id, r.edge_type, r.overlap) for r in genome_links(got).collect()] == [(0, 1, "FR", 7)]


@pytest.mark.parametrize("change, message, line", [
    (lambda t: t.replace("H\tVN:Z:1.0\n", "\n"), "empty line", 5),
    (lambda t: t.replace("S\t20\tGTAC", "S\t20\tGTAC\nS\t10\tAAAA"), "several sequences", None),
    (lambda t: t.replace("L\t10\t-\t30", "L\t10\t-\t99"), "undefined segment 99", None),
    (lambda t: t.replace("10+\t*", "99+\t*"), "unknown segment 99", None),
    (lambda t: t.replace("10+,20+,30-\t2M,2M", "10+,20+,30-\t2M"), "neither an overlap for each", 11),
    (lambda t: t.replace("_Sequence:g1", "_Seq:g1"), "needs Reference:", 11),
    (lambda t: t.replace("S\t30\tTTT", "S\t30"), "a segment needs", 3),
    (lambda t: t.replace("L\t10\t-\t30\t+\t0M", "L\t10\t-\t30\t+\t*"), "overlap isn't a number", 10),
    (lambda t: t.replace("L\t10\t-\t30\t+\t0M", "L\t10\t-\t30\t+"), "a link needs", 10),
    (lambda t: t.replace("L\t10\t-", "L\t10\t?"), "neither + nor -", 10),
])
def test_errors(spark, gfa_file, change, message, line):
    with pytest.raises(InputError) as e:
        read_gfa(spark, gfa_file(change(GFA)))
    assert any(message in m and (line is None or n == line) for n, m in e.value.errors), e.value.errors


def test_parse_to_genome_distances(spark, gfa_file, tmp_path):
    """The outputs of a parse, in several parts, are the inputs of a run: listing, edges and unitigs go in as they are."""
    from loomgraph.plans.options import Options

    stem = str(tmp_path / "out")
    runs.parse_gfa(spark, gfa_file(), stem)
    # Every output again, a line a part, as a large one would have many parts.
    for path in (f"{stem}.unitigs", f"{stem}.edges", f"{stem}.paths"):
        text = lines(path)
        spark.createDataFrame(list(enumerate(text)), "n int, value string").repartitionByRange(len(text), "n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
        assert lines(path) == text
    (tmp_path / "q").write_text("0 1\n0 2\n0 3\n1 2\n1 3\n2 3\n1 1\n")
    got = runs.run(spark, Options(str(tmp_path / "q"), f"{stem}.edges", f"{stem}.unitigs", k=3, genomes_file=f"{stem}.paths", output_stem=stem))
    assert [r.distance for r in got.main.orderBy("qid").collect()] == [1, 3, 2, 1, 1, 3, None]
    assert [(r.distance, r.cnt) for r in got.genomes.orderBy("qid").collect()] == [(1, 1), (3, 1), (None, 0), (1, 2), (1, 1), (3, 1), (None, 0)]


def test_line_numbers_go_on_over_parts(spark, tmp_path):
    from loomgraph.sources.scan import numbered_lines

    want = [f"line {i}" for i in range(300)]
    spark.createDataFrame([(i, x) for i, x in enumerate(want)], "n int, value string").repartitionByRange(13, "n").sortWithinPartitions("n").select("value").write.text(str(tmp_path / "folder"))
    got = sorted((r.line_no, r.value) for r in numbered_lines(spark, str(tmp_path / "folder")).collect())
    assert got == [(i + 1, x) for i, x in enumerate(want)]
    (tmp_path / "a b").mkdir()
    for folder, name, text in (("a b", "x", "1\n2\n"), ("folder/..", "x", "3\n4\n5\n")):
        (tmp_path / folder / name).write_text(text)
    paths = [str(tmp_path / "folder"), str(tmp_path / "a b" / "x"), str(tmp_path / "x")]
    got = numbered_lines(spark, paths).collect()
    assert sorted((r.line_no, r.value) for r in got if r.source == 1) == [(1, "1"), (2, "2")]
    assert sorted((r.line_no, r.value) for r in got if r.source == 2) == [(1, "3"), (2, "4"), (3, "5")]
    assert max(r.line_no for r in got if r.source == 0) == 300


def test_references_with_one_sequence_name_and_odd_names(spark, gfa_file, tmp_path):
    """A row a reference, and folders that the listing names as Spark writes them; a reference without links has one, too."""
    stem = str(tmp_path / "out")
    text = "S\ta\tAC\nS\tb\tCG\nP\tReference:x=1/2_Sequence:chr\ta+,b+\t1M\nP\tReference:y:z_Sequence:chr\tb+,a+\t1M\nP\tReference:lone_Sequence:chr\ta+\t*\n"
    runs.parse_gfa(spark, gfa_file(text), stem)
    assert lines(f"{stem}.fasta") == [">chr", "cc", ">chr", "cc", ">chr", "aa"]
    from loomgraph.sources.tables import read_genome_links

    got = read_genome_links(spark, f"{stem}.paths").collect()
    assert sorted((r.genome, r.from_id, r.to_id, r.edge_type) for r in got) == [(0, 0, 1, "FF"), (1, 0, 1, "RR")]


def test_verbose_runs_tell_sizes(spark, gfa_file, tmp_path, caplog):
    caplog.set_level("INFO", logger="loomgraph.plans.runs")
    runs.parse_gfa(spark, gfa_file(), str(tmp_path / "out"))
    assert "4 segments, 4 links, 2 references, 4 path lines" in caplog.text
