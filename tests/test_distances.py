import glob
import heapq
import random

import numpy as np
import pytest

from loomgraph.operators import distances, graph, links, shortest_paths
from loomgraph.plans import runs
from loomgraph.plans.options import Mode, Options
from loomgraph.sources import sinks

UNITIGS = "0 ACGTA\n1 GTAC\n2 TTT\n3 GGGGGG\n"
EDGES = "0 1 FF 2M\n0 2 RF 0M\n1 2 FR 2M\n1 3 RR 2M\n"
GENOMES = {"1.edges": "0 1 FF 2M\n1 2 FR 2M\n", "2.edges": "1 3 RR 2M\n1 2 FR 2M\n"}
QUERIES = "0 1\n0 2\n0 3\n1 2\n1 3\n2 3\n1 1\n"


def lines(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))).splitlines()


@pytest.fixture
def inputs(tmp_path):
    files = {"unitigs": UNITIGS, "edges": EDGES, "queries": QUERIES, **GENOMES, "listing": "".join(f"{tmp_path}/{g}\n" for g in GENOMES)}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    p = lambda n: f"{tmp_path}/{n}"
    return dict(queries_file=p("queries"), edges_file=p("edges"), unitigs_file=p("unitigs"), k=3, genomes_file=p("listing"), output_stem=p("out"))


def test_golden_distances(spark, inputs):
    got = runs.run(spark, Options(**inputs))
    assert [r.distance for r in got.main.orderBy("qid").collect()] == [1, 3, 2, 1, 1, 3, None]
    assert [(r.distance, r.cnt, r.m2, r.min_d, r.max_d) for r in got.genomes.orderBy("qid").collect()] == [(1, 1, 0, 1, 1), (3, 1, 0, 3, 3), (None, 0, None, None, None), (1, 2, 0, 1, 1), (1, 1, 0, 1, 1), (3, 1, 0, 3, 3), (None, 0, None, None, None)]
    main, genomes = lines(inputs["output_stem"] + ".ud_0_based"), lines(inputs["output_stem"] + ".ud_sgg_0_based")
    assert main[0] == "0 1 1 0 1 1" and main[6] == "1 1 -1 0 1.79769e+308 1.79769e+308"
    assert genomes[0] == "0 1 1 1 0 1 1" and genomes[2] == "0 3 -1 0 -1 -1 -1"


def test_limit_is_strict(spark, inputs):
    got = runs.run(spark, Options(**inputs, max_distance=3.0), write=False)
    assert [r.distance for r in got.main.orderBy("qid").collect()] == [1, None, 2, 1, 1, None, None]


def test_ordinary_graph(spark, tmp_path):
    (tmp_path / "e").write_text("0 1 5\n1 0 2\n1 1 9\n1 2\n2 3 60M\n")
    (tmp_path / "q").write_text("1 4\n2 2\n1 9\n")
    got = runs.run(spark, Options(str(tmp_path / "q"), str(tmp_path / "e"), queries_one_based=True), write=False)
    assert [r.distance for r in got.main.orderBy("qid").collect()] == [4, None, None]


def test_tandem_and_loop_links(spark):
    weights = spark.createDataFrame([(0, 7.0)], "unitig long, self_w double")
    links = lambda t: spark.createDataFrame([(0, 0, t)], "from_id long, to_id long, edge_type string")
    assert {(r.a, r.b, r.w) for r in graph.two_sided_graph(weights, links("FF")).collect()} == {(0, 1, 1.0), (1, 0, 1.0)}
    assert {(r.a, r.b, r.w) for r in graph.two_sided_graph(weights, links("FR")).collect()} == {(0, 1, 7.0), (1, 0, 7.0)}


def dijkstra(edges, sources, limit):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    dist, heap = {}, [(0.0, s) for s in sources if s in near]
    while heap:
        d, x = heapq.heappop(heap)
        if x in dist or d >= limit:
            continue
        dist[x] = d
        for y, w in near[x]:
            if y not in dist:
                heapq.heappush(heap, (d + w, y))
    return dist


@pytest.mark.parametrize("seed, limit, two_sided, by", [(1, float("inf"), True, None), (2, 6.0, True, "genome"), (3, float("inf"), False, None), (4, 9.5, False, "genome")])
def test_both_ways_agree_with_dijkstra(spark, seed, limit, two_sided, by):
    rng = random.Random(seed)
    genomes = ["x", "y"] if by else [None]
    edges, want, jobs = [], {}, []
    pairs = {(rng.randrange(40), rng.randrange(44)) for _ in range(150)}
    pairs = {(a, b) for a, b in pairs if a != b}
    for g in genomes:
        n = 80 if two_sided else 40
        own = {}
        for _ in range(110):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                own[min(a, b), max(a, b)] = rng.choice([0.0, 1.0, 2.5, 7.0])
        sym = [(a, b, w) for (a, b), w in own.items()] + [(b, a, w) for (a, b), w in own.items()]
        edges += [((g,) if by else ()) + e for e in sym]
        for s, t in pairs:
            jobs.append(((g,) if by else ()) + (s, t))
            ends = lambda x: (2 * x, 2 * x + 1) if two_sided else (x,)
            d = dijkstra(sym, ends(s), limit)
            best = min((d[x] for x in ends(t) if x in d), default=None)
            if best is not None:
                want[((g,) if by else ()) + (s, t)] = best
    key = "genome string, " if by else ""
    e = spark.createDataFrame(edges, f"{key}a long, b long, w double")
    j = spark.createDataFrame(jobs, f"{key}src long, dst long")
    for way in (shortest_paths.grouped, shortest_paths.relaxation):
        got = way(e, j, two_sided, limit, by).collect()
        assert {tuple(r[:-1]): r.distance for r in got} == want, way


def test_many_buckets_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(shortest_paths, "BUCKET_SOURCES", 3)
    monkeypatch.setattr(shortest_paths, "CELLS", 50)
    n = 30
    e = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "a long, b long, w double")
    j = spark.createDataFrame([(i, (i * 7) % n) for i in range(n)], "src long, dst long")
    assert {(r.src, r.dst): r.distance for r in shortest_paths.grouped(e, j, False).collect()} == {(i, (i * 7) % n): abs(i - (i * 7) % n) for i in range(n)}


def test_empty_inputs(spark):
    e, j = spark.createDataFrame([], "a long, b long, w double"), spark.createDataFrame([], "src long, dst long")
    some = spark.createDataFrame([(1, 2)], "src long, dst long")
    for way in (shortest_paths.grouped, shortest_paths.relaxation):
        assert way(e, j).count() == 0 and way(e, some).count() == 0


@pytest.mark.parametrize("values, want", [([1, 2, 6], (3, 3, 14, 1, 6)), ([4], (4, 1, 0, 4, 4)), ([0], (0, 1, 0, 0, 0))])
def test_moments(spark, values, want):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k long, o long, distance double")
    for got in (distances.moments(df, ("k",)).first(), distances.ordered_moments(df, ("k",), "o").first()):
        assert (got.mean, got.cnt, got.m2, got.min_d, got.max_d) == pytest.approx(want)


def test_duplicate_queries_are_answered_each(spark):
    e = spark.createDataFrame([(0, 2, 5.0), (2, 0, 5.0)], "a long, b long, w double")
    q = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 1, 0)], "qid long, v long, w long")
    assert [r.distance for r in distances.main_distances(q, e).orderBy("qid").collect()] == [5.0] * 3


def test_single_pair(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (1, 0, 5.0)], "a long, b long, w double")
    assert shortest_paths.single_distance(e, 0, 1, False) == 5.0 and shortest_paths.single_distance(e, 0, 7, False) is None


def test_options():
    assert Options("q", "e").mode == Mode.GENERAL
    assert Options("q", "e", "u", 3, "l", outliers=True).mode == Mode.TWO_SIDED | Mode.GENOMES | Mode.OUTLIERS
    assert Options("q", outliers=True).mode == Mode.OUTLIERS
    assert Options.all_one_based(queries_file="q", edges_file="e").output_name("ud") == "out.ud_1_based"
    assert Options("q", "e").output_name("ud_outlier_stats") == "out.ud_outlier_stats"
    for bad in (dict(queries_file=""), dict(queries_file="q"), dict(queries_file="q", edges_file="e", unitigs_file="u"), dict(queries_file="q", edges_file="e", queries_format=6), dict(queries_file="q", outliers=True, queries_format=1), dict(queries_file="q", edges_file="e", genomes_only=True)):
        with pytest.raises(ValueError):
            Options(**bad)


def test_zero_distance_prints_as_unreached_minimum(spark):
    found = spark.createDataFrame([(0, 1, 2, 0.0, 0.0, 0.0, 0.0, 0.5)], "qid long, v long, w long, distance double, m2 double, min_d double, max_d double, score double")
    assert sinks.distance_lines(found, False).first().value == "1 2 0 0.5 0 1.79769e+308 0"


@pytest.mark.parametrize("seed", range(4))
def test_contraction_keeps_distances(spark, seed):
    """Long chains, rings on a stem, rings of their own, and nodes asked for in the middle of a chain."""
    rng = random.Random(seed)
    edges, n = {}, 0

    def chain(a, b, length):
        nonlocal n
        nodes = [a, *range(n, n + length), b]
        n += length
        for x, y in zip(nodes, nodes[1:]):
            if x != y:
                edges[min(x, y), max(x, y)] = rng.choice([0.0, 1.0, 3.5])

    hubs = list(range(6))
    n = 6
    for _ in range(9):
        chain(rng.choice(hubs), rng.choice(hubs), rng.randrange(0, 70))
    ring = n
    n += 1
    chain(ring, ring, 33)
    sym = [(a, b, w) for (a, b), w in edges.items()] + [(b, a, w) for (a, b), w in edges.items()]
    jobs = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)]
    e = spark.createDataFrame(sym, "a long, b long, w double")
    j = spark.createDataFrame(jobs, "src long, dst long")
    want = {}
    for s, t in jobs:
        d = dijkstra(sym, (s,), float("inf"))
        if t in d:
            want[s, t] = d[t]
    for way in (shortest_paths.relaxation, shortest_paths.grouped):
        assert {(r.src, r.dst): r.distance for r in way(e, j, False).distinct().collect()} == pytest.approx(want), way
    core = shortest_paths.contracted(e).collect()
    degree = {}
    for a, _, _ in sym:
        degree[a] = degree.get(a, 0) + 1
    assert all(degree[r.a] != 2 and degree[r.b] != 2 and r.a != r.b for r in core)
    hub = max(hubs, key=lambda x: degree.get(x, 0))
    near = dijkstra([tuple(r) for r in core], (hub,), float("inf"))
    assert all(near.get(x, 0.0) == pytest.approx(d) for x, d in dijkstra(sym, (hub,), float("inf")).items() if degree[x] != 2)


@pytest.mark.parametrize("seed", range(3))
def test_cover_is_that_of_picking_one_by_one(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(30) ** 2 // 30, rng.randrange(60)) for _ in range(150)}
    left = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    want = set()
    rest = set(left)
    while rest:
        count = {}
        for p in rest:
            for x in p:
                count[x] = count.get(x, 0) + 1
        top = max(count, key=lambda x: (count[x], x))
        mine = {p for p in rest if top in p}
        want |= {(top, p[0] + p[1] - top) for p in mine}
        rest -= mine
    df = spark.createDataFrame(sorted(pairs), "v long, w long")
    assert {(r.src, r.dst) for r in shortest_paths.cover_pairs(df, rounds=50).collect()} == want
    few = {(r.src, r.dst) for r in shortest_paths.cover_pairs(df, rounds=1).collect()}
    assert {(min(p), max(p)) for p in few} == left and len(few) == len(left)


@pytest.mark.parametrize("rounds", [0, 1, 2, 6])
def test_a_task_covers_as_joins_do(spark, monkeypatch, rounds):
    """Which of both ways picks sources changes none, whatever the rounds; in a task it takes few jobs."""
    rng = random.Random(rounds)
    far = 1 << 60
    pairs = spark.createDataFrame([(far + rng.randrange(40) ** 2 // 30, far + rng.randrange(60)) for _ in range(200)], "v long, w long")

    def jobs(name):
        spark.sparkContext.setJobGroup(name, name)
        got = sorted((r.src, r.dst) for r in shortest_paths.cover_pairs(pairs, rounds=rounds).collect())
        spark.sparkContext.setJobGroup("none", "none")
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    got, few = jobs(f"task-{rounds}")
    monkeypatch.setattr(shortest_paths, "COVERED", 0)
    want, _ = jobs(f"joins-{rounds}")
    assert got == want and few <= 6


def test_sources_are_picked_once_for_all_genomes(spark, monkeypatch):
    edges = spark.createDataFrame([(g, 2 * u + i, 2 * (u + 1) + j, 1.0) for g in "xyz" for u in range(9) for i, j in ((0, 1), (1, 0))], "genome string, a long, b long, w double")
    both = edges.unionByName(edges.selectExpr("genome", "b AS a", "a AS b", "w"))
    asked = spark.createDataFrame([(q, q % 9, 9 - q % 4, 1.0) for q in range(12)], "qid long, v long, w long, score double")
    seen, real = [], distances.cover_pairs
    monkeypatch.setattr(distances, "cover_pairs", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    got = {r.qid: r for r in distances.genome_moments(asked, both).collect()}
    assert seen == [len({(min(q % 9, 9 - q % 4), max(q % 9, 9 - q % 4)) for q in range(12) if q % 9 != 9 - q % 4})]
    assert all(r.cnt == (3 if r.v != r.w and abs(r.v - r.w) <= 1 else r.cnt) and r.cnt in (0, 3) for r in got.values()) and len(got) == 12


def test_parts_of_a_large_graph_are_searched_apart(spark, monkeypatch):
    """Only a part that is too large for a task goes through joins."""
    monkeypatch.setattr(shortest_paths, "TASK_EDGES", 40)
    sizes, way = [], shortest_paths.relaxation
    monkeypatch.setattr(shortest_paths, "relaxation", lambda edges, *rest: sizes.append(edges.count()) or way(edges, *rest))
    many = [(100 * k + i, 100 * k + i + 1) for k in range(9) for i in range(15 + 20 * (k == 4))] + [(2000 + 10 * k, 2001 + 10 * k) for k in range(50)]
    e = spark.createDataFrame([(x, y, 2.0) for a, b in many for x, y in ((a, b), (b, a))], "a long, b long, w double").repartition(7)
    q = spark.createDataFrame([(100 * k + 3, 100 * m + 12) for k in range(9) for m in range(9)] + [(2000, 2001), (2000, 2011), (2500, 9)], "v long, w long")
    got = {(r.v, r.w): r.distance for r in shortest_paths.pair_distances(e, q, False).collect()}
    assert got == {(100 * k + 3, 100 * k + 12): 18.0 for k in range(9)} | {(2000, 2001): 2.0}
    assert sizes == [70]
    keyed = e.withColumn("genome", shortest_paths.F.expr("IF(a < 450, 'x', 'y')"))
    pairs = q.withColumn("genome", shortest_paths.F.explode(shortest_paths.F.array(*map(shortest_paths.F.lit, "xy"))))
    got = {(r.genome, r.v, r.w): r.distance for r in shortest_paths.pair_distances(keyed, pairs, False, by="genome").collect()}
    assert got == {("x" if k < 5 else "y", 100 * k + 3, 100 * k + 12): 18.0 for k in range(9)} | {("y", 2000, 2001): 2.0}


@pytest.mark.parametrize("seed", range(3))
def test_cores_keep_distances(seed, monkeypatch):
    """Long paths and dead ends cost a search nothing, and neither do very many edges of one node."""
    np = shortest_paths.np
    monkeypatch.setattr(shortest_paths, "WIDE", 4)
    rng = random.Random(seed)
    own = {(0, i): float(rng.randrange(3, 9)) for i in range(1, 12)} | {(i, i + 1): 1.0 for i in range(20, 3000)} | {(5, 20): 2.0, (3000, 7): 1.0} | {(7, 3001 + i): 1.0 for i in range(30)}
    sym = [(a, b, w) for (a, b), w in own.items()] + [(b, a, w) for (a, b), w in own.items()]
    a, b, w = (np.array(x) for x in zip(*sym))
    graph = shortest_paths._Graph(a, b, w)
    kept = np.isin(graph.nodes, (1, 9, 2000))
    core, place = graph.core(kept)
    assert len(core.nodes) <= 7 and (place[kept] >= 0).all()
    want = dijkstra(sym, (2000,), float("inf"))
    src, dst, d = shortest_paths._search(a, b, w, np.array([2000] * 3), np.array([1, 9, 3005]), float("inf"), False)
    assert dict(zip(dst.tolist(), d.tolist())) == {x: want[x] for x in (1, 9, 3005)}


def test_contraction_within_a_task(spark, monkeypatch):
    """Graphs that fit a task take no rounds of joins, and give what joins give."""
    tables = []
    write = shortest_paths.materialize
    monkeypatch.setattr(shortest_paths, "materialize", lambda df, name: tables.append(name) or write(df, name))
    rng = random.Random(5)
    own = {(i, i + 1): float(i % 5) for i in range(400) if i % 90} | {(rng.randrange(400), 500 + i): 1.0 for i in range(20)} | {(600, 601): 1.0, (601, 602): 1.0, (600, 602): 1.0}
    rows = [(g, x, y, w) for g in "pq" for (a, b), w in own.items() for x, y in ((a, b), (b, a)) if g == "p" or a < 300]
    e = spark.createDataFrame(rows, "g string, a long, b long, w double")
    kept = spark.createDataFrame([("p", 33), ("q", 250), ("q", 9999)], "g string, node long")
    near = {tuple(r) for r in shortest_paths.contracted(e, kept, ("g",)).collect()}
    assert tables == ["whole"] and ("p", 33) in {x[:2] for x in near} and ("q", 33) not in {x[:2] for x in near}
    one = {tuple(r) for r in shortest_paths.contracted(e.filter("g = 'p'").drop("g")).collect()}
    monkeypatch.setattr(shortest_paths, "TASK_EDGES", 10)
    assert near == {tuple(r) for r in shortest_paths.contracted(e, kept, ("g",)).collect()}
    assert one == {tuple(r) for r in shortest_paths.contracted(e.filter("g = 'p'").drop("g")).collect()}


def test_small_numbers_give_the_same_distances(monkeypatch):
    rng = random.Random(21)
    links = {(min(a, b), max(a, b)): float(rng.randrange(5)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(130)) if a != b}
    sym = [(a, b, w) for (a, b), w in links.items()] + [(b, a, w) for (a, b), w in links.items()]
    a, b, w = np.array([e[0] for e in sym]), np.array([e[1] for e in sym]), np.array([e[2] for e in sym])
    src, dst = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    src, dst = src[src != dst], dst[src != dst]
    graph = shortest_paths._Graph(a, b, w)
    place = shortest_paths._find(graph.nodes, np.arange(60))
    start, end = place[src] >= 0, place[dst] >= 0
    asked = start & end
    sources, asker = np.unique(src[asked], return_inverse=True)
    both = [graph.distances(place[sources], np.arange(len(sources)), len(sources), [place[dst[asked]]], asker, float("inf"), small) for small in (False, True)]
    assert np.array_equal(*both)
    for limit in (float("inf"), 6.0):
        want = {(s, t): d for s in range(60) for t, d in dijkstra(sym, [s], limit).items() if s != t}
        # The least bound puts most distances beyond small numbers.
        for small in (shortest_paths.SMALL, 5):
            monkeypatch.setattr(shortest_paths, "SMALL", small)
            got = shortest_paths._search(a, b, w, src, dst, limit, False)
            assert {(int(s), int(t)): d for s, t, d in zip(*got)} == want, (limit, small)
        monkeypatch.undo()


@pytest.mark.parametrize("task_links, looked_up, limit", [(3_000_000, 4_000_000, float("inf")), (60, 4_000_000, 6.0), (10, 4_000_000, float("inf"))])
def test_links_that_tasks_build_into_graphs_give_what_built_edges_give(spark, monkeypatch, task_links, looked_up, limit):
    monkeypatch.setattr(shortest_paths, "TASK_LINKS", task_links)
    monkeypatch.setattr(shortest_paths, "LOOKED_UP", looked_up)
    rng = random.Random(8)
    # Six parts of 15 units, links that repeat, units without a weight or with none given, genomes by name, one of them null.
    told = [(rng.choice(["x", "y", None]), 15 * p + rng.randrange(12), 15 * p + rng.randrange(12), rng.choice(["FF", "FR", "RF", "RR"])) for p in range(6) for _ in range(40)]
    given = spark.createDataFrame(told + told[:30], "genome string, from_id long, to_id long, edge_type string").repartition(2)
    weights = spark.createDataFrame([(u, float(rng.randrange(9)) if u % 7 else None) for u in range(90) if u % 11], "unitig long, self_w double")
    asked = {(15 * p + rng.randrange(13), 15 * (p if rng.random() < 0.9 else 0) + rng.randrange(13)) for p in range(6) for _ in range(30)}
    queries = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate(sorted(asked))], "qid long, v long, w long")
    rows = lambda df: sorted(map(str, df.collect()))
    unbuilt = graph.Links(graph.link_edges(given, ("genome",)), weights)
    want = distances.main_distances(queries, graph.two_sided_graph(weights, given.drop("genome").distinct()), limit=limit)
    assert rows(distances.main_distances(queries, unbuilt, limit=limit)) == rows(want)
    want = distances.genome_distances(queries, graph.genome_graphs(weights, given.filter("genome IS NOT NULL").distinct()), limit=limit)
    assert rows(distances.genome_distances(queries, unbuilt, limit=limit)) == rows(want) != []
    none = graph.Links(unbuilt.sides.filter("false"), weights)
    assert distances.genome_distances(queries, none, limit=limit).count() == 0
    assert distances.main_distances(queries, none, limit=limit).filter("distance IS NOT NULL").count() == 0
    assert distances.main_distances(queries.filter("false"), unbuilt, limit=limit).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_thinned_graphs_keep_all_distances(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(shortest_paths, "ROUNDS", 3 * seed + 1)
    links = {(min(p), max(p)): float(rng.choice([0, 1, 1, 1, 5, 20_000] if seed % 2 else [1, 1, 2, 7])) for p in ((rng.randrange(90), rng.randrange(90)) for _ in range(115)) if p[0] != p[1]}
    both = [(a, b, w) for (a, b), w in links.items()] + [(b, a, w) for (a, b), w in links.items()]
    graph = shortest_paths._Graph(*(np.array(x) for x in zip(*both)))
    kept = np.zeros(len(graph.nodes), bool)
    kept[:3] = True
    thin, place, levels = graph.thinned(kept)
    assert (place[:3] >= 0).all() and len(thin.nodes) < 0.8 * len(graph.nodes)
    rows = shortest_paths._Graph.restored(thin.distances(place[:3], np.arange(3), 3), place, levels)
    for i, source in enumerate(graph.nodes[:3]):
        want = dijkstra(both, [source], float("inf"))
        assert rows[:, i].tolist() == [want.get(x, float("inf")) for x in graph.nodes]
    src, dst = np.repeat(graph.nodes[:3], len(graph.nodes)), np.tile(graph.nodes, 3)
    for limit in (float("inf"), 6.0, 30_000.0):
        a, b, w = (np.array(x) for x in zip(*both))
        got = {(s, t): d for s, t, d in zip(*(x.tolist() for x in shortest_paths._search(a, b, w, src, dst, limit, False)))}
        assert got == {(s, t): d for s in graph.nodes[:3].tolist() for t, d in dijkstra(both, [s], limit).items() if d < limit}


def test_sides_of_links_are_those_of_canonical_links(spark):
    rng = random.Random(3)
    told = [(rng.randrange(60) or None, rng.choice([1, 2, 3, None]), rng.choice([4, 5, 6, None]), rng.choice("+-"), rng.randrange(3)) for _ in range(400)]
    steps = spark.createDataFrame(told, "path long, n int, seg long, orient string, overlap long").repartition(3)
    rows = links.canonical(links.adjacent_rows(steps, ("n", "seg", "orient", "overlap")), "from_seg", "to_seg")
    ends = lambda df: sorted((r.path or -1, *sorted((r.a or -1, r.b or -1))) for r in df.collect())
    sides = links.adjacent_sides(steps.selectExpr("path", "n", "seg", "orient = '-' AS minus"), ("n", "seg", "minus"))
    assert ends(sides) == ends(graph.link_edges(rows, ("path",)))
