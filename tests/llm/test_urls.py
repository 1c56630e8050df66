import pytest

from loomgraph.llm import urls

PAGES = "page_id long, url string, html string"


def page(i, url, *links):
    return i, url, "".join(f'<a class="x" href="{x}">t</a>' for x in links)


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "1 AS rule").select("page_id", "url", "html", "rule")


CASES = [
    ("https://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    ("http://example.net", "example.net", "", None, None),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://example.com/de/#f", "example.com", "/de/", "example.com/de/", "block"),
    ("http://x.org/fr/a?b/c", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://xorg/fr/", "xorg", "/fr/", None, None),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b?://c/d", "b", "", None, None),
    ("http://ÀB.com\n/de/", "Àb.com\n", "/de/", None, None),
]


def test_hosts_paths_and_rules(spark, pages):
    got = {r.page_id: r for r in urls.judged(pages([(i, c[0], None) for i, c in enumerate(CASES)])).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict


def brute(seeds, edges, damping=urls.DAMPING):
    edges = [e for e in edges if e[0] != e[1]]
    nodes = set(seeds) | {x for e in edges for x in e[:2]}

    def walk(seed, steps):
        out = {}
        for s, t, n in steps:
            out[s] = out.get(s, 0) + n
        score = dict.fromkeys(nodes, 0.0)
        for _ in range(300):
            moved = dict.fromkeys(nodes, 0.0)
            for s, t, n in steps:
                moved[t] += score[s] * n / out[s]
            score = {x: (1 - damping) * seed.get(x, 0.0) + damping * moved[x] for x in nodes}
        return score

    def part(index, steps):
        score, base = walk({h: s[index] for h, s in seeds.items()}, steps), walk(dict.fromkeys(nodes, 1.0), steps)
        own = {h: base[h] - (0 if sum(seeds.get(h, (0, 0))) else 1 - damping) for h in nodes}
        return {h: score[h] / own[h] if own[h] > 1e-9 else 0.0 for h in nodes}

    trust, distrust = part(0, edges), part(1, [(t, s, n) for s, t, n in edges])
    return {h: (trust[h], distrust[h]) for h in nodes}


def spread(spark, seeds, edges):
    s = spark.createDataFrame([(h, *map(float, v)) for h, v in seeds.items()], "host string, trusted double, blocked double")
    e = spark.createDataFrame(edges, "source string, target string, links long")
    return {r.host: (r.trust, r.distrust) for r in urls.spread(s, e).collect()}


def test_scores_match_brute_force(spark):
    seeds = {"good": (1.0, 0.0), "bad": (0.0, 1.0), "mid": (0.3, 0.2), "alone": (0.0, 0.5)}
    edges = [("good", "mid", 3), ("good", "far", 1), ("mid", "bad", 2), ("mid", "mid", 5), ("linker", "bad", 9), ("far", "good", 1)]
    # A chain of 40 hosts and a ring, longer than any fixed number of rounds that would do for the rest.
    edges += [(f"c{i}", f"c{i + 1}", 1) for i in range(40)] + [("c40", "bad", 1)] + [(f"r{i}", f"r{(i + 1) % 12}", 1) for i in range(12)] + [("good", "r0", 1)]
    got, want = spread(spark, seeds, edges), brute(seeds, edges)
    assert set(got) == set(want)
    for h in want:
        assert got[h] == pytest.approx(want[h], abs=2e-3), h


@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_a_farm_is_as_suspect_as_one_linker(spark, n):
    """Distrust doesn't shrink with the number of hosts that share it, and one bad link among many isn't enough."""
    edges = [(f"farm{i}", "bad", 1 + i) for i in range(n)] + [("list", f"site{i}", 1) for i in range(50)] + [("list", "bad", 1)]
    got = spread(spark, {"bad": (0, 1)}, edges)
    assert all(got[f"farm{i}"][1] == pytest.approx(1.0) for i in range(n))
    assert got["list"][1] < 0.1 and got["site1"] == (0.0, 0.0)


def test_ties_are_allowed(pages):
    """A host that links to a blocked and is linked from an allowed host, alike."""
    rows = [page(1, "http://a.org/fr/", "http://mid.info/"), page(2, "http://spam.net/"), page(3, "http://mid.info/", "http://spam.net/")]
    got = {r.page_id: r for r in urls.judged(pages(rows)).collect()}
    assert got[3].trust == got[3].distrust == 1.0 and got[3].verdict == "allow"


def test_unclosed_markup_takes_linear_time(spark, pages):
    import time

    began = time.time()
    df = pages([(1, "http://a.net/", "<a " * 600_000), (2, "http://b.net/", "<a href=" * 200_000 + "x>"), (3, "http://c.net/", "<a hrefhref " + " href" * 200_000)])
    assert {r.page_id for r in urls.judged(df).collect()} == {1, 2, 3} and time.time() - began < 60


def test_links_and_thresholds(spark, pages):
    rows = [page(1, "http://spam.net/x"), page(2, "http://farm.info/", "http://spam.net/x", "//SPAM.net/y"), page(3, "http://fine.info/", "/own", "b.html", "mailto:me@x", "http://x.org/fr/"), page(4, "http://x.org/fr/")]
    df = pages(rows)
    edges = {(r.source, r.target): r.links for r in urls.host_edges(df.select(urls.host(df.url).alias("host"), "html")).collect()}
    assert edges == {("farm.info", "spam.net"): 2, ("fine.info", "fine.info"): 2, ("fine.info", "x.org"): 1}
    got = {r.page_id: r.verdict for r in urls.judged(pages(rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_empty_and_repeated(pages):
    assert urls.judged(pages([])).count() == 0
    assert [r.verdict for r in urls.judged(pages([page(1, "http://a.net/")] * 3)).collect()] == ["block"] * 3
