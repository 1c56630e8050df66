import random

import numpy as np
import pytest

from loomgraph.llm import components, minhash


def shingles(text, width):
    w = (text or "").encode().lower().replace(b"\x1c", b"\x1c").split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent=80):
    """{id: (size, component)} for unique ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                p, q = find(ids[x]), find(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed=3):
    """Chains and stars of edits, borderline pairs, copies, short and empty texts."""
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 200, 900]))]
        rows += [" ".join(base)] * 2
        rows += [edited(base, rng.randrange(0, max(2, len(base) // 20)), rng) for _ in range(14)]
        step = base
        for _ in range(5):
            step = edited(step, max(1, len(step) // 90), rng).split()
            rows.append(" ".join(step))
    rows += ["", None, " \n", "one", "One", "one two", "one two three", "ONE two\tthree", "a b c d", "a b c d e"]
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 60))) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width, seed", [(4, 3), (5, 8)])
def test_components_match_brute_force(docs, width, seed):
    rows = corpus(seed)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(rows, clash=True), width=width).collect()}
    want = brute(rows, width)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in got.items())


def test_large_group_of_near_copies(docs):
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(160)]
    rows = [(i, edited(base, rng.randrange(0, 9), rng)) for i in range(400)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), width=4).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_nulls_repeats_and_empty(docs):
    text = "the same text of quite some words in a row"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "another text that nobody else has here"), (None, None), (3, None), (3, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (None, None, True), (3, 3, True), (3, 3, True)], key=str)
    assert minhash.near_duplicates(docs([])).count() == 0
    assert minhash.drop_near_duplicates(docs([])).count() == 0


def test_drop_keeps_columns(docs):
    df = docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "x y z")], clash=True)
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, None]


def test_signature_is_the_minimum_of_each_hash():
    rng = np.random.default_rng(5)
    for n in (1, 3, 500, 9000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        low = x & np.uint64(0xFFFFFFFF)
        want = np.array([((low * a + b) >> np.uint64(32)).min() for a, b in zip(minhash.MULTIPLY, minhash.ADD)], np.uint32)
        assert (minhash.signature(x) == want).all()


def test_minima_estimate_similarity():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = minhash.signature(pool[:2000]), minhash.signature(pool[1000:])
    assert abs((a == b).mean() - 1 / 3) < 0.15


@pytest.mark.parametrize("edges, want", [
    ([], {}),
    ([(1, 2), (2, 3), (4, 5), (5, 4), (6, 6)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}),
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(500, i) for i in range(40)], {**{i: 0 for i in range(40)}, 500: 0}),
])
def test_connected_components(spark, edges, want):
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("rows", [components.FOREST_ROWS, 0])
def test_components_of_many_links(spark, monkeypatch, rows):
    """Both ways to components, of ids that doubles can't tell apart; more links than a task takes in at a time."""
    monkeypatch.setattr(components, "FOREST_ROWS", rows)
    monkeypatch.setattr(components, "FOREST_CHUNK", 100)
    n, far = 2000, 1 << 62
    links = [(i + far, i + 1 + far) for i in range(n) if i % 7] + [(i - far, i + 3 - far) for i in range(0, 900, 9)]
    known = components.materialize(components.connected_components(spark.createDataFrame(links, "a long, b long")), "known")
    more = [(far + 7, far + 701), (-far, far + 14)]
    got = components.merged_components(known, components.materialize(spark.createDataFrame(more, "a long, b long"), "more")).collect()
    least = {x: x for link in links + more for x in link}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links + more:
        p, q = sorted((find(a), find(b)))
        least[q] = p
    assert len(got) == len(least) and {r.id: r.component for r in got} == {x: find(x) for x in least}


def test_components_of_more_links_than_a_crumb_are_not_shuffled(spark):
    n = spark.range(150_000)
    found = components.connected_components(n.selectExpr("id AS a", "id + 150000 AS b"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.selectExpr("count(*)", "sum(component)").first()[:] == (300_000, 2 * sum(range(150_000)))


def test_one_id_with_two_texts(docs):
    """Rows that share an id stay apart: each is linked by its own text, and goes or stays by it."""
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(1, a), (1, b), (0, b), (0, b), (2, a + " more")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(rows)).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False)]
    left = sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs(rows)).collect())
    assert left == [(0, b), (0, b), (1, a)]


def test_very_long_texts(docs):
    """A text of 300,000 words is used whole: one that differs in a fiftieth of its words is linked, one that differs in a tenth isn't."""
    words = [f"w{i}" for i in range(300_000)]
    near = [w if i % 50 else "x" + w for i, w in enumerate(words)]
    far = [w if i % 10 else "y" + w for i, w in enumerate(words)]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(docs([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])).collect()}
    assert got == {1: (1, 299_996), 2: (1, 299_996), 3: (3, 299_996)}
