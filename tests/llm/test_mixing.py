import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing


def fill(sizes):
    """Targets by trying every number of capped sources."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(mixing.MAX_EPOCHS * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > mixing.MAX_EPOCHS * sizes[s]}
        if not over:
            return {s: float(mixing.MAX_EPOCHS * sizes[s]) if s in capped else weight[s] * level for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 5, None: 7}, {"a": 0, "b": 50}, {"x": 3}, {"a": 2, "b": 1, "c": 90, "d": 1, "e": 400}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(fill(sizes))


def rows(n=300):
    return [(i, " ".join(["w"] * (i * 7 % 40 + (500 if i == 11 else 0))), None, ["s0", "s1", "s2", "s3", None][(i * i) % 7 % 5] if i % 3 else "s0") for i in range(n)] + [(900, None, None, "s1"), (901, " \t\n", None, "s2")]


def test_plan(docs):
    data = rows()
    plan, slots, block = mixing.mix_plan(docs(data, clash=True))
    got = {r.doc_id: r for r in plan.collect()}
    assert len(got) == len(data)
    sizes, want = {}, {}
    for i, text, _, source in data:
        n = len(re.findall(r"[^ \t-\r]+", text or ""))
        assert got[i].size == n and got[i].source == source and 0 <= got[i].taken <= 3 * n
        sizes[source] = sizes.get(source, 0) + n
    want = fill(sizes)
    for s, size in sizes.items():
        mine = [r for r in got.values() if r.source == s]
        assert {r.source_size for r in mine} == {size} and {round(r.target, 6) for r in mine} == {round(want[s], 6)}
        assert abs(sum(r.taken for r in mine) - want[s]) <= 4 * block
        assert sorted((r.start, r.start + r.size) for r in mine if r.size)[0][0] == 0
        spans = sorted((r.start, r.start + r.size) for r in mine if r.size)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == size
    order = slots.orderBy("slot").collect()
    assert [r.slot for r in order] == list(range(len(order)))
    seen = {}
    for r in order:
        assert r["rank"] == seen.get(r.source_id, 0)
        seen[r.source_id] = seen.get(r.source_id, 0) + 1
    # Any stretch of the schedule holds sources in proportion.
    share = seen[1] / len(order)
    part = sum(r.source_id == 1 for r in order[: len(order) // 3])
    assert abs(part - share * len(order) / 3) < 4


def test_reruns_agree_whatever_the_order(docs):
    a = mixing.mix_plan(docs(rows()))[0].select("doc_id", "taken").collect()
    b = mixing.mix_plan(docs(rows()[::-1]).repartition(7))[0].select("doc_id", "taken").collect()
    assert sorted(a) == sorted(b)


def test_mixed_documents(docs):
    df = docs(rows(), clash=True)
    taken = {r.doc_id: r for r in mixing.mix_plan(df)[0].collect()}
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    for i, r in taken.items():
        assert times.get(i, 0) == -(-r.taken // r.size) if r.size else i not in times


def test_ties_empty_and_wordless(docs):
    assert mixing.mix_plan(docs([]))[0].count() == 0 and mixing.mixed_documents(docs([])).count() == 0
    nothing = mixing.mix_plan(docs([(1, None, None, "a"), (2, " ", None, None)]))[0].collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
    twice = mixing.mix_plan(docs([(1, "a b c", None, "s")] * 4))[0].agg(F.sum("taken")).first()[0]
    assert abs(twice - 12) <= mixing.MIN_BLOCK
    assert mixing.mixed_documents(docs([(1, "a b c", None, "s")] * 4)).count() >= 4


def test_small_sources_get_their_targets(docs, monkeypatch):
    """With few, large blocks the schedule names no slot for most of these sources."""
    monkeypatch.setattr(mixing, "SLOTS", 4)
    monkeypatch.setattr(mixing, "MIN_BLOCK", 1)
    data = [(0, "w " * 3000, None, "a")] + [(i, "w " * (i % 7 + 1), None, f"b{i:02d}") for i in range(1, 30)]
    plan = mixing.mix_plan(docs(data))[0].collect()
    assert all(abs(r.taken - r.target) <= 1 and r.taken > 0 for r in plan)


def test_blocks_stop_growing(docs, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 4)
    _, slots, block = mixing.mix_plan(docs([(0, "w " * 20000, None, "a"), (1, "w " * 20000, None, "b")]))
    assert block == mixing.MAX_BLOCK and slots.count() == -(-40000 // block)


def test_pieces_are_ranks_joined_to_blocks(docs):
    rows_, joined, slots, block = mixing._planned(docs(rows()), "doc_id", "text", "source", 0)
    held = {r.row: r for r in rows_.collect()}
    place = {(r.source_id, r["rank"]): r.slot for r in slots.collect()}
    sums, seen = {}, {}
    for r in joined.collect():
        source = held[r.row].source_id
        since = r.epoch * held[r.row].source_size + held[r.row].start
        assert 0 < r.words <= block and since // block <= r["rank"] <= (since + held[r.row].size - 1) // block
        assert r.first == (r["rank"] == since // block)
        if (source, r["rank"]) in place:
            assert r.position == place[source, r["rank"]]
        sums[source, r["rank"]] = sums.get((source, r["rank"]), 0) + r.words
        seen[source] = seen.get(source, 0) + r.words
    # Every block is whole but for a source's last one.
    for source, n in seen.items():
        words = next(h.source_words for h in held.values() if h.source_id == source)
        assert n == words and all(sums[source, k] == min(block, words - k * block) for k in range(-(-words // block)))


def test_mix_is_in_the_order_of_the_slots(docs):
    """Sources that lie one after the other in the table alternate in the mix."""
    data = [(i, " ".join(["w"] * 20), None, "a" if i < 200 else "b") for i in range(400)]
    order = [r.source for r in mixing.mixed_documents(docs(data)).collect()]
    share = order.count("a") / len(order)
    for n in range(40, len(order), 40):
        assert abs(order[:n].count("a") - share * n) < 6
