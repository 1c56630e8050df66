import hashlib
import re

import pytest

from loomgraph.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(documents, items, width=10):
    wins = {}
    for item, text in items:
        ws = words(text)
        if item is not None:
            for s in range(max(1, len(ws) - width + 1) if ws else 0):
                wins.setdefault(tuple(ws[s : s + width]), set()).add(str(item))
    out = []
    for i, text in documents:
        ws, hit, found = words(text), set(), set()
        for n in {len(w) for w in wins}:
            for s in range(len(ws) - n + 1):
                if tuple(ws[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(ws[s : s + n])]
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, LONG), (2, "Ünique short ITEM"), (2, "second text of two"), (10, "solo"), (3, None), (4, "..."), (None, "nobody owns this item of ten words in the table"), (11, LONG)]
DOCUMENTS = [
    (1, f"x {LONG.upper()} y"),
    (2, "prefix, " + LONG.replace(" ", "-\n") + "."),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (4, "Ünique short item ünique SHORT item"),
    (5, "solo solo, Solo"),
    (6, None),
    (7, ""),
    (8, "!!!"),
    (9, LONG + " " + LONG + " second text of two"),
    (10, " " + LONG),
    (11, "nobody owns this item of ten words in the table"),
    (12, ("filler words " * 3000) + LONG),
    (None, "solo act"),
    (13, "solo act"),
    (13, "other act"),
]


@pytest.mark.parametrize("documents, items", [(DOCUMENTS, ITEMS), ([], ITEMS), (DOCUMENTS, []), (DOCUMENTS, [(1, None)])])
def test_query_matches_brute_force(spark, docs, tmp_path, documents, items):
    docs(documents, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS words").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontam.query(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(documents, items)


def test_remove_keeps_clean_rows_and_columns(spark, docs):
    df = docs(DOCUMENTS, clash=True)
    got = decontam.remove_contaminated(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((3, DOCUMENTS[2][1]), (6, None), (7, ""), (8, "!!!"), (11, DOCUMENTS[10][1]), (13, "other act")), key=str)


def test_phrases_of_any_length(spark, docs):
    phrases = spark.createDataFrame([(1, ["b", "c"]), (2, ["z"]), (3, ["a", "a", "a"])], "phrase_id long, words array<string>")
    got = decontam.phrase_matches(docs([(1, "a b c b c"), (2, "c b z"), (3, "A a a a")]), phrases).collect()
    assert {(r.doc_id, h.phrase_id, h.start) for r in got for h in r.hits} == {(1, 1, 1), (1, 1, 3), (2, 2, 2), (3, 3, 0), (3, 3, 1)}


def test_proximity(spark, docs):
    phrases = spark.createDataFrame([(1, ["rare", "common", "word"]), (2, ["lone"])], "phrase_id long, words array<string>")
    rows = [(1, "word x common x rare"), (2, "rare " + "x " * 9 + "common word"), (3, "common word common word"), (4, "lone"), (5, None)]
    got = decontam.proximity_matches(docs(rows), phrases, slop=4).collect()
    assert {(r.doc_id, r.phrase_id, r.pos) for r in got} == {(1, 1, 4), (4, 2, 0)}


def test_plan_runs_no_python(spark, sf):
    plan = decontam.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
