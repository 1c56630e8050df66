import hashlib
import re

from loomgraph.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        same = [j for (j, _), m in zip(rows, norm) if m == n]
        out.append((i, min((x for x in same if x is not None), default=None), len(same), hashlib.sha256(n.encode()).hexdigest()))
    return out


ROWS = [(1, "a  b"), (2, "a b"), (3, "a\tb\n"), (4, "a b "), (5, ""), (6, None), (7, " "), (8, "ü" * 5000), (9, "ü" * 5000), (10, "unique"), (None, "a b"), (None, "alone")]


def test_groups_match_brute_force(docs):
    got = exact_dedup.exact_groups(docs(ROWS, clash=True)).collect()
    have = sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=str)
    assert have == sorted(brute(ROWS), key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.digest for r in got}) == len({r.digest for r in kept})


def test_repeated_rows_keep_one(docs):
    got = exact_dedup.exact_groups(docs([(1, "x"), (1, "x"), (1, "x"), (0, "y")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]


def test_empty_table(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs([])).count() == 0


def test_drop_keeps_all_columns(docs):
    df = docs(ROWS, clash=True)
    got = exact_dedup.drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([1, 3, 5, 7, 8, 10, None], key=str)


def flagged(df, words):
    keys = df.select("doc_id", exact_dedup.cell(exact_dedup.text_digest(df.text), words).alias("cell"))
    return exact_dedup.with_flag(keys, "cell", *exact_dedup.repeated_cells(keys.select("cell"), words), "maybe").collect()


def test_filter_has_no_false_negatives(docs, monkeypatch):
    df = docs([(i, f"t{i % 700}") for i in range(1000)])
    repeated = lambda i: i < 300 or i >= 700
    for words, folded, most in ((exact_dedup.word_count(1000), 1 << 22, 40), (1 << 14, 16, 400), (1 << 14, 1, 400), (64, 1 << 22, 100)):
        monkeypatch.setattr(exact_dedup, "FILTER_WORDS", folded)
        got = flagged(df, words)
        assert len(got) == 1000 and all(r.maybe for r in got if repeated(r.doc_id))
        assert sum(r.maybe for r in got if not repeated(r.doc_id)) <= most, (words, folded)


def test_result_is_the_same_with_a_folded_filter(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 2)
    test_groups_match_brute_force(docs)
    test_drop_keeps_all_columns(docs)


def test_sql_gives_the_same(spark, sf):
    import duckdb

    got = exact_dedup.query(spark, sf)
    want = duckdb.connect().execute(exact_dedup.ORACLE.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want)


def test_unique_rows_send_a_number_only(spark, sf):
    """What is dealt by cell has the cell and its count; nothing else of a unique row is shuffled."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    plan = exact_dedup.exact_groups(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan
    text = exact_dedup.drop_exact_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    unique = text[text.index("Union") :].split("\n:- ")[-1] if "\n:- " in text else text
    assert "BroadcastHashJoin" in unique and "SortMergeJoin" not in text


def test_plan_runs_no_python(spark, sf):
    plan = exact_dedup.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
