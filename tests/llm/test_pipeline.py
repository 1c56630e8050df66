import re

import duckdb
import pytest

import corpus_pipeline
from loomgraph.llm import records
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_minhash import brute as near
from tests.llm.test_records import expected

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def written(spark, sf, tmp_path_factory):
    """What each stage returned, read from Parquet."""
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((before.toPandas(), docs.toPandas()))
    return out


def test_columns_and_order(written):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "token_records"]
    assert all(list(after.columns) == COLUMNS for _, after in written[:4])
    assert list(written[4][1].columns) == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_language_id_keeps_clean_documents(written):
    """What goes has hardly a letter, or is letters without any order; the posteriors' own test has the formulas."""
    before, after = written[0]
    gone = before[~before.doc_id.isin(set(after.doc_id))]
    assert len(after) >= len(before) - 2
    common = {w for t in before.text.dropna() for w in t.lower().split()[:50]}
    assert all(not t or sum(w in common for w in t.lower().split()[50:]) < 0.5 * len(t.split()) for t in gone.text)


def test_near_dedup_keeps_one_of_each_group(written):
    before, after = written[1]
    want = near(list(zip(before.doc_id, before.text)), 5)
    assert set(after.doc_id) == {i for i, (_, c) in want.items() if i == c}


def test_decontamination_drops_what_is_hit(written, sf):
    before, after = written[2]
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    want = contaminated(list(zip(before.doc_id, before.text)), items)
    assert set(after.doc_id) == {r[0] for r in want if not r[5]} and len(after) < len(before)


def test_mix_takes_documents_as_planned(spark, written):
    before, after = written[3]
    from tests.llm.test_mixing import fill

    size = {i: len((t or "").split(" ")) if t is None else len(re.findall("[^ \\t-\\r]+", t)) for i, t in zip(before.doc_id, before.text)}
    source = dict(zip(before.doc_id, before.source))
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    target, largest = fill(sizes), {}
    for i, n in size.items():
        largest[source[i]] = max(largest.get(source[i], 0), n)
    taken = dict.fromkeys(sizes, 0)
    for i, k in after.groupby("doc_id").size().items():
        assert 1 <= k <= 3
        taken[source[i]] += k * size[i]
    # Documents stay whole, so the last one of a source's stretch may add words.
    assert all(target[s] <= taken[s] + 1 and taken[s] - target[s] <= largest[s] for s in sizes)


def test_records_hold_the_tokens(written):
    from tokenizers import Tokenizer

    before, after = written[4]
    rows = sorted(zip(before.doc_id, before.text), key=lambda r: r[0])
    assert sorted(after.itertuples(index=False, name=None)) == expected(rows, Tokenizer.from_file(records.vocabulary_path()))


def test_run_gives_the_last_stage(spark, sf, written):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(written[4][1].itertuples(index=False, name=None))


def test_stages_take_nulls_and_empty_tables(spark, docs, sf):
    odd = docs([(1, None), (2, ""), (None, None, "en", "s"), (3, "a b c d e f g h", "en", None), (3, "a b c d e f g h", "en", None), (4, "x" * 100_000, None, "s")], clash=True)
    for rows in (odd, docs([])):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, sf)
            assert got.count() <= 3 * rows.count()
            if name != "token_records":
                assert got.columns == rows.columns
