"""Every registered query of the corpus operators over the whole of a small table, against SQL or plain Python."""

import hashlib
import re

import duckdb
import pytest

from loomgraph.llm import queries, records
from tests.llm.test_mixing import fill
from tests.llm.test_records import expected
from tests.llm.test_secrets import slow_spans


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_there_is_a_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, sf, tables, name):
    got = queries.QUERIES[name](spark, sf)
    found = tables.execute(queries.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(found.fetchall())


def documents(tables, *columns):
    return tables.execute(f"SELECT {', '.join(columns)} FROM documents ORDER BY doc_id").fetchall()


def test_url_verdicts(spark, sf, tables):
    """Hosts, paths and rules of each page; a page that no rule judges is blocked if half its host's pages are."""
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    want, by_host = {}, {}
    for i, url in tables.execute("SELECT page_id, url FROM pages").fetchall():
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.split("[/?#]", rest, maxsplit=1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if rest is not None else ""
        path = re.split("[?#]", rest, maxsplit=1)[0][len(host) :] if rest is not None else ""
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None)
        by_host.setdefault(host, []).append(want[i][3])
    got = {r.page_id: r for r in queries.QUERIES["op2_url_trust"](spark, sf).collect()}
    assert set(got) == set(want)
    for i, (host, path, rule, said) in want.items():
        votes = by_host[host]
        if said is None:
            said = "block" if host and 2 * votes.count("block") >= len(votes) and votes.count("block") > votes.count("allow") else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, said)


def test_language_of_labelled_documents(spark, sf, tables):
    rows = {i: (t, lang) for i, t, lang in documents(tables, "doc_id", "text", "lang")}
    got = {r.doc_id: r for r in queries.QUERIES["op5_language_id"](spark, sf).collect()}
    assert set(got) == set(rows)
    said = [i for i, (t, lang) in rows.items() if t and lang and len(t) > 200]
    assert len(said) > 100 and sum(got[i].lang == rows[i][1] for i in said) >= 0.98 * len(said)
    assert sum(got[i].kept for i in said) >= 0.99 * len(said)


def test_mix(spark, sf, tables):
    rows = {i: (len(re.findall("[^ \\t-\\r]+", t or "")), s) for i, t, s in documents(tables, "doc_id", "text", "source")}
    sizes = {}
    for n, s in rows.values():
        sizes[s] = sizes.get(s, 0) + n
    target = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    got = queries.QUERIES["op7_source_mix"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        size, source = rows[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[source]) and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 3 * size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_secrets(spark, sf, tables):
    kinds = ("assign", "access", "hex")
    got = {r.doc_id: r for r in queries.QUERIES["op8_secret_scan"](spark, sf).collect()}
    rows = documents(tables, "doc_id", "text")
    assert len(got) == len(rows)
    for i, text in rows:
        spans = slow_spans(text)
        said = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("random:")] == said


def test_token_records(spark, sf, tables):
    from tokenizers import Tokenizer

    got = queries.QUERIES["op9_token_records"](spark, sf).collect()
    assert sorted(map(tuple, got)) == expected(documents(tables, "doc_id", "text"), Tokenizer.from_file(records.vocabulary_path()))


def test_fuzzy_lines_of_the_table(spark, sf, tables):
    """What goes is what edit similarity groups, by line, but for pairs that share no block."""
    from tests.llm.test_lines import brute

    rows = [(i, "\n".join(x[:120] for x in (t or "").split("\n")[:6])) for i, t in documents(tables, "doc_id", "text")[:60]]
    want, _ = brute(rows)
    from loomgraph.llm import lines

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line) for r in lines.repeated_lines(df).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    whole = queries.QUERIES["op6_fuzzy_lines"](spark, sf).collect()
    texts = dict(documents(tables, "doc_id", "text"))
    for r in whole:
        gone = {int(x) for x in r.removed.split(",") if x}
        left = "\n".join(x for k, x in enumerate((texts[r.doc_id] or "").split("\n")) if k not in gone)
        assert len(gone) == r.n_removed and r.text_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert len(whole) == len(texts)
