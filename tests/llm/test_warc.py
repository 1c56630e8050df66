import base64
import gzip
import hashlib
from html.parser import HTMLParser

import pytest

from loomgraph.llm import warc

HTML = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B
 title</title><meta name="description" content="About &quot;it&quot;"><link rel=canonical href="/canon"><style>p{}</style>
<script>var x = "<p>no</p>";</script></head><body><!-- hidden <p> --><p>One  two<br>three</p><div>x &lt; y &copy; <a href='b?c=1&amp;d=2'>link</a>
</div><img src="i.png"><script>left open <p>gone</p>"""
PAGES = [(1, "http://x.org/a/", HTML), (2, None, "<p>no address"), (3, "http://x.org/", None), (4, "http://x.org/", ""), (None, "http://[bad", '<a href="q">q</a>é漢'), (5, "http://x.org/big", "<p>word</p>" * 40000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS record_id", "1 AS headers")


def test_text_and_facts():
    assert warc.plain_text(HTML) == "A & B title\nOne two\nthree\nx < y © link"
    facts = warc.page_facts(HTML, "http://x.org/a/")
    assert facts["title"] == "A & B title" and facts["metas"] == {"description": 'About "it"'} and facts["canonical"] == "http://x.org/canon"
    assert [x["url"] for x in facts["links"]] == ["http://x.org/canon", "http://x.org/a/b?c=1&d=2", "http://x.org/a/i.png"]


def test_derivatives_are_linked(pages):
    made = warc.responses(pages)
    source = {r.record_id: r for r in made.collect()}
    got = warc.derivatives(made, "page_id").collect()
    assert len(source) == len(PAGES) and len(got) == 2 * len(PAGES) == len({r.record_id for r in got})
    html = {i: h or "" for i, _, h in PAGES}
    for r in got:
        of = source[r.refers_to]
        f, s = warc.fields(r.headers), warc.fields(of.warc_headers)
        assert f["WARC-Refers-To"] == s["WARC-Record-ID"] and f.get("WARC-Target-URI") == s.get("WARC-Target-URI") == r.target_uri
        assert f["WARC-Date"] == s["WARC-Date"] and f["WARC-Source-Payload-Digest"] == s["WARC-Payload-Digest"] == r.source_payload_digest == warc.digest(html[r.id].encode())
        assert f["WARC-Source-Block-Digest"] == s["WARC-Block-Digest"]
        assert f["WARC-Block-Digest"] == r.block_digest == warc.digest(bytes(r.block)) and int(f["Content-Length"]) == len(r.block)
        if r.record_type == "conversion":
            assert bytes(r.block).decode() == warc.plain_text(html[r.id])
        else:
            import json

            envelope = json.loads(bytes(r.block))["Envelope"]
            assert envelope["WARC-Header-Metadata"] == s and envelope["HTTP-Response-Metadata"]["Status-Line"] == "HTTP/1.1 200 OK"
    assert sorted(r.record_id for r in got) == sorted(r.record_id for r in warc.derivatives(warc.responses(pages.repartition(3)), "page_id").collect())


def test_files_round_trip(spark, pages, tmp_path):
    got = warc.derivatives(warc.responses(pages), "page_id")
    warc.write_warc(got, f"{tmp_path}/w")
    back = {r.record_id: r for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    rows = got.collect()
    assert len(back) == len(rows)
    for r in rows:
        b = back[r.record_id]
        assert bytes(b.payload) == bytes(r.block) and b.warc_headers == r.headers and b.record_type == r.record_type


def test_responses_from_files(spark, tmp_path):
    blocks = []
    for i in range(3):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-N: {i}\r\n\r\n".encode()
        body = f"<title>T{i}</title><p>caf\xe9 WARC/1.0\r\n\r\n{i}".encode("latin-1")
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Date: 2024-01-0{i + 1}T00:00:00Z\r\nWARC-Payload-Digest: sha1:P{i}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n".encode()
        blocks.append(head + http + body + b"\r\n\r\n")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:i>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + b"".join(blocks))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, blocks)))
    for name, n in (("a.warc", 4), ("b.warc.gz", 3)):
        records = warc.read_warc(spark, f"{tmp_path}/{name}")
        assert records.count() == n
        got = [r for r in warc.derivatives(records).collect() if r.record_type == "conversion"]
        assert {bytes(r.block).decode() for r in got} == {f"T{i}\ncafé WARC/1.0 {i}" for i in range(3)}
        assert {(r.refers_to, r.source_payload_digest, r.warc_date) for r in got} == {(f"<urn:uuid:{i}>", f"sha1:P{i}", f"2024-01-0{i + 1}T00:00:00Z") for i in range(3)}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(none), "page_id").count() == 0


class Reader(HTMLParser):
    """Text of well-formed pages, apart from the operator's own code."""

    BLOCKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav aside main blockquote pre hr dd dt dl form title head body html".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag in ("a", "link", "img", "iframe", "area"):
            to = dict(attrs).get("href") or dict(attrs).get("src")
            if to:
                self.links.append(to)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("\n", " "))

    def text(self):
        lines = (" ".join(x.replace("\xa0", " ").split(" ")).split() for x in "".join(self.out).split("\n"))
        return "\n".join(" ".join(x) for x in lines if x)


def test_query_matches_an_independent_reader(spark, sf):
    """Every page of the table: both records, their links, texts and digests, by Python's own HTML parser and hashes."""
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = warc.query(spark, sf).collect()
    assert len(got) == 2 * len(rows) and sorted(r.page_id for r in got) == sorted([*rows, *rows])
    for r in got:
        html = rows[r.page_id].html or ""
        reader = Reader()
        reader.feed(html)
        sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
        assert r.source_payload_digest == sha1(html.encode()) and r.target_uri == rows[r.page_id].url and r.n_links == len(reader.links)
        if r.record_type == "conversion":
            assert (r.block_digest, r.content_length) == (sha1(reader.text().encode()), len(reader.text().encode()))
    assert {r.refers_to for r in got if r.record_type == "metadata"} == {r.refers_to for r in got if r.record_type == "conversion"}


def test_unclosed_markup_takes_linear_time():
    import time

    began = time.time()
    for page in ("<a " * 400_000, "<p " * 400_000, "<x " * 300_000 + "<p>", "<meta " * 200_000, "<title" * 200_000, "<!--" * 300_000, "<script" * 200_000, "<a " + "a" * 2_000_000 + ">", "<a " + "b " * 700_000 + ">", "<a x='" * 200_000 + ">", "</script " * 200_000, "<" * 1_500_000):
        warc.plain_text(page)
        warc.page_facts(page, "http://x.org/")
    assert time.time() - began < 30
    assert warc.plain_text("a<p>b <c") == "a\nb <c" and warc.page_facts("<title>open <b", None)["title"] == "open <b"


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, None, None), (None, None, None), (7, "http://a/", "<p>x"), (7, "http://a/", "<p>x")]
    got = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id").collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 4
