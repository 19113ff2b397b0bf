import gzip
import hashlib
from pathlib import Path

import pytest

from eigenweave.llm import warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(1, "http://a/x", "<html><head><title> One\n two </title></head><body><p>Hi &amp; bye</p><script>no()</script><a href='q'>link</a></body></html>"),
         (2, "http://a/y", ""), (3, None, None), (3, None, None), (None, "u", "plain <b>bold"), (5, "http://a/z", "<p>" + "word " * 200_000)],
        "page_id long, url string, html string",
    )


def test_derivatives(spark, pages):
    rows = warc.derive(warc.responses_from_pages(pages)).collect()
    assert len(rows) == 12
    by = {(r["page_id"], r["warc_type"]): r for r in rows}
    m, c = by[1, "metadata"], by[1, "conversion"]
    assert m["refers_to"] == c["refers_to"] != m["record_id"] != c["record_id"]
    assert c["block"] == "Hi & bye\nlink" and "title: One two" in m["block"] and "outlinks: 1" in m["block"]
    for r in rows:
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        head, block = warc.parse_warc(r["record"].encode())[0]
        assert block.decode() == r["block"] and head["warc-refers-to"] == r["refers_to"] and int(head["content-length"]) == r["content_length"]
        assert head["warc-source-payload-digest"] == r["source_digest"]
    assert by[3, "conversion"]["block"] == "" and by[2, "conversion"]["block"] == "" and by[None, "conversion"]["block"] == "plain bold"
    assert len(by[5, "conversion"]["block"]) == 200_000 * 5 - 1


def test_unclosed_script_hides_the_rest(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a<script>b",), ("<!-- x",), ("<style>s</style >t",), ("<h1>A</h1>B<br/>C",)], "h string").select(warc.plain_text(F.col("h"))).collect()
    assert [r[0] for r in got] == ["a", "", "t", "A\nB\nC"]


def test_files(spark, pages, tmp_path):
    d = warc.derive(warc.responses_from_pages(pages.where("page_id < 4")))
    path = str(tmp_path / "out")
    warc.write_warc(d, path)
    back = warc.read_warc(spark, path + "/*.gz")
    assert sorted(r["payload"] for r in back.collect()) == sorted(r["block"] for r in d.collect())
    assert {r["refers_to"] for r in back.collect()} == {r["refers_to"] for r in d.collect()}
    body = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>gone</p>"
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://t/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "r.warc").write_bytes(raw)
    r = warc.read_warc(spark, str(tmp_path / "r.warc")).first()
    assert (r["status"], r["content_type"], r["payload"], r["warc_type"]) == (404, "text/html", "<p>gone</p>", "response")


def _warc(kind, number, block, *more):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", "WARC-Date: 2023-05-06T07:08:09Z", *more, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_responses_of_a_file_are_derived(spark, tmp_path):
    latin = "<html><head><title>Caf\u00e9</title><body><p>d\u00e9j\u00e0 vu</p></body></html>".encode("latin-1")
    one = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Folded: left\r\n right\r\n\r\n" + latin
    two = b"HTTP/1.1 404 Gone\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n<p>g\r\n7\r\none</p>\r\n0\r\n\r\n"
    file = _warc("warcinfo", 1, b"software: x\r\n") + _warc("request", 2, b"GET / HTTP/1.1\r\n\r\n")
    file += _warc("response", 3, one, "WARC-Target-URI: http://a/x", "WARC-IP-Address: 192.0.2.7", "WARC-Payload-Digest: sha1:ABCDEF", "Content-Type: application/http; msgtype=response")
    file += _warc("response", 4, two, "WARC-Target-URI: http://a/y") + _warc("response", 4, two, "WARC-Target-URI: http://a/y") + _warc("response", 5, b"")
    members = [gzip.compress(file[:200]), gzip.compress(file[200:])]
    (tmp_path / "r.warc.gz").write_bytes(b"".join(members))
    source = warc.read_warc(spark, str(tmp_path / "r.warc.gz"), batch_bytes=1)
    assert source.count() == 6
    rows = warc.derive(source).collect()
    by = {(r["refers_to"], r["warc_type"]): r for r in rows}
    assert len(rows) == 8 and "page_id" not in rows[0].asDict()
    m, c = by["<urn:uuid:3>", "metadata"], by["<urn:uuid:3>", "conversion"]
    assert c["block"] == "d\u00e9j\u00e0 vu" and c["date"] == "2023-05-06T07:08:09Z" and c["target_uri"] == "http://a/x"
    fields = [x.partition(": ")[::2] for x in m["block"].split("\r\n") if x]
    assert [v for k, v in fields if k == "http-header-Set-Cookie"] == ["a=1", "b=2"]
    assert {("title", "Caf\u00e9"), ("http-status", "200"), ("source-record-id", "<urn:uuid:3>"), ("source-payload-digest", "sha1:ABCDEF"), ("warc-header-WARC-IP-Address", "192.0.2.7"), ("http-header-X-Folded", "left right"),
            ("warc-header-Content-Length", str(len(one))), ("warc-header-WARC-Payload-Digest", "sha1:ABCDEF")} <= set(fields)
    assert m["source_digest"] == c["source_digest"] == "sha1:ABCDEF"
    gone = by["<urn:uuid:4>", "conversion"]
    assert gone["block"] == "gone" and gone["source_digest"] == "sha256:" + hashlib.sha256(b"<p>gone</p>").hexdigest() and by["<urn:uuid:5>", "conversion"]["block"] == ""
    out = str(tmp_path / "derived")
    warc.write_warc(warc.derive(source), out)
    back = warc.read_warc(spark, out + "/*.gz").collect()
    assert sorted((r["record_id"], r["payload"]) for r in back) == sorted((r["record_id"], r["block"]) for r in rows)
    for r in back:
        head = {h["name"]: h["value"] for h in r["headers"]}
        assert head["WARC-Block-Digest"] == r["raw_digest"] and head["WARC-Refers-To"] in {"<urn:uuid:3>", "<urn:uuid:4>", "<urn:uuid:5>"}


def test_plain_text_by_a_parser(spark):
    """The text of pages against a parser of another make."""
    from html.parser import HTMLParser

    from pyspark.sql import functions as F

    blocks = set("p div br hr h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table section article header footer nav main blockquote pre form head body html".split())

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], None

        def handle_starttag(self, tag, attrs):
            self.hidden = self.hidden or (tag if tag in ("script", "style", "title", "template") else None)
            self.out.append("\n" if tag in blocks else " " if self.hidden else "")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.hidden = None if tag == self.hidden else self.hidden
            self.out.append("\n" if tag in blocks else "")

        def handle_data(self, data):
            self.out.append("" if self.hidden else data)

    def lines(text):
        return [" ".join(x.split()) for x in text.replace("\xa0", " ").split("\n") if x.split()]

    texts = ["<head><title>T</title><body><p>All the text", "<p>a &amp;lt; b&nbsp;&eacute; &#233;&#xE9; &euro; &#128; &unknown; &#0; &#x1F600; &#55296;</p>", "<ul><li>x<li>y</ul>z<template>no</template>!", "a &amp b &", "<title>only"]
    if Path(SF).is_dir():
        texts += [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect() if r[0]]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, h string").select("k", warc.plain_text(F.col("h"))).collect()
    for k, t in got:
        if k in (3, 4):
            assert t == ("a &amp b &", "")[k - 3]
            continue
        want = Text()
        want.feed(texts[k])
        want.close()
        assert lines(t) == lines("".join(want.out)), texts[k]


def test_columns_with_clashing_names(spark, pages):
    from pyspark.sql import functions as F

    more = pages.select("*", *[F.lit("own").alias(c) for c in ("block", "record_id", "payload", "k", "type", "status", "date")])
    key = lambda d: sorted(r["record"] for r in warc.derive(warc.responses_from_pages(d)).collect())
    assert key(more) == key(pages)


def test_empty(spark, pages):
    assert warc.derive(warc.responses_from_pages(pages.limit(0))).count() == 0


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = warc.op1_warc_derivatives(spark, SF)
    want = con.sql(warc.OP1_SQL).df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))
