import base64
import hashlib
import time
from html.parser import HTMLParser

import pytest
from conftest import FOLDER

from farelens.llm import warc
from farelens.llm.common import table

PAGES = "page_id long, url string, html string, block string"
MARKUP = (
    '<!DOCTYPE html><html lang="en"><head><title>A &amp;\n B</title><style>p{}</style></head><body>'
    "<!-- gone <p>no</p> --><nav><a href='/x?a=1&amp;b=2'>X</a></nav><p>One<b>two</b> &lt;3</p>"
    "<script>var t='</p>';</script><ul><li>é<li>漢字</ul>tail\n\n\r\n\r\nWARC/1.0</body></html>"
)


def pages(spark):
    rows = [
        (1, "http://a.b/1", MARKUP, "x"), (1, "http://a.b/1", MARKUP, "x"), (2, None, "plain", "x"), (None, "u", None, "x"),
        (3, "http://c/", "<script>never ends", "x"), (4, "http://d/", "<p>" + "word " * 100_000, "x"), (5, "e", "a < b > c <", "x"),
    ]
    return spark.createDataFrame(rows, PAGES)


def test_records_refer_to_their_response(spark):
    responses = warc.responses_of(pages(spark))
    records = warc.derivatives(responses).collect()
    held = {r.record_id: r for r in responses.collect()}
    assert len(records) == 14 and {r.warc_type for r in records} == {"metadata", "conversion"}
    for r in records:
        source, block = held[r.refers_to], r.block.encode()
        assert r.target_uri == source.target_uri and r.source_payload_digest == source.payload_digest
        assert r.source_headers == source.http_headers and r.content_length == len(block)
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    for r in held.values():
        body = r.payload.encode()
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.block_digest == warc.digest(r.http_headers.encode() + b"\r\n" + body)
    assert len({r.record_id for r in records}) == 12  # the repeated page's records are the same


def test_text_and_fields():
    assert warc.plain_text(MARKUP) == "X\nOnetwo <3\né\n漢字\ntail\nWARC/1.0"
    fields = warc.metadata_block(MARKUP, "H: 1\r\n", "sha1:Z").split("\r\n")
    assert fields == [
        "title: A & B", "language: en", "source-payload-digest: sha1:Z", "source-http-header: H: 1", "outlink: /x?a=1&b=2", "",
    ]
    assert warc.plain_text("") == "" and warc.plain_text("<script>never ends") == ""
    assert warc.plain_text("a < b > c <") == "a < b > c <"


class Reader(HTMLParser):
    """The standard library's reading of a page: shown text, title, language, links."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.titled = [], [], None
        self.language, self.links = "", []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        if tag in ("script", "style", "template", "noscript", "head"):
            self.hidden.append(tag)
        if tag == "title" and self.titled is None:
            self.titled = []
        if tag == "html":
            self.language = self.language or attrs.get("lang") or ""
        if tag == "a" and "href" in attrs:
            self.links.append(attrs["href"] or "")
        if tag in warc.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden.remove(tag)
            self.out.append(" ")
        if tag in warc.BLOCKS:
            self.out.append("\n")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if self.lasttag == "title" and self.titled == []:
            self.titled.append(data)
        if not self.hidden:
            self.out.append(data)

    def text(self):
        return "\n".join(line for line in (" ".join(part.split()) for part in "".join(self.out).split("\n")) if line)


def test_whole_table_equals_another_parser(spark):
    df = table(spark, FOLDER, "pages")
    records = {(r.page_id, r.warc_type): r.block for r in warc.derivatives(warc.responses_of(df)).collect()}
    pages = df.collect()
    assert len(records) == 2 * len(pages)
    for page in pages:
        seen = Reader(page.html or "")
        lines = records[page.page_id, "conversion"].split("\n")
        assert "\n".join(" ".join(line.split()) for line in lines if line.strip()) == seen.text()
        fields = [f.split(": ", 1) for f in records[page.page_id, "metadata"].split("\r\n") if f]
        assert dict(fields)["title"] == " ".join("".join(seen.titled or []).split())
        assert dict(fields)["language"] == seen.language
        assert [v for k, v in fields if k == "outlink"] == [" ".join(link.split()) for link in seen.links]


def test_markup_that_is_hidden_gives_no_fields():
    page = warc.Page(
        "<!-- <title>no</title><a href='no'> --><script>var a = '<title>no</title><a href=\"no\">'</script>"
        "<HTML data-lang=no LANG='pt-BR'><title>T<b>2</title><a data-href=no href='x>y'>l</a><a HREF=z>m</a><a>n</a>"
    )
    assert (page.title, page.language, page.links) == ("T<b>2", "pt-BR", ["x>y", "z"])
    assert page.text() == "T<b>2lmn"


def test_broken_markup():
    shown = {
        "a <b": "a <b", "<head><title>t</title>x": "tx", "<head>x<body>y": "y", "<head>x</head>y": "y", "a<!-- b": "a",
        "<p title=\"a>b\">c": "c", "<p title=\"a>b": "b", "<scripty>a</scripty>": "a", "a<script>b</scripts>c</script >d": "a d",
        "İ<P>x</P>K": "İ\nx\nK", "<style>a<p>": "", "</p>": "", "<>": "<>", "a<?php b?>c": "ac",
    }
    assert {markup: warc.plain_text(markup) for markup in shown} == shown


@pytest.mark.parametrize(
    "part", ["<a", "<head>", "<html ", "<!--", "<script>", "</", '<a b=">" ', "<a href='", "<title>", "<a href = ", "<", "<p>"]
)
def test_time_grows_with_the_text(part):
    for markup in (part * (1_000_000 // len(part)), "<a " + part * (1_000_000 // len(part)) + ">"):
        start = time.process_time()
        warc.fields_of(warc.Page(markup), "", "")
        assert time.process_time() - start < 10  # a fraction of a second; by squares it would be hours


def test_awkward_responses(spark):
    rows = [(1, "r1", "http://a/\r\nWARC-Type: x", "d", None, None, "p", "b"), (None, "r2", None, "d", "H: 1\r\n", "<p>x", "p", "b")]
    records = warc.derivatives(spark.createDataFrame(rows, warc.RESPONSE_SCHEMA)).collect()
    assert sorted((r.refers_to, r.warc_type, r.target_uri, r.source_headers) for r in records) == [
        ("r1", "conversion", "http://a/\r\nWARC-Type: x", ""), ("r1", "metadata", "http://a/\r\nWARC-Type: x", ""),
        ("r2", "conversion", "", "H: 1\r\n"), ("r2", "metadata", "", "H: 1\r\n"),
    ]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_line_breaks_in_a_target_are_read_back(spark, tmp_path, compression):
    rows = [(1, "http://a/\r\nx\n%0D", MARKUP, "x"), (2, "http://b/%0D%0A", "y", "x")]
    records = warc.derivatives(warc.responses_of(spark.createDataFrame(rows, PAGES)))
    warc.write_warc(records, str(tmp_path / "w"), compression)
    key = lambda r: (r.record_id, r.block)
    back = sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=key)
    assert back == sorted(records.drop("page_id").collect(), key=key)


def test_files_read_back(spark, tmp_path):
    records = warc.derivatives(warc.responses_of(pages(spark)))
    warc.write_warc(records, str(tmp_path / "w"))
    key = lambda r: (r.record_id, r.block)
    back = sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=key)
    assert back == sorted(records.drop("page_id").collect(), key=key)


def test_empty_table(spark):
    assert warc.derivatives(warc.responses_of(spark.createDataFrame([], PAGES))).count() == 0
