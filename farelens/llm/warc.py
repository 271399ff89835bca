"""Web archive derivatives: metadata and plain-text records that refer to the responses they come from.

Each response gives one ``metadata`` record (title, language, links, source headers and digests as
fields) and one ``conversion`` record (the visible text). Both name the response in WARC-Refers-To,
repeat its target and date, and carry digests of their own blocks; the response's payload digest and
its HTTP headers are kept with them. Records are made row by row, so nothing is shuffled.

A page's markup is read in one scan. Title and links count where they are markup: not in comments,
scripts, styles, templates or noscript, whose content is skipped. Text of a closed head is not shown.

Defined cases: null url or html count as empty and still give both records; broken markup, such as
a script that never ends, ends with the text; a tag without its ``>`` is text; a head that neither
closes nor meets a body is shown; a line break in a target URI is written as %0D or %0A, with the URI
itself in a header of its own; a null URI or HTTP header of a response counts as empty, a null payload
too; rows equal in id and content give equal records; an
empty table gives none; other input columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: names that are URLs
FETCHED = "1970-01-01T00:00:00Z"  # the tables hold no fetch time
BREAK = "\r\n"
OWN_URI = "X-Target-URI"  # the target URI in base64, where it holds line breaks
GZIP = b"\x1f\x8b"  # fixed value: how compressed files begin

RESPONSE_SCHEMA = (
    "page_id long, record_id string, target_uri string, date string, http_headers string,"
    " payload string, payload_digest string, block_digest string"
)
RECORD_SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string,"
    " content_type string, content_length long, block_digest string, source_payload_digest string,"
    " source_headers string, block string"
)

# Elements whose content is not markup, and of these the ones that are never shown.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])") for name in ("script", "style", "template", "noscript", "title")}
UNSEEN = RAW.keys() - {"title"}
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p"
    " pre section table td th tr ul".split()
)
TAG_STARTS = frozenset("abcdefghijklmnopqrstuvwxyz!?")
NAME = re.compile(r"[^\s/>]+")
VALUE_OR_END = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"([^\s=>/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
LANGUAGE = re.compile(r"[A-Za-z0-9-]+")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_name(*parts: str) -> str:
    """A record id that a rerun gives again."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '\n'.join(parts))}>"


class Page:
    """What one scan of a page's markup finds: shown text, title, language and link targets.

    The scan goes from ``<`` to ``<`` and never back: each search either ends where the scan goes on, or
    finds nothing up to the text's end and is not made again. Its work grows with the text, also on
    hostile markup.
    """

    def __init__(self, markup: str) -> None:
        folded = markup.lower()
        self.markup, self.folded = markup, folded if len(folded) == len(markup) else markup.translate(_FOLD)
        self.shown: list[str] = []
        self.title, self.language = None, ""
        self.links: list[str] = []
        self.no_more: set[str] = set()  # what does not occur from here to the end
        self.quotes = True  # whether quoted values may hold the end of a tag
        self.head: int | None = None  # where in ``shown`` an open head's text begins
        self._scan()

    def _find(self, wanted: str, at: int) -> int:
        if wanted in self.no_more:
            return -1
        found = self.folded.find(wanted, at)
        if found < 0:
            self.no_more.add(wanted)
        return found

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag at ``at``; -1 for none.

        Quoted values may hold others. Once a tag has no end by that rule, the first ``>`` ends it and
        all later ones.
        """
        end = self._find(">", at)
        if end < 0 or not self.quotes or self.folded.find("=", at, end) < 0:
            return end
        while (found := VALUE_OR_END.search(self.folded, at)) and found[1]:
            closing = self._find(found[1], found.end())
            at = found.end() if closing < 0 else closing + 1
        self.quotes = found is not None
        return found.start() if found else end

    def _scan(self) -> None:
        text, folded, shown, done = self.markup, self.folded, self.shown, 0
        at = folded.find("<")
        while at >= 0:
            following = folded[at + 1 : at + 3]
            if following == "!-" and folded.startswith("<!--", at):
                shown += (text[done:at], " ")
                end = self._find("-->", at + 4)
                done = len(text) if end < 0 else end + 3
                at = folded.find("<", done)
                continue
            closes = following[:1] == "/"
            first = following[closes : closes + 1]
            if first not in TAG_STARTS:
                at = folded.find("<", at + 1)
                continue
            end = self._tag_end(at)
            if end < 0:
                at = self._find("<!--", at)  # no tag ends from here on; a comment may still begin
                continue
            name = NAME.match(folded, at + 1 + closes, end)[0]
            shown.append(text[done:at])
            done = self._closing(name, end) if closes else self._opening(name, at, end)
            at = folded.find("<", done)
        shown.append(text[done:])

    def _closing(self, name: str, end: int) -> int:
        if name in BLOCKS:
            self.shown.append("\n")
        elif name == "head":
            self._end_head()
        return end + 1

    def _opening(self, name: str, at: int, end: int) -> int:
        """Take in an opening tag; gives where the scan goes on."""
        after = end + 1
        if name == "body":
            self._end_head()
        if name in BLOCKS:
            self.shown.append("\n")
        elif name == "head" and self.head is None:
            self.head = len(self.shown)
        elif name == "a":
            href = self._value("href", at + 2, end)
            if href is not None:
                self.links.append(href)
        elif name == "html" and not self.language:
            language = LANGUAGE.match(self._value("lang", at + 5, end) or "")
            self.language = language[0] if language else ""
        elif name in RAW:
            closing = RAW[name].search(self.folded, after)
            stop = closing.start() if closing else len(self.markup)
            if name in UNSEEN:
                self.shown.append(" ")
            else:
                self.shown.append(self.markup[after:stop])
                self.title = self.markup[after:stop] if self.title is None else self.title
            gone = self._find(">", stop) + 1 if closing else 0
            return gone or len(self.markup)
        return after

    def _end_head(self) -> None:
        if self.head is not None:
            self.shown[self.head :] = [" "]
            self.head = None

    def _value(self, name: str, start: int, end: int) -> str | None:
        """An attribute's value; the first, if it is given more than once."""
        if self.folded.find(name, start, end) < 0:
            return None
        for found in ATTRIBUTE.finditer(self.markup, start, end):
            if found[1].translate(_FOLD) == name:
                return found[2] or found[3] or found[4] or ""
        return None

    def text(self) -> str:
        """What the page shows, one line per block element."""
        return LINES.sub("\n", BLANKS.sub(" ", entities.unescape("".join(self.shown)))).strip()


def plain_text(markup: str) -> str:
    return Page(markup).text()


def one_line(value: str) -> str:
    return " ".join(value.split())


def metadata_block(markup: str, headers: str, payload_digest: str) -> str:
    return fields_of(Page(markup), headers, payload_digest)


def fields_of(page: Page, headers: str, payload_digest: str) -> str:
    """Fields of the metadata record, one per line."""
    fields = [
        ("title", one_line(entities.unescape(page.title or ""))),
        ("language", page.language),
        ("source-payload-digest", payload_digest),
    ]
    fields += [("source-http-header", line) for line in headers.split(BREAK) if line]
    fields += [("outlink", one_line(entities.unescape(link))) for link in page.links]
    return "".join(f"{name}: {value}{BREAK}" for name, value in fields)


def _responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for page, url, markup in zip(pages["page_id"], pages["url"], pages["html"], strict=True):
            url, body = url or "", (markup or "").encode()
            headers = (
                f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: {len(body)}{BREAK}"
            )
            found = digest(body)
            rows.append(
                (
                    None if pd.isna(page) else page, record_name("response", str(page), url, found), url, FETCHED,
                    headers, markup or "", found, digest(headers.encode() + b"\r\n" + body),
                )
            )
        yield pd.DataFrame(rows, columns=NAMES_OF_RESPONSES).astype({"page_id": "Int64"})


def _derivatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for responses in batches:
        rows = []
        for r in responses.itertuples(index=False):
            page = None if pd.isna(r.page_id) else r.page_id
            seen = Page(r.payload or "")
            for kind, content_type, block in (
                ("metadata", "application/warc-fields", fields_of(seen, r.http_headers or "", r.payload_digest)),
                ("conversion", "text/plain", seen.text()),
            ):
                held = block.encode()
                rows.append(
                    (
                        page, kind, record_name(kind, r.record_id), r.record_id, r.target_uri or "", r.date,
                        content_type, len(held), digest(held), r.payload_digest, r.http_headers or "", block,
                    )
                )
        yield pd.DataFrame(rows, columns=NAMES_OF_RECORDS).astype({"page_id": "Int64"})


NAMES_OF_RESPONSES = [c.split()[0] for c in RESPONSE_SCHEMA.split(",")]
NAMES_OF_RECORDS = [c.split()[0] for c in RECORD_SCHEMA.split(",")]


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records for pages (page_id, url, html) that were fetched without an archive."""
    return pages.select("page_id", "url", "html").mapInPandas(_responses, RESPONSE_SCHEMA)


def derivatives(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response."""
    return responses.select(*NAMES_OF_RESPONSES).mapInPandas(_derivatives, RECORD_SCHEMA)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derivative records as archive files, one or more per partition.

    A compressed file is one gzip member. For readers that seek to single records, pass "none".
    """
    field = lambda name, column: F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(BREAK))
    uri = F.replace(F.replace(F.col("target_uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    plain = lambda column: F.regexp_replace(F.base64(column.cast("binary")), r"\s", "")
    own_uri = F.when(
        uri != F.col("target_uri"), F.concat(F.lit(f"{OWN_URI}: "), plain(F.col("target_uri")), F.lit(BREAK))
    )
    record = F.concat(
        F.lit(f"WARC/1.0{BREAK}"), field("WARC-Type", "warc_type"), field("WARC-Record-ID", "record_id"),
        field("WARC-Refers-To", "refers_to"), F.lit("WARC-Target-URI: "), uri, F.lit(BREAK), F.coalesce(own_uri, F.lit("")), field("WARC-Date", "date"),
        field("WARC-Block-Digest", "block_digest"),
        field("X-Source-Payload-Digest", "source_payload_digest"),
        F.lit("X-Source-Headers: "), plain(F.col("source_headers")),
        F.lit(BREAK),
        field("Content-Type", "content_type"), field("Content-Length", "content_length"), F.lit(BREAK), F.col("block"),
    )
    records.select(record).write.option("lineSep", BREAK * 2).option("compression", compression).text(path)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import gzip

    for files in batches:
        for content in files["content"]:
            data, at, rows = gzip.decompress(content) if content[:2] == GZIP else content, 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                head = dict(line.split(": ", 1) for line in data[at:end].decode().split(BREAK)[1:])
                start, size = end + 4, int(head["Content-Length"])
                block = data[start : start + size]
                if digest(block) != head["WARC-Block-Digest"]:
                    raise ValueError(f"{head['WARC-Record-ID']}: the block is not the one that was written")
                rows.append(
                    (
                        None, head["WARC-Type"], head["WARC-Record-ID"], head["WARC-Refers-To"],
                        base64.b64decode(head[OWN_URI]).decode() if OWN_URI in head else head["WARC-Target-URI"],
                        head["WARC-Date"], head["Content-Type"], size,
                        head["WARC-Block-Digest"], head["X-Source-Payload-Digest"],
                        base64.b64decode(head["X-Source-Headers"]).decode(), block.decode(),
                    )
                )
                at = start + size + 4
            yield pd.DataFrame(rows, columns=NAMES_OF_RECORDS).astype({"page_id": "Int64"})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that ``write_warc`` made, with their digests checked; one file at a time."""
    files = spark.read.format("binaryFile").load(f"{path}/part-*").select("content")
    return files.mapInPandas(_records, RECORD_SCHEMA).drop("page_id")
