"""One parse of each page: visible text, links, branding, directory blocks and linked data.

The parser keeps one list of text pieces and one of links; a block remembers
only where it began in both, so nested blocks cost nothing extra. The rows of
`parse_pages` feed every later operator, so no page is parsed twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.constants import EMAIL
from vouch.session import tidy

TEXT_LIMIT, BLOCK_LIMIT = 80_000, 1_800
#: Pages that are taken apart at once, and characters of markup from which on there are fewer: a parsed page takes many times its markup.
PART, PART_CHARS = 64, 1 << 20
HIDDEN = frozenset(("script", "style", "noscript"))
BLOCKS = frozenset(("div", "li", "tr", "article", "section", "p", "address"))
ADDRESS = re.compile(EMAIL)
PROTECTED = "/cdn-cgi/l/email-protection#"
TAG, LINK = re.compile("<[^>]*>"), re.compile('<a [^>]*href="([^"]+)"')


def collapsed(pieces: list[str]) -> str:
    return " ".join(" ".join(pieces).split())


def decode_protected(code: str) -> str | None:
    """The address behind a hex code whose first byte is the key of the others; none if it isn't one."""
    try:
        key, *rest = bytes.fromhex(code)
        address = bytes(b ^ key for b in rest).decode()
    except ValueError:
        return None
    return address if ADDRESS.fullmatch(address) else None


class Page(HTMLParser):
    """What one page holds; feed it once."""

    def __init__(self):
        super().__init__()
        self.visible: list[str] = []
        self.hrefs: list[str] = []  # as written
        self.targets: list[str] = []  # decoded, with protected addresses
        self.branding: list[str] = []
        self.title: str | None = None  # of the first title that ends, without tags
        self.blocks: list[tuple[str, list[str]]] = []
        self.linked_data: list = []
        self.open: list[tuple[str, int, int]] = []
        self.hidden = self.brand = self.named = 0
        self.script: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        href = given.get("href") or ""
        if tag in BLOCKS:
            begin = (tag, len(self.visible), len(self.targets))
        code = given.get("data-cfemail") or (href.partition(PROTECTED)[2] if PROTECTED in href else "")
        if code and (address := decode_protected(code)):
            self.targets.append("mailto:" + address)
        if tag in BLOCKS:
            self.open.append(begin)
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "script":
            self.script = [] if given.get("type") == "application/ld+json" else None
        elif tag in ("title", "h1"):
            self.brand, self.named = self.brand + 1, len(self.branding)
        elif tag == "meta" and given.get("property") == "og:site_name":
            self.branding.append(given.get("content") or "")
        elif tag == "img" and "logo" in f"{given.get('class') or ''} {given.get('src') or ''}".lower():
            self.branding.append(given.get("alt") or "")
        elif tag == "a" and href:
            self.hrefs.append(href)
            self.targets.append(unquote(href).strip())

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
        if not self.hidden:
            self.visible.append(data)
        if self.brand:
            self.branding.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script:
            try:
                self.linked_data.append(json.loads("".join(self.script)))
            except ValueError:
                pass
        if tag == "script":
            self.script = None
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("title", "h1"):
            self.brand = max(0, self.brand - 1)
        if tag == self.lasttag == "title" and self.title is None:
            self.title = "".join(self.branding[self.named :])
        # A block ends only by its own tag: one left open hides the blocks around it.
        if self.open and self.open[-1][0] == tag:
            _, piece, target = self.open.pop()
            text = collapsed(self.visible[piece:])
            if text and len(text) <= BLOCK_LIMIT:
                self.blocks.append((text, self.targets[target:]))

    @property
    def whole(self) -> str:
        return collapsed(self.visible)

    @property
    def text(self) -> str:
        """As far as the reference reads; no query reads this, `parse_pages` gives the whole."""
        return self.whole[:TEXT_LIMIT]

    @property
    def written(self) -> str:
        return " ".join(self.visible)

    def people(self) -> list[dict]:
        """All objects of type Person in the linked data, outer ones first."""
        out, todo = [], list(reversed(self.linked_data))
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                kinds = value.get("@type", [])
                if kinds == "Person" or isinstance(kinds, list) and "Person" in kinds:
                    out.append(value)
                todo += [v for v in reversed(value.values()) if isinstance(v, (dict, list))]
            elif isinstance(value, list):
                todo += reversed(value)
        return out


class Written(Page):
    """A page whose texts keep their references as written (`&quot` is no quote to everyone); attributes and scripts are read as ever."""

    def feed(self, data: str) -> None:
        fed = data.replace("&", "&amp;")
        super().feed(fed)
        if not self.rawdata:
            return
        # Where a page ends inside a tag, comment or script, only whole tags are cut out from there on.
        rest = self.rawdata.replace("&amp;", "&")
        end = rest.rfind(">") + 1
        text, last = TAG.sub(" ", rest[:end]) + rest[end:], rest.find("<a ", end)
        if self.visible and fed[: -len(self.rawdata)][-1:] != ">":  # it goes on with the last text
            text = self.visible.pop() + text
        self.visible.append(text)
        tags = [*TAG.findall(rest[:end]), rest[last:] if last >= 0 else ""]
        self.hrefs += [unescape(m[1]) for tag in tags if (m := LINK.match(tag))]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, [(name, value and unescape(value)) for name, value in attrs])

    def handle_data(self, data: str) -> None:
        super().handle_data(data.replace("&amp;", "&") if self.cdata_elem else data)


def parsed(html: str | None, kind: type[Page] = Page) -> Page:
    page = kind()
    page.feed(html or "")
    return page


def resolved(base: str, hrefs: list[str]) -> list[str | None]:
    """Links against a page's URL, fragments cut; null for what can't be resolved."""
    out = []
    for href in hrefs:
        try:
            out.append(urljoin(base, href).partition("#")[0])
        except ValueError:
            out.append(None)
    return out


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most PART rows, fewer where a part's texts in a column reach PART_CHARS characters."""
    for batch in batches:
        begin = chars = 0
        for at, n in enumerate(pc.utf8_length(batch.column(column)).to_pylist()):
            chars += n or 0
            if at + 1 - begin == PART or chars >= PART_CHARS:
                yield batch.slice(begin, at + 1 - begin)
                begin, chars = at + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


BLOCK = pa.struct([("text", pa.string()), ("links", pa.list_(pa.string()))])


def parse_pages(pages: DataFrame, written: bool = False) -> DataFrame:
    """One row for each distinct url of pages (url, html), null counting as one: whole text, title, links, branding, blocks, people (JSON).

    Of a url's pages that with the smallest page_id counts, and is told as
    page_id; without page_ids that with the smallest html. Where that is null,
    so are text, title and links. With `written`, texts keep their references,
    and the page's text its white space, as written.
    """
    if "page_id" in pages.columns:
        ident = f", page_id {pages.schema['page_id'].dataType.simpleString()}"
        once = pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id"))
    else:
        ident, once = "", pages.groupBy("url").agg(F.min("html").alias("html"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            urls, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [parsed(html, Written if written else Page) for html in htmls]
            lists, missing = pa.list_(pa.string()), np.array([html is None for html in htmls])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([p.written if written else p.whole for p in found], pa.string(), mask=missing),
                    pa.array([p.title or "" for p in found], pa.string(), mask=missing),
                    pa.array([resolved(u, p.hrefs) for u, p in zip(urls, found, strict=True)], lists, mask=missing),
                    pa.array([p.branding for p in found], lists),
                    pa.array([[{"text": t, "links": x} for t, x in p.blocks] for p in found], pa.list_(BLOCK)),
                    pa.array([[json.dumps(x, ensure_ascii=False) for x in p.people()] for p in found], lists), *batch.columns[2:],
                ],
                names=["url", "text", "title", "links", "branding", "blocks", "people", *batch.schema.names[2:]],
            )

    return once.mapInArrow(
        tidy(each), "url string, text string, title string, links array<string>, branding array<string>, "
        "blocks array<struct<text:string,links:array<string>>>, people array<string>" + ident,
    )


class Results(HTMLParser):
    """The result links of a saved search page, their redirect parameter followed."""

    def __init__(self, base: str):
        super().__init__()
        self.base, self.found, self.inside = base, [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag == "a" and "result__a" in (given.get("class") or "").split():
            url = urljoin(self.base, given.get("href") or "")
            self.found.append([parse_qs(urlsplit(url).query).get("uddg", [url])[0], ""])
            self.inside = True

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.found[-1][1] += data

    def handle_endtag(self, tag: str) -> None:
        self.inside = self.inside and tag != "a"


def parse_result_pages(saved: DataFrame, base: str = "https://html.duckduckgo.com/") -> DataFrame:
    """(response_id, pos, url, title) of the results on saved search pages (response_id, body)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                results = Results(base)
                results.feed(body or "")
                rows += [(i, n, u, t) for n, (u, t) in enumerate(results.found)]
            kinds = (batch.column(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["response_id", "pos", "url", "title"])

    kind = saved.schema["response_id"].dataType.simpleString()
    return saved.select("response_id", "body").mapInArrow(each, f"response_id {kind}, pos int, url string, title string")
