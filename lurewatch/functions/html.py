"""HTML helpers. Nested markup needs a tokenizer: one pass per page, over Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import cached_property
from html import unescape
from itertools import chain
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lurewatch.functions.strings import blank_to_null, let, strip
from lurewatch.functions.urls import base_url, suspicious_by_model, suspicious_by_parser, text_urls

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
RAW = re.compile(r"(script|style)\b", re.I)
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style")}
OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
CLOSED = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
NEAR = 400
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def _attributes(text: str) -> dict[str, str]:
    """Attributes of one tag; a repeated name keeps its last value."""
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" else v)
            for k, v in ATTRIBUTE.findall(text)}


class Scanner:
    """Places of marks in a page, each looked up once from left to right.

    What no longer occurs is remembered per mark, and so are quotes that never lead to the end of a
    tag, so a page full of unclosed comments, scripts or quotes costs no more than another.
    """

    def __init__(self, html: str):
        self.html, self.gone = html, set()
        self.open_quotes: set[int] = set()

    @cached_property
    def places(self) -> dict[str, list[int]]:
        return {c: [m.start() for m in re.finditer(c, self.html)] for c in ">\"'"}

    @cached_property
    def special(self) -> list[int]:
        return sorted(chain.from_iterable(self.places.values()))

    def after(self, mark, at: int) -> int:
        """End of the next ``mark`` (text or pattern) from ``at`` on, or -1."""
        if mark in self.gone:
            return -1
        if isinstance(mark, str):
            found = self.html.find(mark, at)
            end = found + len(mark) if found >= 0 else -1
        else:
            match = mark.search(self.html, at)
            end = match.end() if match else -1
        if end < 0:
            self.gone.add(mark)
        return end

    def _next(self, places: list[int], at: int) -> int:
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def tag_close(self, at: int) -> int:
        """Place of the > that closes a tag; quoted values are skipped whole. -1: it never closes.

        Most tags close within a few characters; only others need the places.
        """
        near = CLOSED.match(self.html, at, at + NEAR)
        if near:
            return near.end() - 1
        passed = []
        while True:
            spot = self._next(self.special, at)
            if spot >= 0 and self.html[spot] == ">":
                return spot
            if spot >= 0 and spot not in self.open_quotes:
                passed.append(spot)
                close = self._next(self.places[self.html[spot]], spot + 1)
                if close >= 0:
                    at = close + 1
                    continue
            self.open_quotes.update(passed)
            return -1


def tags(html: str):
    """(start, end, closing, name, attribute text) of comments (no name) and tags, in order.

    Script and style blocks count as comments; a < that opens nothing is text.
    """
    scan, at = Scanner(html), 0
    while m := OPEN.search(html, at):
        start, at = m.start(), m.end()
        if not m[4]:
            end = scan.after("-->", at) if m[1] else -1
            end = end if end >= 0 else scan.after(">", start + 2)
            if end >= 0:
                yield start, end, "", "", ""
            at = end if end >= 0 else start + 1
            continue
        raw = RAW.match(html, start + 1)
        if raw:
            head = scan.after(">", raw.end())
            end = scan.after(RAW_END[raw[1].lower()], head) if head >= 0 else -1
            if end >= 0:
                yield start, end, "", "", ""
                at = end
                continue
        close = scan.tag_close(at)
        if close >= 0:
            yield start, close + 1, m[3], m[4], html[at:close]
            at = close + 1
        else:
            at = start + 1


def read_page(html: str) -> tuple[list, list[str], list[str]]:
    """(anchors as [href, text pieces], attribute texts that may hold URLs, visible pieces)."""
    anchors: list = []
    loose: list[str] = []
    visible: list[str] = []
    stack: list[tuple[str, int | None]] = []
    opened: Counter = Counter()
    inside: list[int] = []
    hidden = at = 0

    def show(piece: str) -> None:
        visible.append(piece)
        for anchor in inside:
            anchors[anchor][1].append(piece)

    for start, end, closing, name, text in tags(html):
        if start > at and not hidden:
            show(html[at:start])
        at = end
        name = name.lower()
        if not name:
            continue
        if closing:
            while opened[name]:
                last, anchor = stack.pop()
                opened[last] -= 1
                hidden -= last in HIDDEN
                if anchor is not None:
                    inside.remove(anchor)
                if last == name:
                    break
            continue
        anchor = None
        low = text.lower()
        if name in ("a", "button") or "style" in low or "background" in low:
            found = _attributes(text)
            if name == "a" and "href" in found:
                anchor = len(anchors)
                anchors.append([found["href"], []])
            if name == "button":
                loose.append(found.get("onclick", ""))
            loose += [v for k, v in found.items() if k == "style" or k.startswith("background")]
        if name not in VOID and not text.endswith("/"):
            stack.append((name, anchor))
            opened[name] += 1
            hidden += name in HIDDEN
            if anchor is not None:
                inside.append(anchor)
    if not hidden and at < len(html):
        show(html[at:])
    return anchors, loose, visible


@F.pandas_udf(StringType())
def _visible_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: unescape("".join(read_page(h)[2])), na_action="ignore")


def visible_text(c: Column) -> Column:
    """Text without markup where ``<html`` occurs; other rows skip the parser."""
    is_page = F.contains(F.lower(c), F.lit("<html"))
    return F.when(is_page, _visible_text(F.when(is_page, c))).otherwise(c)


def _resolved(href: str) -> str:
    """Rooted path with dot segments removed; host-relative and other links unchanged."""
    if not href.startswith("/") or href.startswith("//"):
        return href
    return urljoin("http://h", href).removeprefix("http://h")


ANCHOR = StructType([StructField(n, StringType()) for n in ("href", "target", "text")])
PAGE = StructType([StructField("anchors", ArrayType(ANCHOR)),
                   StructField("attributes", ArrayType(StringType()))])


@F.arrow_udf(PAGE)
def _page_links(html: pa.Array) -> pa.Array:
    found: list[tuple[str, str, str]] = []
    texts: list[str] = []
    anchor_ends, text_ends = [0], [0]
    for page in html.to_pylist():
        if page:
            anchors, loose, _ = read_page(page)
            found += [(h, _resolved(h), unescape("".join(t))) for h, t in anchors]
            texts += [t for t in loose if t]
        anchor_ends.append(len(found))
        text_ends.append(len(texts))
    columns = [pa.array(c, pa.string()) for c in (zip(*found) if found else ([], [], []))]
    listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.StructArray.from_arrays(
        [listed(anchor_ends, pa.StructArray.from_arrays(columns, names=ANCHOR.names)),
         listed(text_ends, pa.array(texts, pa.string()))], names=PAGE.names)


def page_links(html: Column) -> Column:
    """struct(anchors[{href,target,text}], attributes[]): one parse per page feeds every rule."""
    return _page_links(F.when(F.contains(html, F.lit("<")), html))


def _absolute(base: Column, path: Column) -> Column:
    """Join a rooted path to scheme://netloc; ``//host`` keeps only the scheme."""
    return F.when(path.startswith("//"), F.concat(F.substring_index(base, "//", 1), path)) \
        .otherwise(F.concat(base, path))


def found_urls(text: Column, links: Column) -> Column:
    """Sorted set of URLs in text, anchors, button scripts, styles and backgrounds."""
    hrefs = F.transform(links["anchors"], lambda a: a["target"])
    full = F.filter(hrefs, lambda h: h.startswith("http"))
    # The base is bound: each anchor would search the text for it.
    rooted = let(base_url(text), lambda base: F.transform(
        F.filter(hrefs, lambda h: h.startswith("/") & base.isNotNull()), lambda h: _absolute(base, h)))
    in_attributes = F.flatten(F.transform(links["attributes"], text_urls))
    return F.array_sort(F.array_distinct(F.concat(text_urls(text), full, rooted, in_attributes)))


def classified_links(urls: Column, links: Column) -> Column:
    """Each URL with the text of the first anchor holding it and the model's suspicion flag."""
    def one(u: Column) -> Column:
        label = F.get(F.filter(links["anchors"], lambda a: a["href"] == u), F.lit(0))["text"]
        return F.struct(
            u.alias("url"),
            F.coalesce(blank_to_null(strip(label)), u).alias("text"),
            suspicious_by_model(u).alias("suspicious"))

    return F.transform(urls, one)


def parser_links(body: Column, links: Column) -> Column:
    """Anchors in page order, then text URLs no anchor already points at."""
    anchors = F.transform(
        F.filter(links["anchors"], lambda a: a["href"] != ""),
        lambda a: F.struct(a["href"].alias("url"), a["text"].alias("text"),
                           suspicious_by_parser(a["href"]).alias("suspicious")))

    def with_text(known: Column) -> Column:
        fresh = F.filter(F.array_distinct(text_urls(body)),
                         lambda u: ~F.exists(known, lambda k: k["url"] == u))
        return F.concat(known, F.transform(
            fresh, lambda u: F.struct(u.alias("url"), u.alias("text"),
                                      suspicious_by_parser(u).alias("suspicious"))))

    return let(anchors, with_text)
