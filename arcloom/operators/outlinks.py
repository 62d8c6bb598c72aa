"""Links of pages: extraction, plain-text link lists, batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import LINKS_PER_MESSAGE, VOID_TAGS, WEB_SCHEMES
from arcloom.functions.urls import resolve
from arcloom.operators.html_rules import closes_itself, implied_ends


def hrefs(html: Column | str) -> Column:
    """Raw ``href`` values of ``a`` and ``area`` elements, by pattern, inside the JVM.

    Comments and raw-text elements are left out, values may be quoted either way
    or not at all, and the usual character references are resolved.  Hidden
    parts are not known here; ``link_edges`` walks the tags.
    """
    html = F.col(html) if isinstance(html, str) else html
    shown = F.regexp_replace(html, _UNSEEN, " ")
    found = F.regexp_extract_all(shown, F.lit(_LINK_TAG), F.lit(1))
    return F.transform(found, lambda v: _unescaped(F.regexp_replace(v, "^[\"']|[\"']$", "")))


_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
_LINK_TAG = (rf"""(?is)<(?:a|area)(?:\s++(?!href[\s=])[^\s"'>=]++(?:\s*+=\s*+{_VALUE})?+)*+"""
             rf"""\s++href\s*+=\s*+({_VALUE})""")
_UNSEEN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "textarea", "title"))
_REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"),
               ("&#38;", "&"), ("&amp;", "&"))


def _unescaped(value: Column) -> Column:
    for reference, character in _REFERENCES:  # the ampersand last, so that nothing is resolved twice
        value = F.replace(value, F.lit(reference), F.lit(character))
    return value


def link_edges_native(pages: DataFrame) -> DataFrame:
    """Distinct links per page without Python: ``(page_id, url, link, dst_url)``.

    Duplicates go inside the row, so nothing is shuffled.
    """
    links = F.array_distinct(hrefs("html"))
    return pages.select("page_id", "url", F.explode(links).alias("link")).withColumn(
        "dst_url", resolve("url", "link")
    )


class _LinkCollector(HTMLParser):
    """Collects clickable links; hidden and disabled ones stay out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.open: list[tuple[str, bool]] = []  # (tag, hides its content)
        self.base: str | None = None
        self.text_list: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        ended = implied_ends([t for t, _ in self.open], tag)
        if ended:
            del self.open[-ended:]
        style = "".join((a.get("style") or "").lower().split())
        hidden = "display:none" in style or "hidden" in a
        if tag == "base" and a.get("href") and self.base is None:
            self.base = a["href"]
        visible = not hidden and not any(h for _, h in self.open)
        if tag in ("a", "area") and a.get("href") is not None and "disabled" not in a and visible:
            self.links.append(a["href"])
        if tag not in VOID_TAGS:
            self.open.append((tag, hidden))

    def handle_startendtag(self, tag, attrs):
        inside = closes_itself([t for t, _ in self.open])
        self.handle_starttag(tag, attrs)
        if inside and tag not in VOID_TAGS:
            self.open.pop()

    def handle_endtag(self, tag):
        tags = [t for t, _ in self.open]
        if tag in tags:
            del self.open[len(tags) - 1 - tags[::-1].index(tag):]

    def handle_data(self, data):
        # a browser shows plain text inside body > pre
        path = [t for t, _ in self.open if t != "html"]
        if path == ["body", "pre"] and not any(h for _, h in self.open):
            self.text_list.append(data)


def _absolute(base: str, link: str) -> str:
    """Absolute link as a browser shows it: escaped, escapes in upper case, never an empty path."""
    url = quote(urljoin(base, link.strip()), safe="%/:?#[]@!$&'()*+,;=~-._")
    url = re.sub(r"%[0-9a-fA-F]{2}", lambda m: m.group().upper(), url)
    parts = urlsplit(url)
    if parts.scheme in WEB_SCHEMES and not parts.path:
        parts = parts._replace(path="/")
    return parts.geturl()


def _links_of(url: str, html: str) -> list[str]:
    collector = _LinkCollector()
    collector.feed(html or "")
    collector.close()
    base = urljoin(url, collector.base) if collector.base else url
    found: dict[str, None] = {}
    for link in collector.links:
        try:
            found[_absolute(base, link)] = None
        except ValueError:
            continue  # not a URL: dropped, as any row that fails to map
    for line in "".join(collector.text_list).split("\n"):
        if line.startswith(("http://", "https://")):
            found[line.rstrip("\r")] = None
    return list(found)


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct absolute links per page: ``(page_id, src_url, dst_url)``.

    Walks tags in Arrow batches where the page is read; only inline styles and
    the ``hidden`` attribute are known to hide (there is no style engine).
    """
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            links = [_links_of(u, h) for u, h in zip(pdf["src_url"], pdf["html"])]
            yield pdf[["page_id", "src_url"]].assign(links=links)

    rows = pages.select("page_id", F.col("url").alias("src_url"), "html").mapInPandas(
        extract, "page_id BIGINT, src_url STRING, links ARRAY<STRING>"
    )
    return rows.select("page_id", "src_url", F.explode("links").alias("dst_url"))


def text_links(text: Column) -> Column:
    """Lines of a plain-text list that are web links."""
    return F.filter(F.split(text, "\r?\n"), lambda s: F.rlike(s, F.lit("^https?://")))


def link_batches(pages: DataFrame, links: Column, size: int = LINKS_PER_MESSAGE) -> DataFrame:
    """Distinct links of each page, sorted and cut into messages of ``size``.

    All inside the page's row; a page without links gives no message.
    """
    ordered = F.array_sort(F.array_distinct(links))
    n_batches = F.ceil(F.size("__links") / size).cast("int")
    cuts = F.when(F.size("__links") > 0, F.transform(
        F.sequence(F.lit(0), n_batches - 1),
        lambda i: F.slice(F.col("__links"), (i * size + 1).cast("int"), F.lit(size))))
    return (
        pages.withColumn("__links", ordered)
        .select("page_id", F.posexplode(cuts).alias("batch", "links"))
    )
