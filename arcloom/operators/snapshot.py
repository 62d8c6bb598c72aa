"""Static HTML snapshots from DOM trees or pages.

A page is flattened where it is read into an array of tokens per document;
every token knows the tags it is inside of.  Stripping and writing HTML are
then array expressions: nothing is shuffled and nothing leaves the JVM again.
Pages are flattened a bounded piece of a batch at a time, since tokens take many
times the bytes of their page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import EVENT_ATTRIBUTES, SNAPSHOT_STRIPPED_TAGS, VOID_TAGS
from arcloom.functions.urls import is_web, strip_fragment
from arcloom.operators.html_rules import closes_itself, implied_ends
from arcloom.sources.pieces import pieces

TOKEN_TYPE = (
    "STRUCT<kind: STRING, name: STRING, attrs: ARRAY<STRUCT<name: STRING, value: STRING>>,"
    " text: STRING, node: INT, parent: INT, path: STRING>"
)
DOCS_TYPE = f"ARRAY<STRUCT<url: STRING, base_url: STRING, tokens: ARRAY<{TOKEN_TYPE}>>>"
_TOKEN_ARROW = pa.struct([
    ("kind", pa.string()), ("name", pa.string()),
    ("attrs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ("text", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("path", pa.string()),
])
_DOCS_ARROW = pa.list_(pa.struct([("url", pa.string()), ("base_url", pa.string()), ("tokens", pa.list_(_TOKEN_ARROW))]))
RAW_TEXT_TAGS = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext")


class _Tokens:
    """Token list of one document with the stack of open tags."""

    def __init__(self) -> None:
        self.out: list[dict] = []
        self.open: list[tuple[str, int]] = []
        self.nodes = 0

    def add(self, kind: str, name: str | None = None, attrs: list | None = None, text: str | None = None) -> None:
        own = [name.lower()] if kind in ("start", "empty") else []
        self.out.append({
            "kind": kind, "name": name, "attrs": attrs, "text": text, "node": self.nodes,
            "parent": self.open[-1][1] if self.open else None,
            "path": "/" + "".join(t + "/" for t in [o.lower() for o, _ in self.open] + own),
        })
        self.nodes += 1
        if kind == "start":
            self.open.append((name, self.nodes - 1))

    def close(self) -> None:
        name, node = self.open.pop()
        parent = self.open[-1][1] if self.open else None
        path = "/" + "".join(t.lower() + "/" for t, _ in self.open) + name.lower() + "/"
        self.out.append({"kind": "end", "name": name, "attrs": None, "text": None,
                         "node": node, "parent": parent, "path": path})


def _flatten(tree: dict) -> list[dict]:
    """Tokens of one DOM document, iteratively in document order."""
    tokens, todo = _Tokens(), [tree]
    leaves = {"#text": "text", "#comment": "comment", "#cdata-section": "cdata"}
    while todo:
        node = todo.pop()
        if node is None:
            tokens.close()
            continue
        name, children = node["nodeName"], node.get("children", [])
        if name in leaves:
            tokens.add(leaves[name], text=node.get("nodeValue", ""))
        elif name == "#document":
            todo.extend(reversed(children))
        elif node.get("nodeType") == 10:
            tokens.add("doctype", text=name)
        else:
            flat = node.get("attributes", [])
            attrs = [{"name": k, "value": v} for k, v in zip(flat[::2], flat[1::2])]
            if name.lower() in VOID_TAGS and not children:
                tokens.add("empty", name, attrs)
            else:
                tokens.add("start", name, attrs)
                todo.append(None)
                todo.extend(reversed(children))
    return tokens.out


def _documents(tree: dict) -> list[dict]:
    """A page's documents: the page itself, then those of its frames in pre-order."""
    found, todo = [], [tree]
    if tree["nodeName"] == "#document":
        found.append(tree)
    while todo:
        node = todo.pop()
        todo.extend(reversed(node.get("children", [])))
        inner = node.get("contentDocument")
        if inner:
            found.append(inner)
            todo.append(inner)
    return found


class _PageTokens(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens = _Tokens()

    def handle_starttag(self, tag, attrs):
        listed = [{"name": k, "value": v} for k, v in attrs]
        for _ in range(implied_ends([t[0] for t in self.tokens.open], tag)):
            self.tokens.close()
        self.tokens.add("empty" if tag in VOID_TAGS else "start", tag, listed)

    def handle_startendtag(self, tag, attrs):
        inside = closes_itself([t[0] for t in self.tokens.open])
        self.handle_starttag(tag, attrs)
        if inside and tag not in VOID_TAGS:
            self.tokens.close()

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.tokens.open]:
            while self.tokens.open[-1][0] != tag:
                self.tokens.close()
            self.tokens.close()

    def handle_data(self, data):
        self.tokens.add("text", text=data)

    def handle_comment(self, data):
        self.tokens.add("comment", text=data)

    def handle_decl(self, decl):
        self.tokens.add("doctype", text=decl.partition(" ")[2])

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.tokens.add("cdata", text=data[6:])


def _page_tokens(html: str) -> list[dict]:
    parser = _PageTokens()
    parser.feed(html or "")
    parser.close()
    while parser.tokens.open:
        parser.tokens.close()
    return parser.tokens.out


def _dom_docs(text: str) -> list[dict]:
    try:
        tree = json.loads(text)
    except (TypeError, ValueError):
        return []
    return [
        {"url": d.get("documentURL"), "base_url": d.get("baseURL"), "tokens": _flatten(d)}
        for d in _documents(tree)
    ]


def _flattened(piece: pa.RecordBatch, docs: list[list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [piece.column("page_id").cast(pa.int64()), pa.array(docs, _DOCS_ARROW)], ["page_id", "docs"])


def dom_documents(pages: DataFrame, dom: str = "dom") -> DataFrame:
    """``(page_id, dom JSON)`` -> ``(page_id, docs)``; unreadable trees give no documents."""
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "dom"):
            yield _flattened(piece, [_dom_docs(t) for t in piece.column("dom").to_pylist()])

    return pages.select("page_id", F.col(dom).alias("dom")).mapInArrow(
        flatten, f"page_id BIGINT, docs {DOCS_TYPE}")


def html_documents(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` -> ``(page_id, docs)`` with the page as its one document."""
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            urls, texts = piece.column("url").to_pylist(), piece.column("html").to_pylist()
            yield _flattened(piece, [[{"url": u, "base_url": u, "tokens": _page_tokens(h)}] for u, h in zip(urls, texts)])

    return pages.select("page_id", "url", "html").mapInArrow(flatten, f"page_id BIGINT, docs {DOCS_TYPE}")


def nodes(documents: DataFrame) -> DataFrame:
    """Node table ``(page_id, doc_seq, node_seq, parent_seq, depth, kind, name, attrs, text)``."""
    t = F.col("t")
    attrs = F.map_from_entries(F.array_distinct(F.transform(
        F.coalesce(t["attrs"], F.array().cast("array<struct<name:string,value:string>>")),
        lambda a: F.struct(F.lower(a["name"]), F.coalesce(a["value"], F.lit(""))))))
    return (
        documents.select("page_id", F.posexplode("docs").alias("doc_seq", "d"))
        .select("page_id", "doc_seq", F.explode("d.tokens").alias("t"))
        .filter(t["kind"] != "end")
        .select(
            "page_id", "doc_seq", t["node"].alias("node_seq"), t["parent"].alias("parent_seq"),
            (F.length(t["path"]) - F.length(F.replace(t["path"], F.lit("/"), F.lit("")))
             - F.when(t["kind"].isin("start", "empty"), 2).otherwise(1)).alias("depth"),
            t["kind"].alias("kind"), F.lower(t["name"]).alias("name"), attrs.alias("attrs"), t["text"].alias("text"),
        )
    )


def strip_tags(tokens: Column, tags: Sequence[str]) -> Column:
    """Drop the tags and everything inside them."""
    inside = "/(" + "|".join(t.lower() for t in tags) + ")/"
    return F.filter(tokens, lambda t: ~F.rlike(t["path"], F.lit(inside)))


def strip_attributes(tokens: Column, names: Sequence[str]) -> Column:
    lowered = [n.lower() for n in names]
    return F.transform(tokens, lambda t: t.withField(
        "attrs", F.filter(t["attrs"], lambda a: ~F.lower(a["name"]).isin(*lowered))))


def serialize(tokens: Column) -> Column:
    """Tokens -> HTML.  Values are quoted only where they must be."""
    def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
        for a, b in pairs:
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def attribute(a: Column) -> Column:
        value = replaced(a["value"], ("&", "&amp;"))
        single = F.concat(F.lit("'"), value, F.lit("'"))
        double = F.concat(F.lit('"'), replaced(value, ('"', "&quot;")), F.lit('"'))
        quoted = F.when(F.contains(value, F.lit('"')) & ~F.contains(value, F.lit("'")), single).otherwise(double)
        bare = ~F.rlike(value, F.lit("^$|[\\s\"'=<>`]"))
        return F.concat(F.lit(" "), a["name"], F.when(a["value"].isNull(), "").otherwise(
            F.concat(F.lit("="), F.when(bare, value).otherwise(quoted))))

    def render(t: Column) -> Column:
        opening = F.concat(F.lit("<"), t["name"], F.coalesce(
            F.array_join(F.transform(t["attrs"], attribute), ""), F.lit("")), F.lit(">"))
        raw = F.rlike(t["path"], F.lit("/(" + "|".join(RAW_TEXT_TAGS) + ")/$"))
        text = F.when(raw, t["text"]).otherwise(
            replaced(t["text"], ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))
        return (
            F.when(t["kind"].isin("start", "empty"), opening)
            .when(t["kind"] == "end", F.concat(F.lit("</"), t["name"], F.lit(">")))
            .when(t["kind"] == "comment", F.concat(F.lit("<!--"), t["text"], F.lit("-->")))
            .when(t["kind"] == "cdata", F.concat(F.lit("<![CDATA["), t["text"], F.lit("]]>")))
            .when(t["kind"] == "doctype", F.concat(F.lit("<!DOCTYPE "), t["text"], F.lit(">")))
            .otherwise(text)
        )

    return F.array_join(F.transform(tokens, render), "")


def static_snapshots(documents: DataFrame, tags: Sequence[str] = SNAPSHOT_STRIPPED_TAGS,
                     attributes: Sequence[str] = EVENT_ATTRIBUTES) -> DataFrame:
    """``(page_id, doc_seq, url, document)``: web documents made static.

    The first document of a URL in its page wins (frames without a source
    repeat it); ``duplicates`` tells how many of the page were left out.
    """
    web = F.filter("docs", lambda d: is_web(d["url"]))
    urls = F.transform("web", lambda d: d["url"])
    first = F.filter("web", lambda d, i: F.array_position(urls, d["url"]) == i + 1)
    tokens = strip_attributes(strip_tags(F.col("d.tokens"), tags), attributes)
    return (
        documents.withColumn("web", web)
        .withColumn("kept", first)
        .select("page_id", (F.size("web") - F.size("kept")).alias("duplicates"),
                F.posexplode("kept").alias("doc_seq", "d"))
        .select("page_id", "doc_seq", strip_fragment("d.url").alias("url"), "duplicates",
                serialize(tokens).alias("html"))
        .withColumn("document", F.encode("html", "UTF-8"))
        .drop("html")
    )


_ATTRIBUTE_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""


def static_html_native(html: Column) -> Column:
    """Scripts and event attributes removed by pattern, for markup whose tags are closed as they are opened.

    An element ends at its own end tag.  Attributes go only inside tags, quoted
    either way, bare or without a value.
    """
    no_tags = F.regexp_replace(
        html, "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in SNAPSHOT_STRIPPED_TAGS), "")
    listed = rf"(?:{'|'.join(EVENT_ATTRIBUTES)})(?=[\s=>/])"
    # from the tag's name, or from where the attribute before this one was taken out
    kept = rf"""((?:\s++(?!{listed})[^\s"'>=]++{_ATTRIBUTE_VALUE})*+)"""
    return F.regexp_replace(no_tags, rf"(?is)(<[a-z][^\s>/]*+|(?!\A)\G){kept}\s++{listed}{_ATTRIBUTE_VALUE}", "$1$2")
