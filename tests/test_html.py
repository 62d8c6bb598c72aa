import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcloom.operators import outlinks, snapshot
from arcloom.sources.pieces import PIECE_BYTES, PIECE_ROWS, pieces


def rendered(spark, html, tags=(), attributes=()):
    docs = snapshot.html_documents(spark.createDataFrame([(1, "http://h/", html)], "page_id BIGINT, url STRING, html STRING"))
    tokens = F.col("d.tokens")
    if tags:
        tokens = snapshot.strip_tags(tokens, tags)
    if attributes:
        tokens = snapshot.strip_attributes(tokens, attributes)
    return docs.select(F.explode("docs").alias("d")).select(snapshot.serialize(tokens).alias("h")).first().h


@pytest.mark.parametrize("html,tags,want", [
    ("<ul><li>one<style>s</style></li></ul>", ["style"], "<ul><li>one</li></ul>"),
    ("x<form><form-field>y</form-field></form>z", ["form"], "xz"),
    # void tags neither open nor close anything
    ("<object><hr></object><h1>t</h1>", ["object"], "<h1>t</h1>"),
    ("<h2>t<hr>u</h2>v<hr>", ["HR"], "<h2>tu</h2>v"),
    # end tags that are left out: what is stripped ends where the next one begins
    ("<ol><li>1<li class=ad>2<li>3</ol>", ["none"], "<ol><li>1</li><li class=ad>2</li><li>3</li></ol>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["dd"], "<dl><dt>a</dt><dt>c</dt></dl>"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", ["td"], "<table><tr></tr><tr><th>3</th></tr></table>"),
    ("<p>a<p>b<div>c</div>", ["p"], "<div>c</div>"),
    ("<select><option>1<option>2</select>", ["none"], "<select><option>1</option><option>2</option></select>"),
    # inner lists and tables keep their rules to themselves
    ("<li>a<ul><li>b</ul>c<li>d", ["none"], "<li>a<ul><li>b</li></ul>c</li><li>d</li>"),
    # the slash of an HTML tag means nothing, that of a drawing's does
    ("<div/>a</div>b<svg><g/>c</svg>", ["none"], "<div>a</div>b<svg><g></g>c</svg>"),
])
def test_strip_tags(spark, html, tags, want):
    assert rendered(spark, html, tags) == want


def test_strip_attributes(spark):
    html = "<input TYPE=text disabled value='7'><label for=q hidden>q</label>"
    assert rendered(spark, html, attributes=["value", "Hidden", "type"]) == "<input disabled><label for=q>q</label>"


@pytest.mark.parametrize("html,want", [
    ("<noscript><script>1</script>LEFT</noscript>ok", "ok"), ("<script>a</script>t<SCRIPT src=x>b</SCRIPT >u", "tu"),
    ("<a onclick='x()' href=/y>", "<a href=/y>"), ("<body class=k onload=go id=i>", "<body class=k id=i>"),
    ('<p onclick="a>b" title="t" onload=x onerror>', '<p title="t">'), ('say onclick="x" aloud', 'say onclick="x" aloud'),
    ("<p title=' onclick=1'>", "<p title=' onclick=1'>"), ("<p data-onclick=1>", "<p data-onclick=1>"),
])
def test_static_html_by_pattern(spark, html, want):
    assert spark.range(1).select(snapshot.static_html_native(F.lit(html)).alias("h")).first().h == want


@pytest.mark.parametrize("html,want", [
    ("a &lt; b &amp; c", "a &lt; b &amp; c"), ('<a t="x y" u=\'"\' v="">', "<a t=\"x y\" u='\"' v=\"\"></a>"),
    ("<script>1 < 2 && 3</script>", "<script>1 < 2 && 3</script>"), ("<!-- c --><p>", "<!-- c --><p></p>"),
    ("<!DOCTYPE html><p>ä", "<!DOCTYPE html><p>ä</p>"),
])
def test_serialize(spark, html, want):
    assert rendered(spark, html) == want


def text(v):
    return {"nodeName": "#text", "nodeValue": v}


def el(name, *children, attrs=(), frame=None):
    node = {"nodeName": name, "attributes": list(attrs), "children": list(children)}
    return node | ({"contentDocument": frame} if frame else {})


def doc(url, *children):
    return {"nodeName": "#document", "documentURL": url, "baseURL": url, "children": list(children)}


def snap(spark, tree):
    pages = spark.createDataFrame([(1, tree if isinstance(tree, str) else json.dumps(tree))], "page_id BIGINT, dom STRING")
    out = snapshot.static_snapshots(snapshot.dom_documents(pages)).orderBy("doc_seq").collect()
    return [(r.url, bytes(r.document).decode(), r.duplicates) for r in out]


def test_page_and_frame(spark):
    inner = doc("https://inside/x", el("HTML", el("BODY", el("EM", text("in")))))
    page = doc("https://outside/", el("HTML", el("HEAD", el("LINK", attrs=["rel", "icon"])), el(
        "BODY", {"nodeName": "#comment", "nodeValue": "note"}, el("IFRAME", frame=inner), el("P", text("out")))))
    assert snap(spark, page) == [
        ("https://outside/", "<HTML><HEAD><LINK rel=icon></HEAD><BODY><!--note--><IFRAME></IFRAME><P>out</P></BODY></HTML>", 0),
        ("https://inside/x", "<HTML><BODY><EM>in</EM></BODY></HTML>", 0)]


def test_cdata_is_kept(spark):
    page = doc("http://h/", el("svg", el("style", {"nodeName": "#cdata-section", "nodeValue": "a < b"})))
    assert snap(spark, page)[0][1] == "<svg><style><![CDATA[a < b]]></style></svg>"


def test_snapshot_is_static(spark):
    page = doc("http://h/#top", el("BODY", el("SCRIPT", text("x")), el("P", text("<y>"), attrs=["onclick", "z", "id", "k"]),
                                   el("NOSCRIPT", el("IMG")), attrs=["onLoad", "go()"]))
    assert snap(spark, page) == [("http://h/", "<BODY><P id=k>&lt;y&gt;</P></BODY>", 0)]


def test_first_document_of_a_url_wins_and_only_web_is_kept(spark):
    page = doc("http://h/", el("A", el("IFRAME", frame=doc("http://h/", el("B")))),
               el("IFRAME", frame=doc("about:blank", el("IFRAME", frame=doc("http://deep/", el("C"))))))
    assert [(u, h) for u, h, _ in snap(spark, page)] == [
        ("http://h/", "<A><IFRAME></IFRAME></A><IFRAME></IFRAME>"), ("http://deep/", "<C></C>")]
    assert snap(spark, page)[0][2] == 1


def test_unreadable_tree_gives_nothing(spark):
    assert snap(spark, "{broken") == []


def test_node_table(spark):
    pages = spark.createDataFrame([(1, json.dumps(doc("http://h/", el("P", el("BR"), text("x"), attrs=["ID", "k"]))))], "page_id BIGINT, dom STRING")
    rows = snapshot.nodes(snapshot.dom_documents(pages)).orderBy("node_seq").collect()
    assert [(r.node_seq, r.parent_seq, r.depth, r.kind, r.name) for r in rows] == [
        (0, None, 0, "start", "p"), (1, 0, 1, "empty", "br"), (2, 0, 1, "text", None)]
    assert rows[0].attrs == {"id": "k"}


# --- links ---------------------------------------------------------------------------

def links(spark, html, url="http://localhost:8080"):
    pages = spark.createDataFrame([(1, url, html)], "page_id BIGINT, url STRING, html STRING")
    return sorted(r.dst_url for r in outlinks.link_edges(pages).collect())


@pytest.mark.parametrize("html,want", [
    ("<a href=one>1</a><a href='two'>2</a><AREA HREF=\"/three\">", ["/dir/one", "/dir/two", "/three"]),
    ("<a href=?q=1&amp;r=2>x</a><a href=#part>y</a>", ["/dir/page#part", "/dir/page?q=1&r=2"]),
    ("<a data-href=/no>x</a><a name=n>y</a><!-- <a href=/no> --><script>'<a href=/no>'</script>", []),
    ("<a href=/off disabled>x</a><a href=/seen style='visibility:hidden'>y</a>", ["/seen"]),
    ("<section hidden><a href=/no>x</a></section><a href=/no style='color:red; DISPLAY : none'>y</a>", []),
    # a hidden element ends where its end tag may be left out
    ("<li hidden>x<li><a href=/a>y</a>", ["/a"]), ("<p style=display:none>x<p><a href=/a>y</a>", ["/a"]),
    ("<table><tr hidden><td><a href=/no>n</a><tr><td><a href=/a>y</a></table>", ["/a"]),
    ("<ul><li hidden><ul><li><a href=/no>n</a></ul><li><a href=/a>y</a></ul>", ["/a"]),
])
def test_links_of_pages(spark, html, want):
    host = "http://host.test"
    assert links(spark, html, host + "/dir/page") == [host + w for w in want]


@pytest.mark.parametrize("html,want", [
    ("<a href=one>1</a><a class=k href='t&quot;wo'>2</a><area HREF = \"/3\">", ["one", 't"wo', "/3"]),
    ("<a data-href=/no href=/yes>x</a><a title=' href=/no'>y</a>", ["/yes"]),
    ("<!-- <a href=/no> --><script>'<a href=/no>'</script><a\nhref=/yes>", ["/yes"]),
    ("<a href=/a?b=1&amp;c=2&amp;amp;>x</a><abbr href=/no>", ["/a?b=1&c=2&amp;"]),
])
def test_links_by_pattern(spark, html, want):
    assert spark.range(1).select(outlinks.hrefs(F.lit(html)).alias("l")).first().l == want


def test_links_once_base_and_encoding(spark):
    assert links(spark, '<base href="/d/"><a href="x">1</a><a href="x">2</a><a href="ä b">', "http://h/") == [
        "http://h/d/%C3%A4%20b", "http://h/d/x"]
    assert links(spark, '<a href="http://[bad">x</a><a href="/ok">', "http://h/") == ["http://h/ok"]
    assert links(spark, None) == []


def test_plain_text_list(spark):
    html = "<html><body><pre>http://a/\nsee http://b/\nhttps://c/\n</pre></body></html>"
    assert links(spark, html) == ["http://a/", "https://c/"]
    text_ = F.lit("http://a/\r\n http://b/\nhttps://c/?x=1\nftp://d/")
    assert spark.range(1).select(outlinks.text_links(text_).alias("l")).first().l == ["http://a/", "https://c/?x=1"]


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (100, [100]), (101, [100, 1]), (250, [100, 100, 50])])
def test_batches(spark, n, sizes):
    df = spark.createDataFrame([(1, [f"{i:03}" for i in range(n)] * 2)], "page_id BIGINT, l ARRAY<STRING>")
    out = outlinks.link_batches(df, F.col("l")).orderBy("batch").collect()
    assert [len(r.links) for r in out] == sizes and [r.batch for r in out] == list(range(len(sizes)))
    assert [x for r in out for x in r.links] == [f"{i:03}" for i in range(n)]


def test_pieces_are_bounded_and_whole():
    texts = ["a" * 100] * 700 + [None] + ["b" * (PIECE_BYTES + 1)] + ["c" * (PIECE_BYTES // 2)] * 3
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    cut = list(pieces(iter([batch, batch.slice(0, 0), batch]), "t"))
    assert [n for c in cut for n in c.column("n").to_pylist()] == list(range(len(texts))) * 2
    for c in cut:
        held = sum(len(t or "") for t in c.column("t").to_pylist())
        assert c.num_rows <= PIECE_ROWS and (held <= PIECE_BYTES or c.num_rows == 1)


@pytest.mark.parametrize("flatten,columns", [(snapshot.html_documents, ("url", "html")), (snapshot.dom_documents, ("dom",))])
def test_pages_are_flattened_a_piece_at_a_time(spark, flatten, columns, monkeypatch):
    """No output batch holds the tokens of a whole input batch; every page is there, without a number as well."""
    seen = spark.sparkContext.accumulator(0)
    make = snapshot._flattened

    def counted(piece, docs):
        seen.add(1)
        assert piece.num_rows <= PIECE_ROWS
        return make(piece, docs)

    monkeypatch.setattr(snapshot, "_flattened", counted)
    dom = json.dumps({"nodeName": "#document", "documentURL": "http://h/", "children": [{"nodeName": "P"}]})
    pages = spark.range(0, 1000, 1, 1).select(
        F.when(F.col("id") != 7, F.col("id")).alias("page_id"), F.lit("http://h/").alias("url"), F.lit("<p>x").alias("html"), F.lit(dom).alias("dom"))
    out = flatten(pages.select("page_id", *columns)).select("page_id", F.size("docs").alias("n")).collect()
    assert sorted(r.page_id for r in out if r.page_id is not None) == [i for i in range(1000) if i != 7] and len(out) == 1000
    assert all(r.n == 1 for r in out) and seen.value >= 4
