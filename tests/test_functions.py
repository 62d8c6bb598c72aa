import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from arcloom.functions import headers as H
from arcloom.functions import text as X
from arcloom.functions import urls as U


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("url,scheme,absolute,web", [
    ("http://a.example/x", "http", True, True), ("HTTPS://A.example", "https", True, True),
    ("mailto:x@y", "mailto", False, False), ("data:,x", "data", False, False), ("/rel", None, False, False),
    ("http://", "http", False, False), ("ftp://h/", "ftp", True, False), ("", None, False, False),
])
def test_url_predicates(spark, url, scheme, absolute, web):
    u = F.lit(url)
    r = spark.range(1).select(U.scheme(u).alias("s"), U.is_absolute(u).alias("a"), U.is_valid_web_url(u).alias("v")).first()
    assert (r.s, r.a, r.v) == (scheme, absolute, web)


@pytest.mark.parametrize("url,target", [
    ("http://a/x?y=1#z", "/x?y=1"), ("http://a", "/"), ("http://a?q", "/?q"), ("https://a:8080/", "/"),
])
def test_request_target(spark, url, target):
    assert one(spark, U.request_target(F.lit(url))) == target


@pytest.mark.parametrize("url,normal", [
    ("HTTP://Example.COM:80/A#x", "http://example.com/A"), ("https://h:443", "https://h/"),
    ("http://h:443/", "http://h:443/"), ("mailto:A@b#c", "mailto:A@b"),
])
def test_normalize(spark, url, normal):
    assert one(spark, U.normalize(F.lit(url))) == normal


@pytest.mark.parametrize("link,want", [
    ("/r", "http://h/r"), ("x", "http://h/a/x"), ("?q", "http://h/a/b?q"), ("#f", "http://h/a/b?c#f"),
    ("//o/p", "http://o/p"), ("https://z/", "https://z/"), ("mailto:m", "mailto:m"), ("", "http://h/a/b?c"),
])
def test_resolve(spark, link, want):
    assert one(spark, U.resolve(F.lit("http://h/a/b?c#d"), F.lit(link))) == want


@pytest.mark.parametrize("size,shown", [
    (0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (1024**2, "1.0 MiB"),
    (3 * 1024**3, "3.0 GiB"), (1024**4, "1.0 TiB"), (5 * 1024**5, "5120.0 TiB"),
])
def test_pretty_bytes(spark, size, shown):
    assert one(spark, X.pretty_bytes(F.lit(size))) == shown


@pytest.mark.parametrize("data", [b"", b"abc", "äöü".encode(), bytes(range(256))])
def test_base32_digest(spark, data):
    want = "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert one(spark, X.base32_sha1(F.lit(data))) == want


def test_small_scalars(spark):
    v = one(spark, X.viewport(F.lit("1920x1080")))
    assert (v.width, v.height) == (1920, 1080)
    assert one(spark, X.viewport(F.lit("wide"))).width is None
    assert [one(spark, X.console_level(F.lit(n))) for n in ("verbose", "info", "warning", "error", "odd")] == [0, 1, 2, 3, 1]
    assert bytes(one(spark, X.body_bytes(F.lit("w6Q="), F.lit(True)))) == "ä".encode()
    assert bytes(one(spark, X.body_bytes(F.lit("ä"), F.lit(False)))) == "ä".encode()


def test_unfold_splits_folded_values(spark):
    out = one(spark, H.unfold(F.create_map(F.lit("A"), F.lit("1\n2"), F.lit("B"), F.lit(""))))
    assert [(h.name, h.value) for h in out] == [("A", "1"), ("A", "2"), ("B", "")]


def pairs(*items):
    return F.array(*[H.header(n, F.lit(v)) for n, v in items])


@pytest.mark.parametrize("given,mime,body,text,want", [
    ([("content-type", "a/b"), ("Transfer-Encoding", "x")], "text/html", b"abc", True,
     [("content-type", "text/html; charset=utf-8"), ("Content-Length", "3")]),
    ([("X", "1")], "image/png", b"", False, [("X", "1"), ("Content-Type", "image/png"), ("Content-Length", "0")]),
    ([("X", "1"), ("CONTENT-ENCODING", "gzip")], "", None, None, [("X", "1")]),
    ([("Content-Length", "9"), ("x", "2"), ("Content-Encoding", "a"), ("content-encoding", "b")], None, b"z", True,
     [("Content-Length", "1"), ("x", "2")]),
])
def test_response_headers_describe_the_stored_body(spark, given, mime, body, text, want):
    out = one(spark, H.response_headers(pairs(*given), F.lit(mime).cast("string"), F.lit(body).cast("binary"),
                                        F.lit(text).cast("boolean")))
    assert [(h.name, h.value) for h in out] == want


def test_content_type_and_status_text(spark):
    assert one(spark, H.content_type(F.lit("a/b"), F.lit("utf-8"))) == "a/b; charset=utf-8"
    assert one(spark, H.content_type(F.lit("a/b"), F.lit(None).cast("string"))) == "a/b"
    got = [one(spark, H.status_text(F.lit(c), F.lit(t))) for c, t in ((200, "Fine"), (404, ""), (299, ""), (999, None))]
    assert got == ["Fine", "Not Found", "No status text available", "No status text available"]


def test_version_order(spark):
    def less(a, b):
        return one(spark, X.version_key(F.lit(a)) < X.version_key(F.lit(b)))
    assert one(spark, X.version_key(F.lit("1.0")) == X.version_key(F.lit("1.0.0")))
    order = ["0.9", "1.dev1", "1a1.dev1", "1a1", "1b2", "1rc1", "1", "1+x", "1+3", "1.post1.dev2", "1.post1", "1.9", "1.10", "1!0"]
    assert all(less(a, b) for a, b in zip(order, order[1:]))
    assert one(spark, X.version_key(F.lit("latest"))) is None
