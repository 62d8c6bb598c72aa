"""HTTP and archive header expressions over ``ARRAY<STRUCT<name,value>>``."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcloom.fixed_values import NO_STATUS_TEXT

HEADERS_TYPE = "ARRAY<STRUCT<name: STRING, value: STRING>>"
CRLF = "\r\n"


def header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def no_headers() -> Column:
    return F.array().cast(HEADERS_TYPE)


def unfold(headers: Column) -> Column:
    """Browser header map -> list; a value folded with newlines becomes several headers."""
    per_name = F.transform(
        F.map_entries(headers),
        lambda e: F.transform(
            F.split(e["value"], "\n"),
            lambda v: F.struct(e["key"].alias("name"), v.alias("value")),
        ),
    )
    return F.coalesce(F.flatten(per_name), no_headers())


def value_of(headers: Column, name: str) -> Column:
    """First value of a header, compared without case."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(hits, F.lit(0))["value"]


def without(headers: Column, *names: str) -> Column:
    lowered = [n.lower() for n in names]
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*lowered))


def replaced(headers: Column, name: str, value: Column) -> Column:
    """Set a header: at the place of its first occurrence, else at the end.

    A NULL ``value`` leaves the headers alone.
    """
    at = F.array_position(F.transform(headers, lambda h: F.lower(h["name"])), name.lower())
    changed = F.transform(
        headers,
        lambda h, i: F.struct(
            h["name"].alias("name"),
            F.when(i == at - 1, value).otherwise(h["value"]).alias("value"),
        ),
    )
    added = F.concat(headers, F.array(header(name, value)))
    return F.when(value.isNull(), headers).when(at > 0, changed).otherwise(added)


def present(*headers: Column) -> Column:
    """Header list of those headers whose value is not NULL."""
    return F.filter(F.array(*headers), lambda h: h["value"].isNotNull())


def content_type(mime: Column, charset: Column) -> Column:
    return F.when(charset.isNull(), mime).otherwise(F.concat(mime, F.lit("; charset="), charset))


def status_text(status: Column, text: Column) -> Column:
    """Sent phrase, else the standard phrase of the code, else a fixed note."""
    phrases = json.dumps({str(int(code)): names[0] for code, names in BaseHTTPRequestHandler.responses.items()})
    # one literal, folded into a constant map by the optimizer
    known = F.from_json(F.lit(phrases), "MAP<STRING, STRING>")
    standard = F.try_element_at(known, status.cast("string"))
    return F.coalesce(F.nullif(text, F.lit("")), standard, F.lit(NO_STATUS_TEXT))


def response_headers(headers: Column, mime: Column, body: Column, body_is_text: Column) -> Column:
    """Headers that describe the stored body instead of the transferred one.

    Bodies are stored decoded, so transfer and content encodings go; the type
    follows what the browser saw, text being UTF-8; the length is the stored one.
    """
    kept = without(headers, "transfer-encoding", "content-encoding")
    charset = F.when(body_is_text, F.lit("utf-8"))
    typed = replaced(kept, "Content-Type", content_type(F.nullif(mime, F.lit("")), charset))
    return replaced(typed, "Content-Length", F.octet_length(body).cast("string"))


def block(start_line: Column, headers: Column) -> Column:
    """Header block as stored in an archive record."""
    lines = F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit(CRLF)))
    return F.concat(start_line, F.lit(CRLF), F.array_join(lines, ""), F.lit(CRLF))
