"""URL expressions.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcloom.fixed_values import WEB_SCHEMES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url: Column | str) -> Column:
    """Lower-case scheme, also for URLs without an authority (``mailto:``, ``data:``)."""
    return F.lower(F.nullif(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")))


def host(url: Column | str) -> Column:
    """Lower-case host name, NULL when the URL is not a valid absolute one."""
    return F.lower(F.try_parse_url(_col(url), F.lit("HOST")))


def strip_fragment(url: Column | str) -> Column:
    return F.substring_index(_col(url), "#", 1)


def request_target(url: Column | str) -> Column:
    """Path and query as they appear in a request line; ``/`` for an empty path."""
    rest = F.regexp_extract(strip_fragment(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def is_web(url: Column | str) -> Column:
    """Scheme whitelist: only web pages are captured, followed and snapshotted."""
    return F.coalesce(scheme(url).isin(*WEB_SCHEMES), F.lit(False))


def is_absolute(url: Column | str) -> Column:
    """Scheme and authority are present."""
    return F.coalesce(F.regexp_like(_col(url), F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")), F.lit(False))


def is_valid_web_url(url: Column | str) -> Column:
    return is_web(url) & is_absolute(url)


def _without_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc)
                       .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s))))
    joined = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    dotted = path.rlike(r"/\.\.?(/|$)")
    return F.when(dotted, F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))).otherwise(path)


def _upper_escapes(text: Column) -> Column:
    pieces = F.transform(F.split(text, "%"), lambda p, i: F.when(
        (i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), p.substr(F.lit(3), F.length(p)))).otherwise(p))
    return F.when(F.contains(text, F.lit("%")), F.array_join(pieces, "%")).otherwise(text)


def normalize(url: Column | str) -> Column:
    """Comparable form: scheme and host in lower case, default port, fragment and dot segments gone, escapes in upper case.

    Characters are neither escaped nor unescaped.  What is no absolute URL only loses its fragment.
    """
    u = strip_fragment(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$"
    given = F.regexp_extract(u, pattern, 2)
    user = F.regexp_extract(given, "^(.*@)", 1)
    authority = F.concat(user, F.lower(F.regexp_replace(given, "^.*@", "")))
    path, query = F.regexp_extract(u, pattern, 3), F.regexp_extract(u, pattern, 4)
    default_port = F.when(scheme(u) == "http", F.lit(r":(80)?$")).when(scheme(u) == "https", F.lit(r":(443)?$"))
    bare = F.coalesce(F.regexp_replace(authority, default_port, F.lit("")), authority)
    rooted = F.when(path == "", F.lit("/")).otherwise(_without_dots(path))
    return F.when(is_absolute(u), F.concat(scheme(u), F.lit("://"), bare, _upper_escapes(F.concat(rooted, query)))).otherwise(u)


def resolve(base: Column | str, link: Column | str) -> Column:
    """Absolute form of a link for the common cases, natively.

    Absolute, protocol-relative, root-relative, query, fragment and sibling
    links are covered; dot segments are kept as written.
    """
    base, link = strip_fragment(base), _col(link)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    without_query = F.substring_index(base, "?", 1)
    folder = F.regexp_extract(without_query, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*)?/)[^/]*$", 1)
    folder = F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(scheme(link).isNotNull(), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(without_query, link))
        .when(link.startswith("#") | (link == ""), F.concat(base, link))
        .otherwise(F.concat(folder, link))
    )
