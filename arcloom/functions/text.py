"""Small scalar expressions: sizes, levels, digests, versions, bodies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcloom.fixed_values import CONSOLE_LEVELS, LEVEL_INFO


def once(expr: Column) -> Column:
    """Compute an expensive column once, as the only generator of a ``select``.

    Filters on a parsed column are pushed below its projection, which makes
    every one of them parse again; they are not pushed below a generator.
    """
    return F.explode(F.array(expr))


def pretty_bytes(size: Column) -> Column:
    """1536 -> ``1.5 KiB``; TiB is the largest unit."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.format_string("%.1f TiB", size / F.lit(1024.0**4))
    for power in range(3, -1, -1):
        shown = F.format_string(f"%.1f {units[power]}", size / F.lit(1024.0**power))
        out = F.when(size < F.lit(1024.0 ** (power + 1)), shown).otherwise(out)
    return out


def console_level(name: Column) -> Column:
    level = F.lit(LEVEL_INFO)
    for text, number in CONSOLE_LEVELS.items():
        level = F.when(name == text, F.lit(number)).otherwise(level)
    return level


def viewport(text: Column) -> Column:
    """``1920x1080`` -> struct(width, height)."""
    part = F.split(text, "x")
    return F.struct(
        F.get(part, F.lit(0)).try_cast("int").alias("width"),
        F.get(part, F.lit(1)).try_cast("int").alias("height"),
    )


def iso_date(ts: Column) -> Column:
    """Archive date form with seconds, UTC session assumed."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def body_bytes(body: Column, is_base64: Column) -> Column:
    """Body as bytes, from base64 or from UTF-8 text."""
    return F.when(is_base64, F.unbase64(body)).otherwise(F.encode(body, "UTF-8"))


def base32_sha1(data: Column) -> Column:
    """``sha1:<base32>``, the digest form archives use, without leaving the JVM.

    Twenty bits are five hex digits and four base32 digits, so the hex digest
    is converted in eight groups.
    """
    digest = F.sha1(data)
    groups = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    base32 = F.translate(
        F.upper(F.concat(*groups)),
        "0123456789ABCDEFGHIJKLMNOPQRSTUV",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    )
    return F.concat(F.lit("sha1:"), base32)


def urn_uuid(*parts: Column) -> Column:
    """Record id derived from what the record is, so a retried task repeats it."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    pieces = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


# --- versions -----------------------------------------------------------------

_NUMBER = "decimal(38,0)"
# release numbers, then pre-, post- and development releases and a local label
VERSION = (r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*))?"
           r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$")
_EPOCH, _RELEASE, _PRE, _PRE_N, _POST_DASH, _POST, _POST_N, _DEV, _DEV_N, _LOCAL = range(1, 11)
_FINAL = 3  # pre-release ranks: 0 alpha, 1 beta, 2 candidate; a development release of a final one comes before all


def _version_parts(version: Column) -> Column:
    """Struct whose fields compare in the order of versions, NULL if it is none; ``1.0`` equals ``1.0.0``.

    Parts keep their full length: any number of them, 38 digits each.
    """
    def group(i: int) -> Column:
        return F.regexp_extract(version, VERSION, i)

    def number(i: int) -> Column:
        return F.coalesce(group(i).try_cast(_NUMBER), F.lit(0).cast(_NUMBER))

    parts = F.transform(F.split(group(_RELEASE), "[.]"), lambda p: p.try_cast(_NUMBER))
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != 0, i + 1).otherwise(0)))
    named, has_post, has_dev = F.lower(group(_PRE)), (group(_POST) != "") | (group(_POST_DASH) != ""), group(_DEV) != ""
    pre = (F.when(named.isin("a", "alpha"), 0).when(named.isin("b", "beta"), 1)
           .when(named.isin("c", "rc", "pre", "preview"), 2).when(has_dev & ~has_post, -1).otherwise(_FINAL))
    post = F.when(has_post, F.greatest(number(_POST_N), number(_POST_DASH))).otherwise(F.lit(-1).cast(_NUMBER))
    dev = F.when(has_dev, number(_DEV_N))
    local = F.when(group(_LOCAL) != "", F.transform(F.split(F.lower(group(_LOCAL)), "[-_.]"), lambda p: F.struct(
        p.rlike("^[0-9]+$").alias("numeric"), p.try_cast(_NUMBER).alias("n"), F.when(~p.rlike("^[0-9]+$"), p).alias("t"))))
    return F.when(version.rlike(VERSION), F.struct(
        number(_EPOCH).alias("epoch"), F.slice(parts, 1, last).alias("release"), pre.alias("pre"), number(_PRE_N).alias("pre_n"),
        post.alias("post"), dev.isNull().alias("no_dev"), dev.alias("dev"), local.isNotNull().alias("has_local"),
        local.alias("local")))


def version_key(version: Column) -> Column:
    return _version_parts(version)


def _public(version: Column) -> Column:
    return F.regexp_replace(version, r"\+.*$", "")


def _base(version: Column) -> Column:
    """Epoch and release only."""
    return F.regexp_extract(version, r"(?i)^\s*v?((?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*)", 1)


def _starts_with(version: Column, wanted: str) -> Column:
    """``==wanted.*``: the release begins with the parts of ``wanted``, shorter ones filled with zeros."""
    epoch, _, release = wanted.rpartition("!")
    parts = release.split(".")
    have = F.split(F.regexp_replace(_base(version), "^[0-9]+!", ""), "[.]")
    same = F.coalesce(F.regexp_extract(version, VERSION, _EPOCH).try_cast(_NUMBER), F.lit(0)) == F.lit(int(epoch or 0))
    for i, part in enumerate(parts):
        same = same & (F.coalesce(F.get(have, F.lit(i)).try_cast(_NUMBER), F.lit(0)) == F.lit(part).cast(_NUMBER))
    return version.rlike(VERSION) & same


def parse_requirement(text: str) -> tuple[str, list[tuple[str, str]]]:
    """``pkg<1.0,>0.1`` -> ``("pkg", [("<", "1.0"), (">", "0.1")])``; also ``~=`` and ``==1.*``."""
    match = re.fullmatch(r"\s*([A-Za-z0-9._-]+?)\s*((?:[<>=!~]=?|===?).*)?", text)
    if not match:
        raise ValueError(f"not a version requirement: {text!r}")
    package, rest = match.group(1), match.group(2) or ""
    clauses = []
    for clause in filter(None, (c.strip() for c in rest.split(","))):
        hit = re.fullmatch(r"(<=|>=|==|!=|~=|<|>)\s*(\S+)", clause)
        plain = hit and hit.group(2).removesuffix(".*")
        if not hit or not re.fullmatch(VERSION.replace("(?i)", ""), plain, re.IGNORECASE):
            raise ValueError(f"unsupported version clause: {clause!r}")
        op = hit.group(1)
        if plain != hit.group(2) and (op not in ("==", "!=") or not re.fullmatch(r"(?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*", plain)):
            raise ValueError(f"unsupported version clause: {clause!r}")
        if op == "~=" and "." not in plain:
            raise ValueError(f"~= needs two parts: {clause!r}")
        clauses.append((op, hit.group(2)))
    return package, clauses


def _clause_holds(version: Column, op: str, wanted: str) -> Column:
    if wanted.endswith(".*"):
        found = _starts_with(version, wanted.removesuffix(".*"))
        return found if op == "==" else version.rlike(VERSION) & ~found
    if op == "~=":
        parts = re.match(r"(?i)\s*v?((?:[0-9]+!)?[0-9.]+[0-9]|[0-9])", wanted).group(1).split(".")
        return _clause_holds(version, ">=", wanted) & _starts_with(version, ".".join(parts[:-1]))
    # a clause without a local label does not see the labels of versions
    seen = version if "+" in wanted and op in ("==", "!=") else _public(version)
    have, limit = _version_parts(seen), _version_parts(F.lit(wanted))
    if op == "<":
        # not a pre-release of the limit itself, unless that is one
        own = (have["epoch"] == limit["epoch"]) & (have["release"] == limit["release"])
        early = ((have["pre"] < _FINAL) | ~have["no_dev"]) & own & (limit["pre"] == _FINAL) & limit["no_dev"]
        return (have < limit) & ~early
    if op == ">":
        # not a post-release of the limit itself, unless that is one
        own = (have["epoch"] == limit["epoch"]) & (have["release"] == limit["release"])
        late = (have["post"] >= 0) & own & (limit["post"] < 0)
        return (have > limit) & ~late
    return {"<=": have <= limit, ">=": have >= limit, "==": have == limit, "!=": have != limit}[op]


def requirement_holds(version: Column, clauses: Sequence[tuple[str, str]]) -> Column:
    """All clauses hold for the version; a missing version never does, nor does one that is no version number."""
    ok = version.isNotNull()
    for op, wanted in clauses:
        ok = ok & _clause_holds(version, op, wanted)
    return F.coalesce(ok, F.lit(False))
