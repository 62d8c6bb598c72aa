"""Known data errors: which archives are affected, and how to repair them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import ERRATA_CONTENT_TYPE, ERRATA_PRE_RELEASE
from arcloom.functions.text import parse_requirement, requirement_holds
from arcloom.operators.records import render_headers
from arcloom.operators.skew import lookup_join
from arcloom.schema import NAMES, HeaderNames

PAYLOAD_SCHEMA = (
    "STRUCT<tool: STRING, parameters: STRUCT<errata: ARRAY<STRING>>,"
    " software: STRUCT<self: ARRAY<STRUCT<projectName: STRING, version: STRING>>>>"
)


@dataclass(frozen=True)
class Erratum:
    """A known error.  ``fix`` maps ``column`` to its right value; none = not fixable."""

    uuid: str
    description: str
    affects: Sequence[str]
    url: str | None = None
    column: str | None = None
    fix: Callable[[Column], Column] | None = field(default=None, compare=False)

    @property
    def fixable(self) -> bool:
        return self.fix is not None

    def matches(self, versions: Column) -> Column:
        """All requirements hold for a ``MAP<package, version>``; a missing package fails."""
        held = F.lit(True)
        for requirement in self.affects:
            package, clauses = parse_requirement(requirement)
            held = held & requirement_holds(F.try_element_at(versions, F.lit(package)), clauses)
        return held


def repaired_charset(content_type: Column) -> Column:
    return F.replace(content_type, F.lit("; encoding="), F.lit("; charset="))


def builtin_errata(package: str) -> list[Erratum]:
    """The known errors of the capture software whose distribution is ``package``."""
    return [
        Erratum(ERRATA_PRE_RELEASE, "Written by a version before 1.0, for which no errata are kept.",
                [f"{package}<1.0"]),
        Erratum(ERRATA_CONTENT_TYPE, "Content-Type says encoding where it has to say charset.",
                [f"{package}==1.0.0"], column="content_type", fix=repaired_charset),
    ]


def erratum_by_id(errata: Sequence[Erratum], uuid: str, only_fixable: bool = True) -> Erratum:
    found = next((e for e in errata if e.uuid == uuid), None)
    if found is None:
        raise ValueError(f"erratum {uuid} does not exist")
    if only_fixable and not found.fixable:
        raise ValueError(f"erratum {uuid} is not fixable")
    return found


def warcinfo_payloads(records: DataFrame) -> DataFrame:
    """Parsed JSON of ``warcinfo`` records; foreign or broken payloads give NULLs."""
    text = F.decode("payload", "UTF-8")
    return records.filter("rec_type = 'warcinfo'").select(
        "file_path", "file_seq", "record_seq", "record_id", F.from_json(text, PAYLOAD_SCHEMA).alias("info")
    )


def fixed_before(payloads: DataFrame, fix_tool: str) -> DataFrame:
    """Where each erratum was first marked as fixed: ``(file_seq, uuid, fixed_at)``."""
    return (
        payloads.filter(F.col("info.tool") == fix_tool)
        .select("file_seq", "record_seq", F.explode("info.parameters.errata").alias("uuid"))
        .groupBy("file_seq", "uuid")
        .agg(F.min("record_seq").alias("fixed_at"))
    )


def check(records: DataFrame, errata: Sequence[Erratum], fix_tool: str) -> DataFrame:
    """One row per ``warcinfo`` and erratum that affects it and was not fixed earlier in the file.

    The registry is a list in the program, so it becomes one literal array that
    is filtered per row: no join.  Only the ids of earlier fixes are joined, and
    of those just the first per file and erratum.
    """
    payloads = warcinfo_payloads(records)
    packages = F.filter("info.software.self", lambda p: p["projectName"].isNotNull())
    # as in a dictionary, the last entry of a package counts
    names = F.array_distinct(F.transform(packages, lambda p: p["projectName"]))
    versions = F.map_from_arrays(names, F.transform(
        names, lambda n: F.element_at(F.filter(packages, lambda p: p["projectName"] == n), -1)["version"]))
    known = [
        F.when(e.matches(F.col("versions")), F.struct(
            F.lit(e.uuid).alias("uuid"), F.lit(e.description).alias("description"),
            F.lit(e.url).cast("string").alias("url"), F.lit(e.fixable).alias("fixable")))
        for e in errata
    ]
    hits = (
        payloads.filter(F.col("info.software.self").isNotNull()
                        & (F.coalesce(F.col("info.tool"), F.lit("")) != fix_tool))
        .withColumn("versions", versions)
        .withColumn("e", F.explode(F.array_compact(F.array(*known))))
        .select("file_path", "file_seq", "record_seq", "record_id", "e.*")
    )
    earlier = fixed_before(payloads, fix_tool)
    return (
        lookup_join(hits, earlier, ["file_seq", "uuid"], ["record_seq"])
        .filter(F.col("fixed_at").isNull() | (F.col("fixed_at") > F.col("record_seq")))
        .drop("fixed_at")
    )


def has_errata(records: DataFrame, errata: Sequence[Erratum], fix_tool: str) -> DataFrame:
    """Per file whether any erratum applies."""
    files = records.groupBy("file_seq").agg(F.first("file_path").alias("file_path"))
    affected = check(records, errata, fix_tool).groupBy("file_seq").agg(F.count(F.lit(1)).alias("n_errata"))
    return files.join(affected, "file_seq", "left").select(
        "file_seq", "file_path", F.coalesce("n_errata", F.lit(0)).alias("n_errata"),
        F.col("n_errata").isNotNull().alias("has_errata"),
    )


def apply_fix(records: DataFrame, erratum: Erratum) -> DataFrame:
    """Apply a fix to every record and tell which changed (``changed``)."""
    if not erratum.fixable:
        raise ValueError(f"erratum {erratum.uuid} is not fixable")
    fixed = erratum.fix(F.col(erratum.column))
    return records.withColumn("__fixed", fixed).withColumn(
        "changed", ~F.col("__fixed").eqNullSafe(F.col(erratum.column))
    ).withColumn(erratum.column, F.col("__fixed")).drop("__fixed")


def fixed_records(records: DataFrame, erratum: Erratum, names: HeaderNames = NAMES) -> DataFrame:
    """Records after the fix, with their header list in step."""
    out = apply_fix(records, erratum)
    if erratum.column != "content_type":
        return render_headers(out, names)
    swap = F.transform("headers", lambda h: F.struct(
        h["name"].alias("name"),
        F.when(F.lower(h["name"]) == "content-type", F.col("content_type")).otherwise(h["value"]).alias("value")))
    return out.withColumn("headers", F.when(F.col("changed"), swap).otherwise(F.col("headers"))).drop("changed")


def fix_totals(records: DataFrame, erratum: Erratum) -> DataFrame:
    return apply_fix(records, erratum).agg(
        F.count_if("changed").alias("fixed"), F.count(F.lit(1)).alias("processed")
    )
