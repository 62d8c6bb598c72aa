"""Output forms: JSON lines, and one folder per host and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.urls import host
from arcloom.operators.skew import SEGMENT_SPAN, numbered

JSON_DATES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def json_line(df: DataFrame) -> Column:
    """The row as one JSON object; binary becomes text, dates ISO, nothing fails."""
    columns = [
        F.to_char(F.col(n), F.lit("utf-8")).alias(n) if t == "binary" else F.col(f"`{n}`")
        for n, t in df.dtypes
    ]
    return F.to_json(F.struct(*columns), JSON_DATES)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(json_line(df).alias("value")).write.mode(mode).text(path)


def stream_json_lines(df: DataFrame, path: str, checkpoint: str):
    """Writer of a stream as JSON lines; the file sink's log makes each batch appear once."""
    return (
        df.select(json_line(df).alias("value")).writeStream.format("text").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )


def has_template(name: str) -> bool:
    """Whether an output name has parts to fill: then every page gets a file of its own, else all share one output."""
    return "{" in name and "}" in name


def output_name(template: str, host_: Column, date: Column, seqnum: Column) -> Column:
    """``{host}-{date}-{seqnum}.warc.gz`` filled per row; a name without parts is the same for all rows."""
    name = F.lit(template)
    for part, value in (("{host}", host_), ("{date}", date), ("{seqnum}", seqnum.cast("string"))):
        name = F.replace(name, F.lit(part), value)
    return name


def with_output_parts(df: DataFrame, url: str, date: Column, order: str, crawl: str | None = None, start: int = 1,
                      span: int = SEGMENT_SPAN) -> DataFrame:
    """Add ``host``, ``date`` and ``seqnum`` (1, 2, … per crawl in order), the parts of an output name.

    ``crawl`` names the column that tells crawls apart; without it all rows are of one.
    """
    parts = df.withColumn("host", F.coalesce(host(url), F.lit(""))).withColumn("date", date)
    if crawl is not None:
        return numbered(parts, [crawl], order, "seqnum", start=start, span=span)
    return numbered(parts.withColumn("__crawl", F.lit(0)), ["__crawl"], order, "seqnum", start=start, span=span).drop("__crawl")


def write_outputs(df: DataFrame, path: str, append: bool = False, template: str = "{host}-{date}") -> None:
    """One folder per filled template, or one output for all rows if it has no parts to fill.

    Refuses an existing output unless appending.  Rows of a folder are brought
    together so that it gets few files; a large folder is split over tasks.
    """
    mode = "append" if append else "errorifexists"
    if not has_template(template):
        df.write.mode(mode).parquet(f"{path}/{template}")
        return
    keys = [k for k in ("host", "date", "seqnum") if "{" + k + "}" in template]
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_by_host(df: DataFrame, path: str, append: bool = False) -> None:
    """One folder per host and date."""
    write_outputs(df, path, append, "{host}-{date}")
