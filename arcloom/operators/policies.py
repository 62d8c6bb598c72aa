"""Recursion policies and block lists as predicate columns."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth_limit(most: int) -> Column:
    """0 is the seed alone, 1 the seed and what it links to."""
    return F.col("depth") <= most


def prefix_limit(prefix: str) -> Column:
    return F.startswith(F.col("url"), F.lit(prefix))


def parse_policy(text: str | None, seed: str) -> Column:
    """Policy as a user writes it: nothing, a depth, or ``prefix``."""
    if text is None:
        return depth_limit(0)
    if text.isdigit():
        return depth_limit(int(text))
    if text == "prefix":
        return prefix_limit(seed)
    raise ValueError(f"unsupported recursion mode: {text!r}")


def load_blocklist(path: str) -> list[tuple[str, str]]:
    """Rules of a JSON object pattern -> message, in the order of the file."""
    with open(path, encoding="utf-8") as fd:
        return list(json.load(fd).items())


def _anchored(pattern: str) -> str:
    re.compile(pattern)  # fail on the driver, not in a task
    return f"(?i)^(?:{pattern})"


def blocked_by(url: Column, rules: Mapping[str, str] | Sequence[tuple[str, str]]) -> Column:
    """Message of the first rule whose pattern matches the URL's beginning, else NULL.

    Rules are configuration, so they become one CASE expression in rule order:
    each pattern is compiled once and nothing is joined.
    """
    pairs = list(rules.items()) if isinstance(rules, Mapping) else list(rules)
    out = F.lit(None).cast("string")
    for pattern, message in reversed(pairs):
        out = F.when(F.rlike(url, F.lit(_anchored(pattern))), F.lit(message)).otherwise(out)
    return out


def not_blocked(urls: DataFrame, rules: Mapping[str, str] | Sequence[tuple[str, str]]) -> DataFrame:
    return urls.filter(blocked_by(F.col("url"), rules).isNull())
