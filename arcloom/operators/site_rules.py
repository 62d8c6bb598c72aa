"""Per-site rules: which selectors apply to a page's host."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.urls import host

SELECTOR_TYPE = (
    "STRUCT<description: STRING, selector: STRING, urls: ARRAY<STRING>, multi: BOOLEAN, throttle: INT>"
)
RULES_DDL = f"ordinal INT, match STRING, selector ARRAY<{SELECTOR_TYPE}>"


def load_rules(path: str) -> list[dict[str, Any]]:
    """Rules from a multi-document YAML or a JSON-lines file (a small configuration file)."""
    with open(path, encoding="utf-8") as fd:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML rules need PyYAML; use a JSON-lines file instead") from e
            return [d for d in yaml.safe_load_all(fd) if d]
        return [json.loads(line) for line in fd if line.strip()]


def _selectors(rule: Mapping[str, Any]) -> list[tuple]:
    return [
        (s.get("description"), s["selector"], s.get("urls") or [], bool(s.get("multi", False)), s.get("throttle"))
        for s in rule["selector"]
    ]


def rules_frame(spark: SparkSession, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    rows = [(i, r["match"], _selectors(r)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES_DDL)


def selectors_for(url: Column | str, rules: Sequence[Mapping[str, Any]]) -> Column:
    """Selectors of all rules whose pattern is found in the URL's host, in rule order.

    Rules are configuration: one literal per rule behind its pattern, so the
    lookup is an expression of the row and needs no join.
    """
    name = host(url)
    found = []
    for rule in rules:
        literal = F.from_json(
            F.lit(json.dumps([
                {"description": d, "selector": s, "urls": u, "multi": m, "throttle": t}
                for d, s, u, m, t in _selectors(rule)
            ])), f"ARRAY<{SELECTOR_TYPE}>")
        found.append(F.when(F.rlike(name, F.lit(f"(?i){rule['match']}")), literal))
    return F.flatten(F.array_compact(F.array(*found)))


def rule_catalogue(rules: DataFrame) -> DataFrame:
    """Per rule its descriptions and example hosts, or its pattern when it has no example."""
    hosts = F.array_sort(F.array_distinct(F.array_compact(
        F.transform(F.flatten(F.transform("selector", lambda s: F.coalesce(s["urls"], F.array().cast("array<string>")))),
                    lambda u: F.lower(F.try_parse_url(u, F.lit("HOST")))))))
    return rules.select(
        "ordinal", "match",
        F.when(F.size(hosts) > 0, F.array_join(hosts, ", ")).otherwise(F.col("match")).alias("title"),
        F.transform("selector", lambda s: s["description"]).alias("descriptions"),
    )


def examples_match(rules: DataFrame) -> DataFrame:
    """Example URLs whose host does not match their own rule (should be none)."""
    return (
        rules.select("ordinal", "match", F.explode(F.flatten(F.transform("selector", lambda s: s["urls"]))).alias("url"))
        .filter(~F.rlike(host("url"), F.concat(F.lit("(?i)"), F.col("match"))))
    )
