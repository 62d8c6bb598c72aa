"""Queries over the driver tables, each next to the SQL it is checked against."""

from arcloom.plans import archives, captures, dedup, frontier, logs, streams, urls  # noqa: F401
from arcloom.plans.base import ORACLES, QUERIES  # noqa: F401
