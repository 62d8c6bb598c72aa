"""All queries of this subpackage; importing it registers them."""

from arcloom.llm import queries, queries_text  # noqa: F401
from arcloom.llm.registry import ORACLES, QUERIES  # noqa: F401
