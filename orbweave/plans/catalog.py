"""All plan modules; importing this registers their queries."""

from orbweave.plans import answers, checks, geometry, graphs, relational, relations, retrieval, rules, scans, streams, text, walks  # noqa: F401
from orbweave.plans.registry import ORACLES, QUERIES  # noqa: F401
