"""All registered queries and their oracles."""

from quarry.plans import answers, dedup, examples, filters, metrics, overlap, select  # noqa: F401
from quarry.plans.registry import ORACLES, QUERIES  # noqa: F401
