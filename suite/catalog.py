"""All registered queries."""

from suite import basics, digging, fleet, models  # noqa: F401
from suite.registry import ORACLES, QUERIES  # noqa: F401
