"""All named queries."""

from flowgauge.plans import graphs, monitoring, sensing, streams, telemetry  # noqa: F401
from flowgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
