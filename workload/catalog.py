"""Imports every query module so that the registry is complete."""

from workload import analytics_queries, outlook_queries, service_queries, sources_queries, stream_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
