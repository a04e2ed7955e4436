"""All registered queries."""

from stringwatch.plans import (  # noqa: F401
    alarm_queries,
    audit_queries,
    detection_queries,
    device_queries,
    ewma_queries,
    gate_queries,
    residual_queries,
    stream_queries,
    string_queries,
)
from stringwatch.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
