"""All registered queries and their SQL twins (importing this module
imports every query module, which registers itself)."""

from __future__ import annotations

from . import (  # noqa: F401
    q_generators,
    q_metrics,
    q_placement,
    q_queueing,
    q_records,
    q_streaming,
    q_workloads,
)
from .oracle import ORACLE
from .registry import QUERIES

__all__ = ["ORACLE", "QUERIES"]
