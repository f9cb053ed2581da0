"""Registered queries: the engine's operators over the driver's tables."""

from tickframe.plans import (agents, chunks, documents, files, formats, inventory, packets, quality,  # noqa: F401
                             runs, scalars, states)
from tickframe.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
