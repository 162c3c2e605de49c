"""Query catalog: importing this package registers every named query."""

from . import catalog, interaction, knowledge_plan, metrics_plan, rendering, roundtrip, streaming_plan  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
