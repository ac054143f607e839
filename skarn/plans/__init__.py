"""All registered queries of the engine: importing this package registers them."""

from skarn.plans import agent, conversation, extensions, layout, library, retrieval, streams
from skarn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "agent", "conversation", "extensions", "layout", "library", "retrieval", "streams"]
