"""Registered queries over the given tables."""

from types import ModuleType


def load_queries() -> ModuleType:
    """The registry, with every query module loaded into it."""
    from snapops.plans import catalog_queries, node_queries, registry, stream_queries  # noqa: F401

    return registry
