"""Registered queries."""

from importlib import import_module

MODULES = ["history_queries", "rating_queries", "pair_queries", "profile_queries", "text_queries", "model_queries", "stream_queries", "source_queries", "raw_queries"]


def load():
    from duelframe.catalog.base import CATALOG

    for m in MODULES:
        import_module(f"duelframe.catalog.{m}")
    return CATALOG
