"""Composed plans: dashboards, file profiles and the named queries."""

import importlib

_MODULES = ("profile_queries", "catalog_queries", "scalar_queries", "file_queries", "stream_queries", "analysis_queries")


def all_queries():
    """The registry with every query module loaded."""
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.registry")
