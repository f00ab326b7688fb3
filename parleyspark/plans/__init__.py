"""Composite queries over the supplied tables."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "gate_queries", "metric_queries", "thread_queries", "evaluation_queries", "stream_queries", "source_queries")


def load_all():
    """Import every query module and return (queries, SQL twins)."""
    for name in MODULES:
        importlib.import_module(f"parleyspark.plans.{name}")
    from parleyspark.plans.registry import QUERIES, TWINS

    return QUERIES, TWINS
