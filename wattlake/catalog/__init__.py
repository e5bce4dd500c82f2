"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("frame_queries", "view_queries", "operation_queries", "feature_queries", "text_queries", "source_queries")


def load():
    from wattlake.catalog import base

    for module in MODULES:
        importlib.import_module(f"wattlake.catalog.{module}")
    return base.QUERIES, base.ORACLES
