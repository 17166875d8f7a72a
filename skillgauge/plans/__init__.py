"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ("q_metrics", "q_events", "q_quality", "q_tables", "q_spatial", "q_blend", "q_stream")


def load_all():
    """All registered queries by name, in registration order."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    from .registry import REGISTRY

    return REGISTRY
