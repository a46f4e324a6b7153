"""Whole jobs built from the operators, and the checked queries over the test tables."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    """The registered queries and their SQL twins."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    from brackish.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
