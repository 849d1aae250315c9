"""Queries over the given tables, each with its oracle; ``load`` imports all of their modules."""

from __future__ import annotations

import importlib

MODULES = ("text", "scalar", "match", "resolve", "evidence", "aggregate", "geo", "zones", "regions", "clusters", "tiers", "pages", "filed", "release", "exact", "chronicle", "views", "gates", "streams")


def load():
    from . import base

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return base
