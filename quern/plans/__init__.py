"""Registered queries and their SQL restatements, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = [
    "joins",
    "splits",
    "grading",
    "profiling",
    "aggregates",
    "timelines",
    "texts",
    "records",
    "probes",
    "streams",
]


def load_all():
    from quern.plans import registry

    for area in AREAS:
        import_module(f"quern.plans.{area}")
    return registry.QUERIES, registry.SQL
