"""Registered queries, grouped by area."""

from importlib import import_module

AREAS = ("reduction", "detection", "calibration", "agreement", "search", "catalogue", "gates", "datasets", "runlogs")


def load_registry():
    for area in AREAS:
        import_module(f"curvelake.plans.{area}")
    from curvelake.plans.registry import REGISTRY

    return REGISTRY
