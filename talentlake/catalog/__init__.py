"""Registered queries, each with the independent SQL it is checked against."""

from importlib import import_module

from .registry import REGISTRY, Query

FAMILIES = ("text", "skills", "match", "features", "evaluation", "report", "extract", "quality", "job")


def load() -> dict[str, Query]:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}_queries")
    return REGISTRY
