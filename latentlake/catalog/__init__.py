"""Registered queries with their SQL counterparts."""

from importlib import import_module

MODULES = ("vectors", "candidates", "relaxation", "diagnosis", "pairwork", "reducing", "planes", "files", "composed")


def load_catalog():
    from latentlake.catalog import base

    for m in MODULES:
        import_module(f"latentlake.catalog.{m}")
    return base.QUERIES, base.ORACLES
