"""Queries: every module registers its queries on import."""

import importlib

MODULES = ["inputs", "notices", "extraction", "rules", "quality", "layout", "joins", "learning", "streams", "client"]


def load_all():
    for name in MODULES:
        importlib.import_module(f"gavelwork.plans.{name}")
