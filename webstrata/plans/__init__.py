"""Query modules: each registers its queries in the catalogue when imported."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("relational", "corpus", "collection", "upkeep", "archive", "acquisition", "analysis", "review", "ledger")


def load_all() -> None:
    for name in MODULES:
        import_module(f"webstrata.plans.{name}")
