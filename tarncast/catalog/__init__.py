"""Registered queries: each runs on whole tables and, where SQL can say it, has its SQL twin."""

from importlib import import_module

PARTS = ("ingest", "shapes", "models", "scores", "tables", "live")


def load() -> None:
    """Import every part, which registers its queries."""
    for part in PARTS:
        import_module(f"{__name__}.{part}")
