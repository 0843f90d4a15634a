"""Imports every catalog module once so that their queries register."""

from importlib import import_module

NAMES = ("desk", "money", "texts", "search", "scoring", "protection", "flows", "tone", "feeds", "checks")


def load() -> None:
    for name in NAMES:
        import_module(f"answerlake.catalog.{name}")
