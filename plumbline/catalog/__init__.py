"""Registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("prices", "factors", "tables", "portfolio", "text", "models", "quality")


def load():
    for section in SECTIONS:
        import_module(f"plumbline.catalog.{section}")
    twin = import_module("plumbline.catalog.twin")
    return dict(twin.QUERIES), dict(twin.TWINS)
