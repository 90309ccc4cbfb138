"""Registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

MODULES = ("formats", "playlists", "records", "values", "urls", "pages", "embeds", "manifests",
           "subtitles", "streams", "sources")


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``t`` gives the input tables of one data folder."""
    def add(fn):
        from ..fixtures import Tables
        from ..session import configure

        def run(spark, sf_dir):
            return fn(Tables(configure(spark), sf_dir))
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
