"""Gathers the query modules of this package: name to callable, name to oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("lexical", "graphs", "knowledge", "editing", "syntax", "access", "formats", "learning", "programs")


def collect() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        m = import_module(f"lexloom.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
