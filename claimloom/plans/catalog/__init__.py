"""Registered queries: a name, a DataFrame plan over the star and, where one exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from claimloom.sources.star import ClaimStar


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[ClaimStar], DataFrame]
    sql: str | None = None


MODULES = [
    "sources", "quality", "reports", "clean", "risk", "features", "models", "policy", "adjudicate", "history", "streams",
]


def entries() -> list[Entry]:
    found: list[Entry] = []
    for module in MODULES:
        found += import_module(f"claimloom.plans.catalog.{module}").ENTRIES
    return found


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: entry.run(ClaimStar(spark, sf_dir))
