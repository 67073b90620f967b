"""The queries over the operators of this library."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import queries as catalogue

MODULES = ("strings", "relational", "searching", "knowledge", "learning", "extraction", "enrichment", "internals")


def load() -> None:
    for m in MODULES:
        import_module(f"harrow.queries.{m}")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    load()
    return catalogue.QUERIES["lb_dict"](spark, d) if "lb_dict" in catalogue.QUERIES else catalogue.QUERIES["str_norm"](spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(catalogue.QUERIES)
