"""Registry of queries: a Spark callable per key and, where SQL can say it, the equivalent check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitefit.session import joins_by_measured_size
from sitefit.sources.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SECTION_OF: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            joins_by_measured_size(spark)
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        SECTION_OF[name] = fn.__module__.rsplit(".", 1)[-1]
        if check is not None:
            ORACLES[name] = check
        return fn
    return register
