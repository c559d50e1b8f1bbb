"""Registry of queries: name -> (callable, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str, oracle: str | None):
    """Register a function of data frames: it gets the views named in ``views``, in order."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) for v in views.split()))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if oracle is not None:
            SQL[name] = sql(views, oracle)
        return f

    return add
