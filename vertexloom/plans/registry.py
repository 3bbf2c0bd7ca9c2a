"""The registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import star_graph
from .graph import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function from the star graph to a DataFrame, with its SQL if there is one."""

    def keep(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(star_graph(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def cents(value):
    """Sums of doubles in whole hundredths: engines add in different orders."""
    return F.round(F.sum(F.round(value * 100).cast("long")) / 100.0, 2)
