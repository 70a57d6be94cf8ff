"""Registry of the named queries and their SQL counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fuelspark.operators.scale import materialize
from fuelspark.plans.sqlviews import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = with_views(sql)
        return function
    return register


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table of entity resolution, written once per application and input and then read by all
    queries that start from it, as the stages of the full run are."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(build(), name)
    return _STAGES[key]
