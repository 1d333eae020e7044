"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from raqim.llm import oracles
from raqim.llm import queries as own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.QUERIES)


def sql() -> dict[str, str]:
    return dict(oracles.SQL)
