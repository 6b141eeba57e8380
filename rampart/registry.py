"""Named queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import files, oracles, reports
from .plans import queries as base


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return base.QUERIES | reports.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | reports.ORACLES | files.ORACLES
