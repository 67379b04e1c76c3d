from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog_audit.oracle.ctes import with_ctes
from catalog_audit.session import tune
from catalog_audit.sources.estate import Estate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_estates: dict[tuple[str, str], Estate] = {}


def estate(spark: SparkSession, sf_dir: str) -> Estate:
    """One estate per application and folder, so stored stages are shared by queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _estates:
        _estates[key] = Estate(tune(spark), sf_dir)
    return _estates[key]


def fresh() -> None:
    """Forget stored stages (cold timings, tests)."""
    _estates.clear()


def add(name: str, run: Callable[[Estate], DataFrame], sql: str | None = None, extra: dict[str, str] | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(estate(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_ctes(sql, extra)
