"""Query catalog: one entry per survey operator, bound to the test tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> DuckDB SQL``
(same column names, DOUBLEs rounded to 6 places on both sides).  Modules
register themselves with ``@query(name, sql)``; see ``catalog_*.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import finalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, round_doubles: bool = True):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.codegen.maxFields", "2000")
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # see session
            df = fn(spark, sf_dir)
            return finalize(df) if round_doubles else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module (each registers its queries on import)."""
    from . import (catalog_lexical, catalog_metrics, catalog_ml, catalog_models, catalog_pipeline,  # noqa: F401
                   catalog_profile, catalog_records, catalog_sets, catalog_sources, catalog_verdicts)
