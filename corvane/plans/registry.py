"""All queries of the engine with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import bound, composed, library
from corvane.plans.catalog import CATALOG
from corvane.plans.dialect import DUCK, SPARK
from corvane.sources.tables import register, with_relations


def _query(sql) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(sql(SPARK))

    return run


QUERIES = {name: _query(sql) for name, sql in CATALOG.items()} | composed.QUERIES | library.QUERIES | bound.QUERIES
ORACLE_SQL = {name: with_relations(sql(DUCK)) for name, sql in CATALOG.items()} | {name: with_relations(sql) for name, sql in (composed.ORACLE_SQL | library.ORACLE_SQL | bound.ORACLE_SQL).items()}
