"""S13 + Q-SQL: the tables readable by name, free SQL over them, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """One temp view per table (``sessions``, ``messages``, …)."""
    names = []
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Q-SQL: register the tables, then plan ``sql`` with Catalyst (lazy)."""
    register_views(tables)
    return spark.sql(sql)
