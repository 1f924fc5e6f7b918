"""Relational tables: long-form answers, page visits, contact messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str, key: str, low: int, high: int, parts: int,
                 fetch: int = 10_000) -> dict[str, str]:
    """Options of a read split into ``parts`` key ranges, one query per task."""
    if parts < 1 or high < low:
        raise ValueError("key range must not be empty")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(parts),
        "fetchsize": str(fetch),
    }


def read_table(spark: SparkSession, **options) -> DataFrame:
    """JDBC scan; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()
