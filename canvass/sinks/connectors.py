"""Writers into external stores, each through the store's own Spark data source.

A writer takes rows and the name of the collection, index or table.  The packages of the
stores must be on the class path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Writer = Callable[[DataFrame, str], None]


def to_collections(uri: str, database: str, mode: str = "append") -> Writer:
    """Document collections."""

    def write(df: DataFrame, name: str) -> None:
        (
            df.write.format("mongodb").mode(mode)
            .option("connection.uri", uri).option("database", database).option("collection", name)
            .save()
        )

    return write


def to_indices(nodes: str, port: int = 9200, mode: str = "append") -> Writer:
    """Search indices."""

    def write(df: DataFrame, name: str) -> None:
        (
            df.write.format("org.elasticsearch.spark.sql").mode(mode)
            .option("es.nodes", nodes).option("es.port", str(port)).option("es.resource", name)
            .save()
        )

    return write


def to_tables(url: str, rows_per_statement: int = 10_000, mode: str = "append") -> Writer:
    """Relational tables."""

    def write(df: DataFrame, name: str) -> None:
        (
            df.write.format("jdbc").mode(mode)
            .option("url", url).option("dbtable", name).option("batchsize", rows_per_statement)
            .save()
        )

    return write
