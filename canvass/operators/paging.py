"""Nested lists of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.session import work_dir

PAGE_SIZE = 10_000


def ranked(rows: DataFrame, by: list[str], sort: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in the given order, by two levels of counting.

    The rows are sorted into ranges over all tasks; a group's ranges are counted, and a row's
    number is its place in its range after the rows of the ranges before.  So no window spans a
    whole group.  The ranges are written to the work folder, as both levels must see the same.
    """
    spark = rows.sparkSession
    order = [*(F.col(c).asc_nulls_first() for c in by), *sort]
    path = work_dir(spark, "ranges")
    parts = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = parts.groupBy(*by, "_range").agg(F.count("*").alias("n"))
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_same_range"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_range") == F.col("_same_range")
    for c in by:  # the grouping columns can be NULL
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*sort))
    return parts.join(offsets, same).withColumn(name, F.col("_offset") + place).drop(
        "_range", "_same_range", "_offset", *[f"_{c}" for c in by])


def nest_pages(rows: DataFrame, by: list[str], key: str, count: str, sort: list[Column],
               name: str = "items", page_size: int = PAGE_SIZE) -> DataFrame:
    """Nest ``key`` and ``count`` of each group into sorted lists of ``page_size`` items.

    ``rows`` has one row per group and ``key``.  The lists are pages of the whole order: page p
    holds the items ranked from p * page_size + 1 on, and only a group's last page is shorter.
    Without grouping columns all rows are one group.
    """
    numbered = ranked(rows.select(*by, key, count), by, [*sort, F.col(key)])
    page = F.floor((F.col("rank") - 1) / page_size).cast("int").alias("page")
    entry = F.struct("rank", F.struct(key, count).alias("item"))
    return (
        numbered.groupBy(*by, page)
        .agg(F.array_sort(F.collect_list(entry)).alias(name))
        .withColumn(name, F.transform(name, lambda e: e["item"]))
    )
