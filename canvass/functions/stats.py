"""Aggregates that need a guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: str, y: str, rows_each: str | None = None) -> Column:
    """Correlation of two whole-number columns, NULL when one is constant or without rows.

    Rows that lack one of the two values are left out of every sum.  ``rows_each`` names the
    number of rows that each row stands for.

    The built-in ``corr`` divides by zero on a constant column in ANSI mode, and a CASE
    around it does not help, as aggregates are computed before it.  The sums of whole
    numbers are exact, so the result does not depend on how the rows are partitioned.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))

    def wide(total: Column) -> Column:
        return total.cast("decimal(19,0)")

    n = F.col(rows_each) if rows_each else F.lit(1).cast("bigint")
    rows = wide(F.sum(F.when(both, n)))

    def spread(p: Column, q: Column) -> Column:
        return (rows * wide(F.sum(n * p * q)) - wide(F.sum(n * p)) * wide(F.sum(n * q))).cast("double")

    return F.try_divide(spread(a, b), F.sqrt(spread(a, a)) * F.sqrt(spread(b, b)))
