"""Helpers of this subpackage: written intermediate tables and batch sizes."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import work_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes handed to Python at once; documents may be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20
#: Rows of a file of a table of few columns whose size is known.
FILE_ROWS = 1 << 16


@contextmanager
def settings(spark: SparkSession, **values):
    """Hold settings of the session for a while."""
    values = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once, and bound what a Python worker holds at once.

    The batch size stays set, as the frame that an operator returns runs later.
    """
    spark.conf.set(ROWS, str(BATCH_ROWS))
    spark.conf.set(BYTES, str(BATCH_BYTES))
    context = spark.sparkContext
    if not any(f.startswith("canvass-package") for f in map(os.path.basename, context._python_includes)):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(), "canvass-package")
        context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))


def fitted(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """A frame of at most ``rows`` rows in tasks of about ``each``, where the shuffle before it has more."""
    return df.coalesce(max(1, -(-rows // each)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The lineage ends here, so a lost executor costs no more than the step that was running, and
    the step's shuffle files are given back at once.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    with settings(spark, **{CLEANUP.replace(".", "__"): "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_text(docs: DataFrame, make: Callable[[], Callable[[list], list]], kind: pa.DataType, sql: str) -> DataFrame:
    """(row, value): each whole row of ``docs`` and what a function finds for its text.

    ``make`` is called once per task and returns the function from texts to values.  The rows
    travel as one column, so their names clash with nothing.
    """
    prepare(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("row"), "text")

    def run(batches):
        values = make()
        for batch in batches:
            found = pa.array(values(batch.column("text").to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "value"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, value {sql}")
