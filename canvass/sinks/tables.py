"""Result tables as Parquet folders.

Tables that streams write have a small list of their parts, ``_parts.json``, which is replaced as a
whole after a part is complete.  Readers open the listed parts only, so a part that was left
half-written is never seen, and nothing has to be looked for in the folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canvass.sinks import files

LIST = "_parts.json"
#: So many parts of about one size are folded into one.
FOLD = 8

Fold = Callable[[DataFrame], DataFrame]


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Write one folder per value of ``by``.

    The rebalance hint gathers each value's rows into few files, and AQE splits a value
    that holds much of the data over several tasks.  ``replace`` overwrites the values that
    occur in ``df`` and leaves the others.
    """
    mode, policy = ("overwrite", "dynamic") if mode == "replace" else (mode, "static")
    df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", policy).partitionBy(*by).parquet(path)


def _listed(spark: SparkSession, path: str, kind: str) -> dict:
    """The parts of a table; a folder that something else writes is refused."""
    text = files.read_text(spark, f"{path}/{LIST}")
    if text is None:
        if files.exists(spark, path) and files.folders(spark, path) != ["data"]:  # a first part that failed leaves data alone
            raise ValueError(f"{path} was written by something else")
        return {"kind": kind, "parts": []}
    found = json.loads(text)
    if found["kind"] != kind:
        raise ValueError(f"{path} holds {found['kind']}, not {kind}")
    return found


def _add(df: DataFrame, path: str, by: list[str] | None, arrange: Fold | None = None) -> str:
    """A new part; day folders, where wanted, lie inside it."""
    folder = f"data/{uuid.uuid4().hex}"
    if arrange:
        arrange(df).write.partitionBy(*(by or [])).parquet(f"{path}/{folder}")
    elif by:
        write_partitioned(df, f"{path}/{folder}", by, "overwrite")
    else:
        overwrite(df, f"{path}/{folder}")
    return folder


def _save(spark: SparkSession, path: str, found: dict) -> None:
    files.replace_text(spark, f"{path}/{LIST}", json.dumps(found))


def _read(spark: SparkSession, path: str, found: dict, parts: list[dict]) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    if not parts:
        return spark.createDataFrame([], schema)
    # a reader takes day folders of one root only; the parts are few
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{path}/{p['folder']}") for p in parts])


def write_batch(df: DataFrame, path: str, batch_id: int, by: list[str] | None = None, fold: Fold | None = None,
                arrange: Fold | None = None) -> None:
    """Append what one micro-batch gave; a repeated batch replaces its earlier output.

    Closed batches are folded into larger parts, ``FOLD`` of one size at a time, so the number
    of parts grows with the logarithm of the number of batches.  ``fold`` merges their rows, as
    ``latest_per_key`` does for an updating query; without it they are kept as they are.
    ``arrange`` orders a part's rows for its files.  Parts that no list names any more stay until
    the next ones go, so a reader that opened the list before can finish.
    """
    spark = df.sparkSession
    found = _listed(spark, path, "batches")
    older = [p for p in found["parts"] if p["last"] < batch_id]
    if any(p["last"] >= batch_id and p["first"] < p["last"] for p in found["parts"]):
        raise ValueError(f"batch {batch_id} of {path} was folded already; a new checkpoint needs a new folder")
    gone = [p for p in found["parts"] if p["last"] >= batch_id]
    df = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    part = {"first": batch_id, "last": batch_id, "size": 0, "folder": _add(df, path, by, arrange)}
    found |= {"schema": df.schema.jsonValue(), "by": by, "parts": [*older, part]}
    _save(spark, path, found)
    while (group := _foldable(found["parts"])):
        merged = _read(spark, path, found, group)
        whole = {"first": group[0]["first"], "last": group[-1]["last"], "size": group[0]["size"] + 1,
                 "folder": _add(fold(merged) if fold else merged, path, by, arrange)}
        found["parts"] = sorted([p for p in found["parts"] if p not in group] + [whole], key=lambda p: p["first"])
        _save(spark, path, found)
        gone += group
    if gone:
        retired = found.get("retired", [])
        _save(spark, path, found | {"retired": [p["folder"] for p in gone]})
        for folder in retired:
            files.remove(spark, f"{path}/{folder}")


def _foldable(parts: list[dict]) -> list[dict]:
    """Neighbouring parts of one size; the newest batch may be repeated and stays apart."""
    for size in sorted({p["size"] for p in parts}):
        group = [p for p in parts[:-1] if p["size"] == size]
        if len(group) >= FOLD:
            return group
    return []


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches, with their number in ``batch_id``."""
    found = _listed(spark, path, "batches")
    if "schema" not in found:
        raise ValueError(f"nothing was written to {path} yet")
    return _read(spark, path, found, found["parts"])


def write_snapshot(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace the whole result; readers see the old one until the new one is complete."""
    spark = df.sparkSession
    found = _listed(spark, path, "snapshot")
    old, part = found["parts"], {"batch_id": batch_id, "folder": _add(df, path, None)}
    # the version of the batch before stays, for readers that opened it and in case this batch is repeated
    again = [p for p in old if p["batch_id"] >= batch_id]
    old = [p for p in old if p["batch_id"] < batch_id]
    _save(spark, path, found | {"schema": df.schema.jsonValue(), "parts": [part, *old[:1]]})
    for p in [*old[1:], *again]:
        files.remove(spark, f"{path}/{p['folder']}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result."""
    found = _listed(spark, path, "snapshot")
    return _read(spark, path, found, found["parts"][:1])


def read_snapshot_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The newest result of the batches before this one, None if there is none; a repeated batch reads what it read at first."""
    found = _listed(spark, path, "snapshot")
    parts = [p for p in found["parts"] if p["batch_id"] < batch_id]
    return _read(spark, path, found, parts[:1]) if parts else None


Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def write_tables(spark: SparkSession, path: str, *steps: Step) -> None:
    """Replace several tables in one commit: readers see all of the old ones until all new ones are complete.

    Each step gets the tables that the steps before it have stored, and gives further ones.  The
    generation before stays for readers that opened it.
    """
    found = _listed(spark, path, "tables")
    old, folder, done, schemas = found["parts"], f"data/{uuid.uuid4().hex}", {}, {}
    for step in steps:
        for name, df in step(dict(done)).items():
            overwrite(df, f"{path}/{folder}/{name}")
            schemas[name] = df.schema.jsonValue()
            done[name] = spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}")
    _save(spark, path, found | {"parts": [{"folder": folder, "schemas": schemas}, *old[:1]]})
    for p in old[1:]:
        files.remove(spark, f"{path}/{p['folder']}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest complete generation, all of that one."""
    parts = _listed(spark, path, "tables")["parts"]
    if not parts:
        raise ValueError(f"nothing was written to {path} yet")
    return {name: spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/{parts[0]['folder']}/{name}")
            for name, schema in parts[0]["schemas"].items()}


def latest_per_key(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The newest state of each key among the outputs of an updating query."""
    return latest_rows(batches, keys).drop("batch_id")


def latest_rows(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The same with the number of the batch, for folding."""
    values = [c for c in batches.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return batches.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
