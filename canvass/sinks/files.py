"""Small files of a table folder, through the file system that Spark uses for the path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return hadoop, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None if there is none."""
    _, place, system = _located(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside the old one and put it in its place.

    Readers see the old or the new text where the file system renames at once, as HDFS and local
    ones do; object stores don't, so there such a file belongs on a file system of the first kind.
    """
    hadoop, place, system = _located(spark, path)
    fresh = hadoop.Path(path + ".new")
    stream = system.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(fresh, place, overwrite)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path."""
    _, place, system = _located(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()) if system.exists(place) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of the last change) of the data files right below a path."""
    _, place, system = _located(spark, path)
    found = ((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(place) if s.isFile())
    return sorted(f for f in found if not f[0].startswith(("_", ".")))


def exists(spark: SparkSession, path: str) -> bool:
    _, place, system = _located(spark, path)
    return system.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    _, place, system = _located(spark, path)
    system.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    _, place, system = _located(spark, path)
    system.delete(place, True)
