"""Small file operations on the driver, through Hadoop's own file system classes.

For records of a few bytes and folder listings only (commit records, month
files); tables are read and written by Spark.
"""
from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what ``folder`` holds, sorted; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def statuses(spark: SparkSession, paths: list[str], most: int) -> list[tuple[str, int, int]] | None:
    """Path, length and time of change of the files that ``paths`` are or hold; None if they are more
    than ``most`` or lie in folders of folders."""
    found = []
    for path in paths:
        fs, p = _at(spark, path)
        listed = fs.listStatus(p)
        if len(found) + len(listed) > most or any(s.isDirectory() for s in listed):
            return None
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in listed]
    return sorted(found)


def total_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of all files that ``paths`` are or hold."""
    return sum(fs.getContentSummary(p).getLength() for fs, p in (_at(spark, path) for path in paths))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder; False if ``new`` is there already."""
    fs, p = _at(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    return not fs.exists(target) and fs.rename(p, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small text file; None if it is not there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place of ``path`` in one step: written aside, then renamed over it."""
    jvm, gateway = spark._jvm, spark._sc._gateway
    fs, p = _at(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(path + ".new")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    whole = fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        whole.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(fs.makeQualified(aside), whole, how)
