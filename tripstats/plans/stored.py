"""Tables derived from a source folder, written once and read until the source changes.

A derived table lies below ``spark.checkpoint.dir`` in a folder named by the
fingerprint of its source files (path, length, time of change).  While the
source stays as it is, every session that shares the folder reads the table;
when a file is added, replaced or removed, the fingerprint is another one and
the table is built anew.  A table is written aside and renamed, so a build
that was cut off is never read.
"""
from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripstats.session import app_id, scratch_root
from tripstats.sinks import files

#: Changes when the tables' definitions do.
LAYOUT = "1"
#: Files that the driver lists itself.
LISTED = 1000

Build = Callable[[str], None]

_LOCK = threading.RLock()
_SCHEMAS: dict[tuple[str, str], StructType] = {}
_GENERATION = ""


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below ``paths``; their contents are not read, and beyond ``LISTED`` files Spark lists them."""
    if (few := files.statuses(spark, paths, LISTED)) is not None:
        return hashlib.sha256(repr(few).encode()).hexdigest()[:32]
    found = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    one = F.xxhash64("path", "length", "modificationTime")
    two = F.xxhash64(F.lit("second"), "modificationTime", "length", "path")
    r = found.agg(F.count("*"), F.bit_xor(one), F.bit_xor(two)).first()
    return "-".join(f"{(v or 0) & (2 ** 64 - 1):x}" for v in r)


def forget() -> None:
    """Build every table anew from now on (for timings and tests)."""
    global _GENERATION
    with _LOCK:
        _GENERATION = uuid.uuid4().hex[:8]
        _SCHEMAS.clear()


def derived(spark: SparkSession, name: str, sources: list[str], build: Build) -> DataFrame:
    """The table ``name`` of ``sources``; ``build(path)`` writes it where it is not there yet."""
    path = f"{scratch_root(spark)}/tripstats/derived/{LAYOUT}{_GENERATION}-{fingerprint(spark, sources)}/{name}"
    key = (app_id(spark), path)
    with _LOCK:
        if not files.exists(spark, path):
            aside = f"{path}-{uuid.uuid4().hex[:12]}"
            build(aside)
            if not files.move(spark, aside, path):       # another session was first; the tables are equal
                files.delete(spark, aside)
            _SCHEMAS.pop(key, None)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
