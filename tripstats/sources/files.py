"""File sources: monthly trip files and the zone CSV."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstats import config as C
from tripstats.operators.reshape import union_all
from tripstats.sinks.files import names

MONTH_FILE_TEMPLATE = "yellow_tripdata_{year:04d}-{month:02d}.parquet"

#: A month file: its year and month.
Month = tuple[int, int]


def month_path(folder: str, month: Month, template: str = MONTH_FILE_TEMPLATE) -> str:
    return f"{folder.rstrip('/')}/{template.format(year=month[0], month=month[1])}"


def as_months(months: Iterable[int | Month] | None, year: int = C.REPORT_YEAR) -> list[Month] | None:
    """Months as (year, month); a bare month is one of ``year``."""
    return None if months is None else sorted({(year, m) if isinstance(m, int) else (m[0], m[1]) for m in months})


def month_files(spark: SparkSession, folder: str, template: str = MONTH_FILE_TEMPLATE) -> dict[Month, str]:
    """Every month file that ``folder`` holds, found by listing it, in order."""
    pattern = re.escape(template).replace(r"\{year:04d\}", r"(?P<year>\d{4})").replace(r"\{month:02d\}", r"(?P<month>\d{2})")
    found = {}
    for name in names(spark, folder):
        if m := re.fullmatch(pattern, name):
            found[int(m["year"]), int(m["month"])] = f"{folder.rstrip('/')}/{name}"
    return dict(sorted(found.items()))


def scan_monthly_trips(spark: SparkSession, folder: str, months: Iterable[int | Month] | None = None,
                       template: str = MONTH_FILE_TEMPLATE,
                       clean: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All monthly files of ``folder`` (or those of ``months``) as ONE plan: a
    union of per-file scans, each tagged with its file's ``src_year`` and
    ``src_month`` as literals.

    The files are found by listing, so a new month is read without being
    named; a month that is asked for and not there is an error.  The union
    runs as one job with the splits of every file in parallel; column
    pruning and filter pushdown reach each scan; and files whose schemas
    drift between months union by name, with NULL for a missing column.
    ``clean`` is applied to each file before the union, so that a rule on
    NULLs sees the file's own columns and not those it lacks.
    """
    found, wanted = month_files(spark, folder, template), as_months(months)
    missing = [month_path(folder, m, template) for m in wanted or [] if m not in found]
    if missing or not found:
        raise FileNotFoundError(", ".join(missing) or f"no month file in {folder}")
    frames = [spark.read.parquet(found[m]).withColumns({"src_year": F.lit(m[0]), "src_month": F.lit(m[1])})
              for m in wanted or found]
    frames = [clean(f) for f in frames] if clean else frames
    return union_all(frames, allow_missing=True)


def read_zone_csv(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV with header, read as text (no inference pass over the
    data); LocationID is cast to INT."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumn("LocationID", F.col("LocationID").cast("int"))
