"""Table sinks: month-partitioned parquet, sorted tables, JDBC, Kafka."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tripstats.operators.states import month_keys


def write_month_partitions(df: DataFrame, path: str, sort_by: Sequence[str] = (), whole: bool = False) -> None:
    """Write ``df`` partitioned by month file (year and month, where it has both).

    With ``whole`` the table is replaced, so months that ``df`` lacks are
    gone afterwards (a full load); otherwise only the months present are
    replaced, and a rerun of a month does not append a second copy.
    """
    # The partitioned writer needs rows grouped by month; leading with the
    # month columns keeps ``sort_by`` order inside each file (min/max pruning).
    keys = month_keys(df)
    out = df.sortWithinPartitions(*keys, *sort_by) if sort_by else df
    (out.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic")
     .partitionBy(*keys).parquet(path))


def write_sorted(df: DataFrame, path: str, sort_by: Sequence[str], ranges: int | None = None) -> None:
    """A table stored in key order: each file holds a range of ``sort_by`` of
    its own, sorted, so the statistics of a file let a read of a key or range
    skip all others.  ``ranges`` fixes the number of files; by default it
    follows the size of the table."""
    out = df.repartitionByRange(ranges, *sort_by) if ranges else df.repartitionByRange(*sort_by)
    out.sortWithinPartitions(*sort_by).write.mode("overwrite").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict, mode: str = "overwrite",
               batch_size: int = 10_000) -> None:
    """JDBC table write (each task writes its partition over its own connection)."""
    df.write.option("batchsize", batch_size).jdbc(url=url, table=table, mode=mode, properties=properties)


def kafka_write_options(bootstrap_servers: str, topic: str | None = None) -> dict[str, str]:
    """Options of Spark's Kafka sink; without ``topic`` each row's ``topic`` column is used."""
    return {"kafka.bootstrap.servers": bootstrap_servers, **({"topic": topic} if topic else {})}


def write_kafka(messages: DataFrame, bootstrap_servers: str, topic: str | None = None) -> None:
    """Produce ``(key, value)`` rows to Kafka (needs the spark-sql-kafka connector)."""
    rows = messages.select(*[c for c in ("topic", "key", "value") if c in messages.columns])
    rows.write.format("kafka").options(**kafka_write_options(bootstrap_servers, topic)).save()
