"""JDBC source: a table or a SQL query run by the database."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc_query(spark: SparkSession, url: str, query: str, properties: dict,
                    partition_column: str | None = None, lower: int | None = None,
                    upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Rows of ``query`` executed by the database (an aliased derived table).

    With ``partition_column`` and bounds, Spark issues ``num_partitions``
    range queries in parallel instead of one connection.
    """
    table = f"({query}) AS q"
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties)
