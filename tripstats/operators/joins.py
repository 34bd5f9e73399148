"""Joins against dimension tables, broadcast only behind a size check."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats import config as C


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows: a count per partition, summed (for Parquet, of footers)."""
    return df.count() <= max_rows


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_rows: int = C.BROADCAST_MAX_ROWS, small: bool | None = None) -> DataFrame:
    """Join ``fact`` with ``dim``; broadcast ``dim`` only if it is proven small.

    Callers pass ``dim`` projected to the columns the join needs (a key and
    one or two values), so the row bound is also a byte bound: at the
    default 2 million rows, tens of MB.  ``small`` passes a verdict already
    obtained from ``has_at_most``.
    Beyond the bound the join is left to Catalyst/AQE (shuffle join, with
    AQE's skew-split for hot keys on the fact side).
    """
    if small is None:
        small = has_at_most(dim, max_rows)
    return fact.join(F.broadcast(dim) if small else dim, on, how)


def zone_names(zones: DataFrame, key: str, name: str) -> DataFrame:
    """The zone lookup under another role name: ``(key, name)``.

    The lookup is keyed on an integer LocationID (a CSV gives text; it is
    cast here, as the ``::integer`` in the reference join).  Like any lookup
    it is expected to hold one row per LocationID.
    """
    return zones.select(F.col("LocationID").cast("int").alias(key), F.col("Zone").alias(name))


def with_zone_names(df: DataFrame, zones: DataFrame, pu: str = C.PU, do: str = C.DO,
                    pu_name: str = "pickup_zone", do_name: str = "drop_zone",
                    max_rows: int = C.BROADCAST_MAX_ROWS) -> DataFrame:
    """LEFT join the same zone lookup twice (pickup and drop-off roles).

    Unknown locations keep their rows with a NULL zone name.
    """
    small = has_at_most(zones, max_rows)     # one check for both roles
    out = join_dimension(df, zone_names(zones, pu, pu_name), pu, "left", small=small)
    return join_dimension(out, zone_names(zones, do, do_name), do, "left", small=small)
