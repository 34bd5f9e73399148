"""Set operations and reshaping."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_all(frames: Sequence[DataFrame], columns: Sequence[str] | None = None,
              allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name (e.g. of per-month tables), optionally
    projecting each input to ``columns`` first so only those are scanned.
    ``allow_missing`` fills a column absent from some inputs with NULL."""
    if not frames:
        raise ValueError("union_all needs at least one DataFrame")
    parts = [f.select(*columns) if columns else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), parts)


def fold(df: DataFrame, ids: Sequence[str], values: Sequence[str],
         name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long: one ``(ids..., name, value)`` row per id row and value column."""
    return df.unpivot(list(ids), list(values), name, value)
