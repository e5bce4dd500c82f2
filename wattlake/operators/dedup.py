"""Latest-wins deduplication by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(df: DataFrame, keys: list[str], order: list[Column], *, newest: bool = True) -> DataFrame:
    """WIN01/WIN02: one row per key, the one with the greatest (or smallest) order value.

    An aggregation keeps one candidate per key and map task, so a key copied in a third of all rows never travels
    whole. Remaining ties are settled by the row content, which makes the winner the same in every run.
    """
    payload = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(*payload).alias("h"))
    choose = F.max_by if newest else F.min_by
    row = choose(F.struct(*payload), rank).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])
