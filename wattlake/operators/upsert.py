"""Upserts and history over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.operators.dedup import latest_wins
from wattlake.operators.runs import neighbours


def changed_since(source: DataFrame, target: DataFrame, processed: str, loaded: str) -> DataFrame:
    """Rows of the source processed after the newest load of the target; every row for an empty target."""
    newest = target.agg(F.max(loaded).alias("m")).select("m").scalar()
    return source.filter(F.col(processed) > F.coalesce(newest, F.lit("1900-01-01").cast("timestamp")))


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """SNK06/TXT14: target rows without a newer version plus all source rows."""
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def merge_latest(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK12: concatenation with the newer batch winning per key."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest_wins(both, keys, [F.col("_batch")]).drop("_batch")


def history(versions: DataFrame, keys: list[str], valid_from: str, tracked: list[str]) -> DataFrame:
    """SNK17: type-2 history. Only changes of the tracked columns open a new version.

    Versions of the same key and time collapse first. The row before and the change after are found over years of a key, so that a
    key with most of the versions is not one window.
    """
    stamp = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tracked]), 256)
    rows = latest_wins(versions.select(*keys, valid_from, *tracked), [*keys, valid_from], [F.lit(0)]).withColumn("_h", stamp)
    years = F.year(valid_from)
    changed = neighbours(rows, keys, valid_from, years, before={"_prev": "_h"}).filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("_h")))
    closed = neighbours(changed.select(*keys, *tracked, F.col(valid_from).alias("valid_from")), keys, "valid_from", F.year("valid_from"), after={"valid_to": "valid_from"})
    return closed.withColumn("is_current", F.col("valid_to").isNull())


def insert_only(target: DataFrame, source: DataFrame, period: str) -> DataFrame:
    """SNK18: rows of periods the target does not have yet; closed periods stay as they are."""
    return source.join(target.select(period).distinct(), period, "left_anti")
