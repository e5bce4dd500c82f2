"""Grouping kernel shared by the views: distinct orders, modal text, shares, top-n and dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_orders(alias: str = "qtd_ordens") -> Column:
    """Distinct order count. With one distinct column Spark first aggregates on (keys, order), so a key holding
    most rows is spread over the shuffle by its orders before the final count."""
    return F.countDistinct("ordem").alias(alias)


def modal(column: str, alias: str | None = None) -> Column:
    """UDF03: most frequent non-blank text, smallest on ties, blank when there is none."""
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    return F.coalesce(F.mode(text, True), F.lit("")).alias(alias or column)


def mean_flag(column: str, alias: str) -> Column:
    return F.avg(F.coalesce(F.col(column), F.lit(False)).cast("double")).alias(alias)


def sum_flag(column: str, alias: str) -> Column:
    return F.sum(F.coalesce(F.col(column), F.lit(False)).cast("long")).alias(alias)


def blank_to_null(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def scalar_of(df: DataFrame, expression: Column) -> Column:
    """One aggregated value of ``df`` as a scalar subquery: no cross join, no value through the driver."""
    return df.agg(expression.alias("_value")).select("_value").scalar()


def with_share(counts: DataFrame, count: str, total: Column, alias: str = "percentual", scale: float = 1.0) -> DataFrame:
    base = F.greatest(total, F.lit(1))
    return counts.withColumn(alias, F.col(count) * scale / base)


def top_by(df: DataFrame, limit: int, count: str, *keys: str) -> DataFrame:
    """Largest ``count`` first, keys ascending on ties: a TakeOrdered, never a full sort."""
    return df.orderBy(F.desc(count), *[F.asc_nulls_last(k) for k in keys]).limit(limit)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """WIN03/WIN04: first ``limit`` rows per group with their rank.

    The rank filter sits directly on the window, so Spark keeps at most ``limit`` rows of a group per map task
    before the shuffle; a hot group never reaches one task whole.
    """
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= limit)


def share_within(df: DataFrame, group: list[str], count: str, alias: str = "percentual", scale: float = 1.0) -> DataFrame:
    """WIN09: share of the group total, over already aggregated rows."""
    total = F.sum(count).over(W.partitionBy(*group))
    return df.withColumn(alias, F.col(count) * scale / F.greatest(total, F.lit(1)))


def dense_grid(keys: DataFrame, values: Column, alias: str) -> DataFrame:
    """JN16: every key combined with every value of a bounded array."""
    return keys.select("*", F.explode(values).alias(alias))


def ordinal(column: str, order: tuple[str, ...]) -> Column:
    """SRT03: position in a fixed category order."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))


def title_words(column: Column) -> Column:
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))
