"""Lists by pages: a sorted layout, pushed-down conditions and a cursor instead of an offset."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_layout(df: DataFrame, score: str, key: str, *kept: str) -> DataFrame:
    """Rows range-sorted by falling score and key, to be written as they are: files and row groups then hold narrow ranges of the score,
    which a reader rules out by their minima and maxima. Rows without score or key have no place in a list and are left out.
    """
    placed = df.filter(F.col(score).isNotNull() & F.col(key).isNotNull()).select(score, key, *kept)
    return placed.repartitionByRange(F.desc(score), F.asc(key)).sortWithinPartitions(F.desc(score), F.asc(key))


def conditions(equal: dict[str, Any] | None = None, at_least: dict[str, Any] | None = None, at_most: dict[str, Any] | None = None) -> Column:
    """All given conditions; an absent value is no condition. Plain comparisons, which reach the scan."""
    out = F.lit(True)
    for tests, compare in ((equal, Column.__eq__), (at_least, Column.__ge__), (at_most, Column.__le__)):
        for column, value in (tests or {}).items():
            if value is not None:
                out = out & compare(F.col(column), F.lit(value))
    return out


def page(df: DataFrame, score: str, key: str, size: int, where: Column | None = None, after: tuple[Any, Any] | None = None) -> DataFrame:
    """FLT11-13: the next ``size`` rows in the order of falling score and key, after the (score, key) of the last row seen.

    The plain bound on the score prunes the scan of a sorted layout; the exact cursor is checked on what is read. Every task keeps ``size`` rows.
    """
    rows = df if where is None else df.filter(where)
    if after is not None:
        last, name = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter((F.col(score) <= last) & ((F.col(score) < last) | (F.col(key) > name)))
    return rows.orderBy(F.desc(score), F.asc(key)).limit(size)


def pages(df: DataFrame, score: str, key: str, size: int, where: Column | None = None, most: int | None = None) -> Iterator[DataFrame]:
    """One page after the other until none is left or ``most`` are read; of each only the last row's cursor comes to the driver."""
    after, number = None, 0
    while most is None or number < most:
        number += 1
        found = page(df, score, key, size, where, after)
        last = found.orderBy(F.asc(score), F.desc(key)).select(score, key).first()
        if last is None:
            return
        yield found.withColumn("pagina", F.lit(number))
        after = (last[0], last[1])
