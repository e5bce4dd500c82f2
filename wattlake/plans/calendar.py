"""SRC27/G08: calendar with holidays and business days per state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values: (month, day) of national and state holidays.
NATIONAL_HOLIDAYS = ((1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25))
STATE_HOLIDAYS = {"SP": ((1, 25),), "RJ": ((4, 23),), "CE": ((3, 19),), "GO": ((10, 24),)}
STATES = ("SP", "RJ", "CE", "GO")


def _codes(days) -> Column:
    return (F.month("data") * 100 + F.dayofmonth("data")).isin(*[m * 100 + d for m, d in days])


def days(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day between two dates of a one-row frame."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("data"))


def with_states(dates: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Calendar attributes per (day, state); the key of the table is the pair, so facts join on both."""
    rows = dates.withColumn("uf", F.explode(F.array(*[F.lit(s) for s in states])))
    local = F.lit(False)
    for state in states:
        local = F.when(F.col("uf") == state, _codes(STATE_HOLIDAYS[state])).otherwise(local)
    return (
        rows.withColumns(
            {
                "dia_semana": F.weekday("data"),
                "dia_mes": F.dayofmonth("data"),
                "mes": F.month("data"),
                "trimestre": F.quarter("data"),
                "ano": F.year("data"),
                "flag_feriado_nacional": _codes(NATIONAL_HOLIDAYS),
                "flag_feriado_uf": local,
                "ano_mes": F.date_format("data", "yyyy-MM"),
            }
        )
        .withColumn(
            "flag_dia_util",
            (F.col("dia_semana") < 5) & ~F.col("flag_feriado_nacional") & ~F.col("flag_feriado_uf"),
        )
        .withColumn("sk_tempo", F.md5(F.concat_ws("-", F.col("data").cast("string"), "uf")))
    )


def with_running_business_days(calendar: DataFrame) -> DataFrame:
    """Running count of business days per state; a calendar is a few thousand rows per state."""
    w = W.partitionBy("uf").orderBy("data").rowsBetween(W.unboundedPreceding, 0)
    return calendar.withColumn("dias_uteis_acumulados", F.sum(F.col("flag_dia_util").cast("int")).over(w))
