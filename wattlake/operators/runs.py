"""Ordered per-entity computations that survive a hot entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_lengths(
    df: DataFrame, key: str, order: list[Column], flag: Column, slice_by: Column, alias: str = "run_length"
) -> DataFrame:
    """WIN12: number of consecutive true flags up to each row of a key (0 on a false row).

    Rows of a key are cut into ordered slices (``slice_by`` must not decrease along ``order``), so the inner window
    partitions are (key, slice). One summary row per slice then carries the open run across slices: a slice passes on
    its trailing run, plus what it received when it is true throughout. A hot key is spread over its slices.
    """
    inner = W.partitionBy(key, "_slice").orderBy(*order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        df.withColumn("_slice", slice_by)
        .withColumn("_flag", flag.cast("int"))
        .withColumn("_rn", F.row_number().over(inner))
        # Position of the last false row so far; the local run is the distance to it.
        .withColumn("_last0", F.coalesce(F.max(F.when(F.col("_flag") == 0, F.col("_rn"))).over(upto), F.lit(0)))
        .withColumn("_local", F.col("_rn") - F.col("_last0"))
    )
    slices = ranked.groupBy(key, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        (F.count(F.lit(1)) - F.coalesce(F.max(F.when(F.col("_flag") == 0, F.col("_rn"))), F.lit(0))).alias("_tail"),
    )
    by_slice = W.partitionBy(key).orderBy("_slice")
    before = by_slice.rowsBetween(W.unboundedPreceding, -1)
    # Inside a block of full slices the carried run is the tail of the slice before the block plus the full sizes.
    broken = F.col("_tail") < F.col("_n")
    summed = (
        slices.withColumn("_block", F.coalesce(F.sum(broken.cast("int")).over(before), F.lit(0)))
        .withColumn("_sum", F.sum("_tail").over(W.partitionBy(key, "_block").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_opening", F.max(F.when(broken, F.struct("_slice", "_tail"))).over(before)["_tail"])
        .select(key, "_slice", (F.coalesce("_sum", F.lit(0)) + F.coalesce("_opening", F.lit(0))).alias("_carry"))
    )
    total = F.col("_local") + F.when(F.col("_last0") == 0, F.col("_carry")).otherwise(0)
    return (
        ranked.join(summed, [key, "_slice"])
        .withColumn(alias, F.when(F.col("_flag") == 1, total).otherwise(0).cast("long"))
        .drop("_slice", "_flag", "_rn", "_last0", "_local", "_carry")
    )


def neighbours(
    df: DataFrame, keys: list[str], order: str, slice_by: Column, before: dict[str, str] | None = None, after: dict[str, str] | None = None
) -> DataFrame:
    """WIN/SNK17: values of the row before (``before``: name to column) and after (``after``) each row of a key, NULL at the ends.

    ``order`` is unique in a key. As for runs, rows are cut into ordered slices (``slice_by`` must not decrease along ``order``): the inner
    windows are (key, slice), and the first and last row of each slice, one row, carry the values across. A hot key is spread over its slices.
    """
    before, after = before or {}, after or {}
    inner = W.partitionBy(*keys, "_slice").orderBy(order)
    by_slice = W.partitionBy(*keys).orderBy("_slice")
    cut = df.withColumn("_slice", slice_by)
    edges = cut.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in before.items()], F.lit(0).alias("_")), order).alias("_last"),
        F.min_by(F.struct(*[F.col(c).alias(n) for n, c in after.items()], F.lit(0).alias("_")), order).alias("_first"),
    )
    carried = edges.select(*keys, "_slice", F.lag("_last").over(by_slice).alias("_left"), F.lead("_first").over(by_slice).alias("_right"))
    placed = cut.withColumns(
        {"_start": F.row_number().over(inner) == 1, "_stop": F.lead(F.lit(1)).over(inner).isNull()}
        | {n: F.lag(c).over(inner) for n, c in before.items()} | {n: F.lead(c).over(inner) for n, c in after.items()}
    )
    same = F.col("l._slice") == F.col("r._slice")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = placed.alias("l").join(carried.alias("r"), same)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[F.when(F.col("l._start"), F.col(f"r._left.{n}")).otherwise(F.col(f"l.{n}")).alias(n) for n in before],
        *[F.when(F.col("l._stop"), F.col(f"r._right.{n}")).otherwise(F.col(f"l.{n}")).alias(n) for n in after],
    )
