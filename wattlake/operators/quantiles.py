"""Exact order statistics without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 256


def order_statistics(df: DataFrame, groups: list[str], value: str, positions: dict[str, str]) -> DataFrame:
    """Values at given 0-based positions of each group's sorted values.

    ``positions`` maps an output name to an SQL expression over ``n`` (the group size). Values are first reduced to
    (group, value, count). Approximate percentiles of the distinct values cut each group into many ranges; counts
    per range tell which range holds a position, and only rows of those ranges are ranked. The result is exact: the
    approximation only decides where the cuts lie.
    """
    anchor = F.lit(0).alias("_g")
    base = df.filter(F.col(value).isNotNull()).select(*groups, anchor, F.col(value).cast("double").alias("_v"))
    keys = [*groups, "_g"]
    distinct = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = distinct.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_v", shares, 1000)).alias("_edges"), F.sum("_c").alias("n")
    )
    wanted = edges.select(
        *keys, F.explode(F.map_from_arrays(
            F.array(*[F.lit(k) for k in positions]), F.array(*[F.expr(e).cast("long") for e in positions.values()])
        )).alias("_name", "_pos"),
    )
    bucketed = distinct.join(edges.drop("n"), keys).withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    ).drop("_edges")
    # At most BUCKETS rows per group.
    counts = bucketed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_m"))
    start = F.coalesce(
        F.sum("_m").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    ranges = counts.withColumn("_start", start)
    targets = wanted.join(ranges, keys).filter(
        (F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_start") + F.col("_m"))
    ).select(*keys, "_name", "_pos", "_b", "_start")
    local = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = bucketed.join(targets.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").withColumn(
        "_upto", F.sum("_c").over(local)
    )
    hits = ranked.join(targets, [*keys, "_b"]).filter(
        (F.col("_pos") >= F.col("_start") + F.col("_upto") - F.col("_c")) & (F.col("_pos") < F.col("_start") + F.col("_upto"))
    )
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in positions]
    ).drop("_g")


def lower_percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentile at index ``int(p * (n - 1))`` of the sorted values."""
    return order_statistics(df, groups, value, {k: f"floor({p} * (n - 1))" for k, p in shares.items()})


def linear_percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentile interpolated linearly between the two neighbouring order statistics."""
    positions = {}
    for k, p in shares.items():
        positions[f"{k}_lo"] = f"floor({p} * (n - 1))"
        positions[f"{k}_hi"] = f"ceil({p} * (n - 1))"
    stats = order_statistics(df, groups, value, positions)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    joined = stats.join(sizes, groups) if groups else stats.withColumn("_n", sizes.select("_n").scalar())
    out = {}
    for k, p in shares.items():
        at = F.lit(p) * (F.col("_n") - 1)
        out[k] = F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (at - F.floor(at))
    return joined.withColumns(out).select(*groups, *shares)
