"""Points inside polygons by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over a closed ring given as an array of (x, y) structs without a repeated last vertex."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crossings = F.zip_with(
        ring, after,
        lambda a, b: F.when(
            ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1
        ).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda acc, c: acc + c) % 2 == 1


def in_areas(points: DataFrame, areas: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """JN22: points that lie in at least one active area.

    Areas are spread over the grid cells of their bounding box, points fall into one cell, and the two meet by an
    equi-join on the cell; only then the exact test runs. Points of one crowded cell are split by AQE because the area
    side of a cell is short.
    """
    index = lambda v: F.floor(v / F.lit(cell)).cast("long")
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cells = (
        areas.filter("ativa").select(
            "ring", F.explode(F.sequence(index(F.array_min(xs)), index(F.array_max(xs)))).alias("_cx"),
            index(F.array_min(ys)).alias("_y0"), index(F.array_max(ys)).alias("_y1"),
        ).select("ring", "_cx", F.explode(F.sequence("_y0", "_y1")).alias("_cy"))
    )
    located = points.withColumns({"_cx": index(F.col(x)), "_cy": index(F.col(y))}).alias("p")
    hit = (F.col("p._cx") == F.col("a._cx")) & (F.col("p._cy") == F.col("a._cy")) & inside(F.col(f"p.{x}"), F.col(f"p.{y}"), F.col("a.ring"))
    return located.join(cells.alias("a"), hit, "left_semi").drop("_cx", "_cy")
