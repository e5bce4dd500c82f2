"""Shared helpers: the shared folder, written intermediates, two-level prefix sums and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattlake.runtime import released

# The white space of every text contract, and a word between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers find this package where the driver does, if they have not installed it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where a local session leaves it unset is one made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wattlake-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost executor costs a re-read.

    The shuffle files behind it go when it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with released(spark):
        (df.repartition(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote and that no frame still to be read depends on."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed(*columns: str | Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, str], name: str) -> DataFrame:
    """Add to every row, for each ``out: column`` of ``values``, the sum over the rows of its group that come earlier in ``order``.

    Rows are cut into ranges of (group, order) and written; sums inside a range need no other range, and the totals
    of (range, group) are one row each. So a group that holds most rows is spread over many tasks. ``order`` must be unique in
    its group, or rows with equal keys are ordered freely.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_range", F.spark_partition_id())
    ranged = saved(ranged, f"{name}-ranges")
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0)
    # One row per range and group: as many as ranges and groups together, never as many as rows.
    totals = ranged.groupBy("_range", *group).agg(*[F.sum(column).alias(out) for out, column in values.items()])
    totals = totals.select("_range", *group, *[F.coalesce(F.sum(out).over(earlier), nothing).alias(out) for out in values])
    local = ranged.withColumns({f"_in_{out}": F.coalesce(F.sum(column).over(inside), nothing) for out, column in values.items()})
    same = F.col("l._range") == F.col("r._range")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = local.alias("l").join(totals.alias("r"), same)
    sums = [(F.col(f"l._in_{out}") + F.col(f"r.{out}")).alias(out) for out in values]
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *sums)


def meetings(rows: DataFrame, group: str, chunks: Column) -> DataFrame:
    """Rows with the number ``chunks`` of their group, dealt so that every two rows of a group meet in one (group, a, b).

    A row is in the chunk ``mine`` of its group and goes to the meetings of that chunk with itself and with each other one. A group of one
    chunk is one meeting; a larger one is spread over several, and none holds more than two chunks.
    """
    dealt = rows.withColumn("_chunks", chunks.cast("int")).withColumn("mine", F.pmod(hashed("id", seed=3), F.col("_chunks")).cast("int"))
    pair = lambda k: F.struct(F.least("mine", k).alias("a"), F.greatest("mine", k).alias("b"))
    dealt = dealt.withColumn("_m", F.explode(F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), pair)))
    dealt = dealt.withColumns({"a": F.col("_m.a"), "b": F.col("_m.b")}).drop("_m", "_chunks")
    return dealt.repartition(group, "a", "b").sortWithinPartitions(group, "a", "b", "id")


def each_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come sorted by ``keys``, whole, whatever the batches."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        new = np.zeros(len(batch) - 1, bool)
        for k in keys:
            values = batch[k].to_numpy()
            new |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for start, end in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield batch.iloc[start:end]
        held = batch.iloc[cuts[-2] :]
    if held is not None and len(held):
        yield held


class Forest:
    """Union-find over positions; ``tie`` says whether it joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, v: int) -> int:
        while (up := self.parent[v]) != v:
            self.parent[v] = v = self.parent[up]
        return v

    def tie(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def labels(self) -> np.ndarray:
        return np.fromiter(map(self.root, range(len(self.parent))), np.int64, len(self.parent))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Smallest id reachable for every id that has an edge to another: columns ``node``, ``component``.

    Alternating large and small stars: each round rewires edges to the smallest neighbour until every node points at its
    component's smallest id. A hub costs map-side minima and joins that adaptive execution splits. Rounds write a table, which goes when
    the next one stands.
    The driver sees two numbers per round.
    """
    high, low = F.greatest(a, b).cast("long"), F.least(a, b).cast("long")
    stars = edges.filter(F.col(a) != F.col(b)).select(high.alias("node"), low.alias("to")).distinct()
    stars = saved(stars, f"{name}-0")
    state, turn = _fingerprint(stars), 0
    while True:
        turn += 1
        both = stars.union(stars.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").filter(F.col("to") > F.col("node")).select(F.col("to").alias("node"), F.col("m").alias("to"))
        large = saved(large.filter("node != to").distinct(), f"{name}-{turn}-large")
        dropped(stars)
        least = large.groupBy("node").agg(F.min("to").alias("m"))
        small = large.join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).filter("node != to")
        new = saved(small.union(least.select("node", F.col("m").alias("to"))).distinct(), f"{name}-{turn}")
        dropped(large)
        reached = _fingerprint(new)
        stars = new
        if reached == state:
            roots = stars.select("to").distinct().select(F.col("to").alias("node"), F.col("to").alias("component"))
            return stars.select("node", F.col("to").alias("component")).union(roots)
        state = reached


def _fingerprint(edges: DataFrame) -> tuple:
    """Order-free digest of an edge table."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "to")), F.sum(F.xxhash64("to", "node").cast("decimal(38,0)"))).first()
    return tuple(row)
