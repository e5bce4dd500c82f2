"""Shared folder handling and materialised intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_FOLDERS: dict[str, str] = {}
_TABLES: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the one named in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder of this machine; a cluster
    session without it is an error, because executors could not see a machine-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="wattlake-")
    return _LOCAL_FOLDERS[app]


# Seconds a computed dataset version is trusted before the file listing is read again.
VERSION_TTL = 60.0
_VERSIONS: dict[tuple[str, tuple[str, ...]], tuple[float, str]] = {}


def dataset_version(spark: SparkSession, paths: list[str]) -> str:
    """Version of the input files, re-read from their metadata at most once per ``VERSION_TTL``."""
    key = (spark.sparkContext.applicationId, tuple(paths))
    known = _VERSIONS.get(key)
    if known is None or time.monotonic() - known[0] > VERSION_TTL:
        known = (time.monotonic(), _read_version(spark, paths))
        _VERSIONS[key] = known
    return known[1]


def _read_version(spark: SparkSession, paths: list[str]) -> str:
    """sha256 over path, size and modification time of the input files (file metadata only, no content read)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(paths)
        .select("path", "length", F.col("modificationTime").cast("string").alias("mtime"))
    )
    per_file = files.select(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), "mtime"), 256).alias("h"))
    # The xor and sum of the digests are order free, so the listing is reduced map-side whatever its length.
    row = per_file.agg(
        F.bit_xor(F.xxhash64("h")).alias("x"), F.count(F.lit(1)).alias("n"), F.max("h").alias("top")
    ).first()
    return hashlib.sha256(f"{row['x']}|{row['n']}|{row['top']}".encode()).hexdigest()[:16]


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of a query as soon as it ends. For queries that end in a written table: nothing reads them again."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def materialise(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    name: str,
    version: str,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Write the frame ``build`` gives once per (application, name, version) to the shared folder and read it back.

    The written table cuts the lineage: losing an executor re-reads files instead of rebuilding joins.
    """
    key = (spark.sparkContext.applicationId, name, version)
    if key not in _TABLES:
        path = f"{shared_folder(spark)}/{name}-{version}-{uuid.uuid4().hex[:8]}"
        df = build()
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with released(spark):
            writer.parquet(path)
        _TABLES[key] = (path, df.schema)
    path, schema = _TABLES[key]
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Widen a scan that has fewer splits than the cluster has cores (few, small files); otherwise unchanged."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df
