"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.llm.common import SPACE, saved, shared_path


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with each run of white space as one space; null counts as empty."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))


LEAST_BUCKETS = 32
BUCKET_ROWS = 4_000_000  # digests of a bucket, one task's share: about 250 MB


class DigestIndex:
    """Digests seen so far with the id of the row that stays.

    The table lives at ``path`` (a shared folder) and survives the session: opening the same path again continues it.
    It is bucketed and sorted by digest, so a batch is shuffled once into the bucket layout and merged with it; the index itself
    is never shuffled. One row per text enters, whatever the number of copies, so a hot digest weighs one row.

    Ingesting a batch again adds nothing, so a driver that failed half way repeats the batch. The number of buckets is written beside the index
    when it is made, and kept: an index opened without a number takes its own, and one opened with another number is refused, for its
    files would be read in the wrong buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        known = self._known(spark, path)
        if known is not None and buckets not in (None, known):
            raise ValueError(f"the index at {path} has {known} buckets, not {buckets}")
        self.spark, self.path, self.buckets = spark, path, known or buckets or LEAST_BUCKETS
        if known is None:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}-buckets")
        buckets = self.buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @staticmethod
    def _known(spark: SparkSession, path: str) -> int | None:
        try:
            return spark.read.schema("buckets int").parquet(f"{path}-buckets").first()[0]
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, digests: DataFrame) -> None:
        """Append the digests the index does not hold, each with the smallest id of the batch that has it."""
        batch = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        new = batch.join(self.table().hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def decide(self, digests: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) for each row; group_size counts the rows given here."""
        groups = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        known = groups.join(self.table().hint("merge"), "digest")
        rows = digests.join(known, "digest")
        return rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: whether it stays, and which row does instead.

    Documents enter the index in ``batches`` ranges of rising doc_id, so the row with the smallest doc_id is the one that stays; rows of an
    index given here stay before any of ``docs``. Null text counts as empty. Rows without doc_id come last: they give way to any row
    with an id, and in a group with no id at all they all stay, as nothing tells them apart. Rows repeated with the same doc_id and
    text share one decision. Other columns are ignored.
    """
    spark = docs.sparkSession
    digests = saved(text_digests(docs), "digests")
    low, high, rows = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    index = index or DigestIndex(spark, shared_path(spark, "digest-index"), max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))
    if low is None:
        index.ingest(digests)
        return index.decide(digests)
    cuts = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    bounds = [None, *cuts, None]
    for start, end in zip(bounds, bounds[1:], strict=False):
        part = F.lit(True)
        if start is not None:
            part = part & ((F.col("doc_id") >= start) | (F.col("doc_id").isNull() & F.lit(end is None)))
        if end is not None:
            part = part & (F.col("doc_id") < end)
        index.ingest(digests.filter(part))
    return index.decide(digests)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
