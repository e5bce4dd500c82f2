"""A table whose readers see whole versions: data files are never replaced, one small manifest names the current ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "versao bigint, lote bigint, balde string, pasta string"


class VersionedTable:
    """Rows in buckets under ``path``; ``bucket`` is a column that follows from the key, with a bounded number of values.

    A version writes the buckets it changes to a folder of its own and then its manifest, one file with a row a bucket. That file appears
    at once, and with it the version; until then readers keep the one before, and what a stopped writer left is written over by its next try.
    A batch id that a manifest holds already is not written again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket: str):
        self.spark, self.path, self.schema, self.bucket = spark, path.rstrip("/"), schema, bucket

    def manifest(self) -> tuple[int, int, dict[str, str]]:
        """(version, last batch, folder of each bucket) of the newest version; version 0 if there is none. One row a bucket comes to the driver."""
        try:
            every = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifestos/*")
            newest = every.agg(F.max("versao").alias("v")).select("v").scalar()
            rows = every.filter(F.col("versao") == newest).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if not rows:
            return 0, -1, {}
        return rows[0].versao, rows[0].lote, {r.balde: r.pasta for r in rows if r.pasta}

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """The newest whole version, or some buckets of it."""
        _, _, folders = self.manifest()
        chosen = [f for b, f in folders.items() if buckets is None or b in buckets]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def commit(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the buckets that ``batch`` touches by ``merge`` of their rows and the batch; False if this batch is in already."""
        version, last, folders = self.manifest()
        if batch_id <= last:
            return False
        name = F.coalesce(F.col(self.bucket).cast("string"), F.lit("__nulo__"))
        touched = [r[0] for r in batch.select(name).distinct().collect()]
        merged = merge(self.read(touched), batch).select(*self.schema.fieldNames())
        folder = f"{self.path}/dados/v{version + 1}"
        merged.withColumn("_balde", name).write.mode("overwrite").partitionBy("_balde").parquet(folder)
        current = folders | {b: f"{folder}/_balde={b}" for b in touched}
        self._switch(version + 1, batch_id, current)
        return True

    def _switch(self, version: int, batch_id: int, folders: dict[str, str]) -> None:
        rows = [(version, batch_id, b, f) for b, f in folders.items()] or [(version, batch_id, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifestos/v{version}")
