"""Structured Streaming jobs over files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from wattlake.operators.dedup import latest_wins
from wattlake.plans.silver import reject_reasons
from wattlake.sources.contracts import Contract
from wattlake.sources.versioned import VersionedTable


MARKS = StructType([StructField("mais_novo", TimestampType()), StructField("_batch", LongType())])


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """STR01/STR05: new files of a folder; for JSON lines a malformed line is dropped."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if fmt == "json":
        reader = reader.option("mode", "DROPMALFORMED")
    return reader.load(path)


def append_bronze(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """STR01: incremental landing. The checkpoint replaces the watermark table and makes the append exactly-once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start()


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, bucket: str) -> StreamingQuery:
    """STR02/SNK06: latest-wins upsert of a versioned table in buckets (``bucket`` is a column derived from the key).

    A batch reads and rewrites only the buckets of its own keys and becomes visible at once, with its manifest. A replayed batch is a no-op.
    """
    table = VersionedTable(stream.sparkSession, path, stream.schema, bucket)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.commit(batch, batch_id, lambda current, new: latest_wins(current.unionByName(new), keys, [F.col(order)]))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at ``path``, None if there is none yet; any other failure to read it rises."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def split_late(stream: DataFrame, time: str, delay: str, on_time: str, late: str, marks: str, checkpoint: str) -> StreamingQuery:
    """STR03: rows older than the newest time seen in earlier batches minus the delay go to a side table instead of being lost.

    Each batch leaves one row with its newest time; the bound is the largest of the marks before it, so no table is scanned again and a
    replayed batch is routed as it was.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = written(spark, marks, MARKS)
        newest = None if before is None else before.filter(F.col("_batch") < batch_id).agg(F.max("mais_novo")).first()[0]
        bound = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        tagged = batch.withColumn("_late", F.coalesce(F.col(time) < bound, F.lit(False))).withColumn("_batch", F.lit(batch_id))
        per_batch = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch")
        per_batch(tagged.filter("_late").drop("_late")).parquet(late)
        per_batch(tagged.filter("NOT _late").drop("_late")).parquet(on_time)
        per_batch(batch.agg(F.max(time).cast("timestamp").alias("mais_novo")).withColumn("_batch", F.lit(batch_id).cast("long"))).parquet(marks)

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """STR04: exact repeats inside the watermark are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def telemetry_kpis(stream: DataFrame, width: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """STR06: turns, hit rate and latency percentiles per tumbling window."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("janela"))
        .agg(
            F.count(F.lit(1)).alias("turns"), F.avg(F.col("cache_hit").cast("double")).alias("hit_rate"),
            F.percentile_approx("latency_total_ms", [0.5, 0.95], 10000).alias("latencias"),
        )
        .select("janela.start", "janela.end", "turns", "hit_rate", F.col("latencias")[0].alias("p50"), F.col("latencias")[1].alias("p95"))
    )


def daily_counts(stream: DataFrame, time: str, region: str, cause: str, delay: str = "2 days") -> DataFrame:
    """STR07: error counts per day, region and class."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("janela"), F.col(region).alias("regiao"), F.col(cause).alias("classe_erro"))
        .agg(F.count(F.lit(1)).alias("qtd_erros"))
        .select(F.col("janela.start").cast("date").alias("data"), "regiao", "classe_erro", "qtd_erros")
    )


def hotspot_alerts(counts: DataFrame, history: str, alerts: str, checkpoint: str, threshold: float = 3.0) -> StreamingQuery:
    """STR07: finished days are appended to the history; days whose z-score reaches the threshold become alerts."""
    from wattlake.plans.features import score_daily_counts

    def score(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():  # no day is finished yet
            return
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(history)
        scored = score_daily_counts(spark.read.parquet(history).drop("_batch"), threshold)
        fresh = scored.join(batch.select("data", "regiao", "classe_erro"), ["data", "regiao", "classe_erro"], "left_semi").filter("is_anomaly")
        fresh.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(alerts)

    return counts.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def split_rejects(stream: DataFrame, contract: Contract, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """STR08: rows that break the contract are written with their reasons."""

    def route(batch: DataFrame, batch_id: int) -> None:
        checked = reject_reasons(batch, contract).withColumn("_batch", F.lit(batch_id))
        for path, rows in ((accepted, checked.filter("size(_reasons) = 0").drop("_reasons")), (rejected, checked.filter("size(_reasons) > 0"))):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunLength(StatefulProcessor):
    """STR09: running count of consecutive unpaid invoices per unit; the state is one number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "length bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        length = self.run.get()[0] if self.run.exists() else 0
        frame = pd.concat(list(rows)).sort_values(["data_vencimento", "cod_pagamento"])
        out = []
        for late in frame["flag_inadimplente"]:
            length = length + 1 if late else 0
            out.append(length)
        self.run.update((length,))
        yield pd.DataFrame(
            {"cod_uc": [key[0]] * len(frame), "cod_pagamento": frame["cod_pagamento"].to_numpy(), "meses_consecutivos": out}
        )

    def close(self) -> None:
        pass


def unpaid_runs(stream: DataFrame) -> DataFrame:
    """STR09: invoices must arrive in due order per unit across batches; needs the RocksDB state store."""
    return stream.groupBy("cod_uc").transformWithStateInPandas(
        RunLength(), "cod_uc bigint, cod_pagamento bigint, meses_consecutivos bigint", "append", "none"
    )
