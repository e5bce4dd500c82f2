"""Sinks: partition overwrites, audit rows, exports and safe rewrites."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wattlake.sources.contracts import Contract

AUDIT_SCHEMA = (
    "run_id string, source_name string, ingestion_type string, rows_ingested bigint, partition_date date, watermark_value timestamp, "
    "duration_seconds double, status string, error_message string, dag_id string, task_id string, executed_at timestamp"
)


def append_bronze(df: DataFrame, path: str) -> None:
    """SNK01."""
    df.write.mode("append").partitionBy("_partition_date").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: str = "_partition_date") -> None:
    """SNK02/SNK04: only partitions present in the frame are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def overwrite_months(df: DataFrame, path: str, month: str = "mes_referencia") -> None:
    """SNK03."""
    overwrite_partitions(df.withColumn("_partition_date", F.to_date(month, "yyyy-MM")), path)


def audit_row(spark: SparkSession, path: str, **values) -> None:
    """SNK05: one appended row; the watermark is stored as a timestamp."""
    row = {"executed_at": datetime.now(timezone.utc).replace(tzinfo=None), **values}
    names = [f.split()[0] for f in AUDIT_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], AUDIT_SCHEMA).write.mode("append").parquet(path)


def ingest(spark: SparkSession, contract: Contract, df: DataFrame, path: str, audit_path: str, watermark_format: str | None = None) -> dict:
    """SNK15: land a batch and audit it. Row count and watermark are observed during the write, so the source is read once."""
    from wattlake.sources.scans import parse_time, technical_columns

    run_id, started = str(uuid.uuid4()), datetime.now(timezone.utc)
    observed = Observation(f"ingest-{run_id[:8]}")
    measures = [F.count(F.lit(1)).alias("rows")]
    if contract.watermark_column and watermark_format:
        measures.append(F.max(parse_time(F.col(contract.watermark_column), watermark_format).cast("timestamp")).alias("watermark"))
    status, error = "SUCCESS", None
    try:
        landed = technical_columns(contract.check_columns(df), run_id).observe(observed, *measures)
        (append_bronze if contract.strategy == "incremental" else overwrite_partitions)(landed, path)
        result = observed.get
    except Exception as exc:
        status, error, result = "FAILURE", str(exc)[:500], {}
        raise
    finally:
        seconds = (datetime.now(timezone.utc) - started).total_seconds()
        audit_row(
            spark, audit_path, run_id=run_id, source_name=contract.name, ingestion_type=contract.strategy, status=status,
            rows_ingested=(result or {}).get("rows") if status == "SUCCESS" else None, error_message=error,
            watermark_value=(result or {}).get("watermark") if status == "SUCCESS" else None, duration_seconds=seconds,
        )
    return {"run_id": run_id, "source": contract.name, "rows": result["rows"], "watermark": result.get("watermark"), "seconds": seconds, "status": status}


def rewrite(spark: SparkSession, df: DataFrame, root: str, pointer: str = "_current") -> str:
    """Write a new version beside the old one and point to it, so a table is never overwritten while it is read."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{root}/{version}")
    spark.createDataFrame([(version, datetime.now(timezone.utc).replace(tzinfo=None))], "version string, at timestamp").coalesce(1).write.mode(
        "append"
    ).parquet(f"{root}/{pointer}")
    return version


def read_current(spark: SparkSession, root: str, pointer: str = "_current") -> DataFrame:
    version = spark.read.parquet(f"{root}/{pointer}").agg(F.max_by("version", "at").alias("v")).first()["v"]
    return spark.read.parquet(f"{root}/{version}")


def publish_scores(scores: DataFrame, path: str) -> None:
    """SNK08: validated scores, partitioned by scoring date."""
    from wattlake.plans.quality import validate_scores

    check = validate_scores(scores).first()
    if not check["valido"]:
        raise ValueError(f"scores are not valid: {check['nulos']} null, {check['fora_do_intervalo']} outside 0..1")
    overwrite_partitions(scores, path, "data_scoring")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK09/SNK16: a report, written by the tasks that hold it."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


# Exportable domains with their date column.
DOMAINS = {
    "notas": "data_criacao", "entregas": "data_emissao", "pagamentos": "data_vencimento", "metas": "mes_referencia",
    "erro_leitura": "data_ingresso",
}


def domain_rows(df: DataFrame, domain: str, start: str | None = None, end: str | None = None, **equals: str) -> DataFrame:
    """SNK10: date range and equality filters of an export."""
    column = DOMAINS[domain]
    if start:
        df = df.filter(F.col(column) >= start)
    if end:
        df = df.filter(F.col(column) <= end)
    for name, value in equals.items():
        df = df.filter(F.col(name) == value)
    return df


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK10: csv, json or real Parquet."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def stream_rows(df: DataFrame, batch: int = 5000) -> Iterator[list]:
    """SNK11: rows partition by partition, never the whole result at once."""
    rows: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        rows.append(row)
        if len(rows) >= batch:
            yield rows
            rows = []
    if rows:
        yield rows
