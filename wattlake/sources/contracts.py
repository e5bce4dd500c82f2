"""SRC05: declared sources with typed columns, ingestion strategy and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TECHNICAL_COLUMNS = {
    "_run_id": "STRING",
    "_ingested_at": "TIMESTAMP",
    "_source_file": "STRING",
    "_source_hash": "STRING",
    "_partition_date": "DATE",
}


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    nullable: bool = True
    source_name: str | None = None
    format: str | None = None
    allowed_values: tuple[str, ...] = ()

    @property
    def input_name(self) -> str:
        return self.source_name or self.name


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[Column, ...]
    path: str | None = None
    delimiter: str = ";"
    encoding: str = "UTF-8"
    has_header: bool = True
    strategy: str = "snapshot"
    watermark_column: str | None = None
    partition_by: str | None = None
    dedup_key: tuple[str, ...] = ()
    dedup_order: str | None = None
    min_rows: int = 0
    max_null_pct: float = 1.0
    critical_columns: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not 0 <= self.max_null_pct <= 1:
            raise ValueError("max_null_pct must be between 0 and 1")

    @classmethod
    def from_dict(cls, raw: dict) -> Contract:
        """Contract from the nested mapping of a declaration file (source, schema, ingestion, quality)."""
        source, ingestion, quality = raw["source"], raw.get("ingestion", {}), raw.get("quality", {})
        columns = tuple(
            Column(
                c["name"], c.get("type", "string"), c.get("nullable", True), c.get("source_name"), c.get("format"),
                tuple(c.get("allowed_values", ())),
            )
            for c in raw["schema"]
        )
        return cls(
            name=source["name"], columns=columns, path=source.get("path"), delimiter=source.get("delimiter", ";"),
            encoding=source.get("encoding", "UTF-8"), has_header=source.get("has_header", True),
            strategy=ingestion.get("strategy", "snapshot"), watermark_column=ingestion.get("watermark_column"),
            partition_by=ingestion.get("partition_by"), dedup_key=tuple(ingestion.get("dedup_key", ())),
            dedup_order=ingestion.get("dedup_order"), min_rows=quality.get("min_rows", 0),
            max_null_pct=quality.get("max_null_pct", 1.0), critical_columns=tuple(quality.get("critical_columns", ())),
        )

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def required_columns(self) -> list[str]:
        return [c.name for c in self.columns if not c.nullable]

    def text_schema(self) -> T.StructType:
        """Landing schema: every business column as text under its source name."""
        return T.StructType([T.StructField(c.input_name, T.StringType(), True) for c in self.columns])

    def rename(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({c.input_name: c.name for c in self.columns if c.input_name != c.name})

    def check_columns(self, df: DataFrame) -> DataFrame:
        """PRJ04: required columns must exist before landing."""
        missing = sorted(set(self.required_columns()) - set(df.columns))
        if missing:
            raise ValueError(f"{self.name}: required columns are missing: {missing}")
        return df

    def bronze_ddl(self, database: str = "bronze", location: str | None = None) -> str:
        """SNK14: table statement of the landing table."""
        fields = [f"{c.name} STRING" for c in self.columns] + [f"{n} {t}" for n, t in TECHNICAL_COLUMNS.items()]
        where = f" LOCATION '{location}'" if location else ""
        return (
            f"CREATE TABLE IF NOT EXISTS {database}.{self.name} ({', '.join(fields)}) "
            f"USING parquet PARTITIONED BY (_partition_date){where}"
        )

    def silver_ddl(self, database: str = "silver", location: str | None = None) -> str:
        """SNK14: table statement of the typed table with its validity columns."""
        fields = [f"{c.name} {c.type.upper()}" for c in self.columns]
        fields += [
            "_source_run_id STRING", "_run_id STRING", "_processed_at TIMESTAMP", "_valid_from TIMESTAMP",
            "_valid_to TIMESTAMP", "_is_current BOOLEAN",
        ]
        part = f" PARTITIONED BY ({self.partition_by})" if self.partition_by else ""
        where = f" LOCATION '{location}'" if location else ""
        return f"CREATE TABLE IF NOT EXISTS {database}.{self.name} ({', '.join(fields)}) USING parquet{part}{where}"


def threshold_report(df: DataFrame, contract: Contract) -> DataFrame:
    """DQ08: row count and null share of the critical columns against the contract, one aggregation."""
    shares = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in contract.critical_columns]
    measured = df.agg(F.count(F.lit(1)).alias("_n"), *shares)
    checks = [
        F.struct(
            F.lit("min_rows").alias("rule"), F.col("_n").cast("double").alias("measured"),
            F.lit(float(contract.min_rows)).alias("bound"), (F.col("_n") >= contract.min_rows).alias("ok"),
        )
    ] + [
        F.struct(
            F.lit(f"null_share:{c}").alias("rule"), F.col(c).alias("measured"),
            F.lit(contract.max_null_pct).alias("bound"), (F.col(c) <= contract.max_null_pct).alias("ok"),
        )
        for c in contract.critical_columns
    ]
    return measured.select(F.inline(F.array(*checks)))
