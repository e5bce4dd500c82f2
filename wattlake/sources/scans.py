"""Scans: delimited files, incremental loads, landing, telemetry and document corpora."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.functions.text import fold
from wattlake.sources.contracts import Contract


def scan_delimited(spark: SparkSession, contract: Contract, path: str | None = None) -> DataFrame:
    """SRC01: every column as text under the contract's names, no inference."""
    reader = (
        spark.read.option("header", contract.has_header).option("delimiter", contract.delimiter)
        .option("encoding", contract.encoding).option("enforceSchema", False)
    )
    return contract.rename(reader.schema(contract.text_schema()).csv(path or contract.path))


def parse_time(column: Column, fmt: str) -> Column:
    """Typed by the format hint: a timestamp when it names hours, else a date."""
    parsed = F.try_to_timestamp(column, F.lit(fmt))
    return parsed if "HH" in fmt else parsed.cast("date")


def newer_than(df: DataFrame, column: str, fmt: str, last: DataFrame | None) -> DataFrame:
    """SRC02: rows strictly after the last watermark; all rows on the first load."""
    if last is None:
        return df
    bound = last.select("watermark").scalar()
    return df.filter(F.coalesce(parse_time(F.col(column), fmt) > bound, bound.isNull()))


def last_watermark(audit: DataFrame, source: str) -> DataFrame:
    """SRC03: typed watermark of the newest successful run."""
    return audit.filter((F.col("source_name") == source) & (F.col("status") == "SUCCESS")).agg(
        F.max_by("watermark_value", "executed_at").alias("watermark")
    )


def new_watermark(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """SRC04."""
    return df.agg(F.max(parse_time(F.col(column), fmt)).alias("watermark"))


def technical_columns(df: DataFrame, run_id: str | None = None, source_file: Column | None = None) -> DataFrame:
    """PRJ02: run id, load time, source file, row hash and load date."""
    payload = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.withColumns(
        {
            "_run_id": F.lit(run_id or str(uuid.uuid4())),
            "_ingested_at": F.current_timestamp(),
            "_source_file": source_file if source_file is not None else F.lit(""),
            "_source_hash": F.sha2(F.concat_ws("||", *payload), 256),
            "_partition_date": F.current_date(),
        }
    )


# Source headers of the complaint and invoice sheets.
COMPLAINT_HEADERS = {
    "GRUPO": "grupo", "ORDEM": "ordem", "ASSUNTO": "assunto", "INSTALACAO": "instalacao", "DT. INGRESSO": "dt_ingresso",
    "OBSERVAÇÃO ORDEM": "observacao_ordem", "Status": "status", "DEVOLUTIVA": "devolutiva", "Causa Raiz": "causa_raiz",
}
INVOICE_HEADERS = {
    "ID_RECLAMACAO": "id_reclamacao", "DOC_IMPRESSAO": "doc_impressao", "VALOR_FAT RECLMADA": "valor_fat_reclamada",
    "FAT_RECLAMADA": "fat_reclamada", "DATA_EMISSSAO_FAT": "data_emissao_fat", "DATA_VENCIMENTO": "data_vencimento",
    "DATA RECLAMACAO": "data_reclamacao",
}


def source_region(file: Column) -> Column:
    """SRC07."""
    name = F.upper(file)
    return F.when(name.contains("TRATADO TRIMESTRE_ORDENS") | name.contains("BASE N1"), "SP").otherwise("CE")


def data_type(sheet: Column, file: Column) -> Column:
    """SRC08."""
    low = F.lower(F.trim(sheet))
    return (
        F.when((source_region(file) == "SP") | (low == "base n1"), "base_n1_sp")
        .when(low.contains("erro") & low.contains("leitura"), "erro_leitura")
        .otherwise("reclamacao_total")
    )


def canonical_columns(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """SRC10: renamed columns in a fixed projection, absent ones as NULL."""
    renamed = df.withColumnsRenamed(headers)
    return renamed.select(
        *[F.col(c) if c in renamed.columns else F.lit(None).cast("string").alias(c) for c in headers.values()]
    )


def land_complaints(sheets: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """SRC06/SRC09: union of (frame, file, sheet) triples with tags and row fingerprint."""
    out = None
    for df, file, sheet in sheets:
        tagged = canonical_columns(df, COMPLAINT_HEADERS).withColumns(
            {
                "_sheet_name": F.lit(sheet), "_source_file": F.lit(file), "_source_region": source_region(F.lit(file)),
                "_data_type": data_type(F.lit(sheet), F.lit(file)),
            }
        )
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("_source_hash", fingerprint(out))


def fingerprint(df: DataFrame) -> Column:
    """SRC09: sha256 over file, sheet and the nine business columns."""
    parts = ["_source_file", "_sheet_name", *COMPLAINT_HEADERS.values()]
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), 256)


def land_summary(df: DataFrame) -> DataFrame:
    """SRC12."""
    return df.groupBy("_source_file", "_source_region", "_sheet_name", "_data_type").agg(F.count(F.lit(1)).alias("linhas"))


def normalise_headers(df: DataFrame) -> DataFrame:
    """SRC11: lower-case headers with underscores and plain letters."""
    def norm(name: str) -> str:
        return name.lower().replace(" ", "_").replace(".", "").replace("ç", "c").replace("ã", "a")

    return df.toDF(*[norm(c) for c in df.columns])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """SRC13."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist")
    return spark.table(name)


def read_optional(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet") -> DataFrame:
    """SRC15: an absent path is an empty frame of the declared schema."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if not exists:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC20: malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_documents(spark: SparkSession, paths: list[str], pattern: str = "*.md") -> DataFrame:
    """SRC23: one row per file below the roots."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content"))
        .dropDuplicates(["source_path"])
    )


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """SRC24: partitioned scan of a database table."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper),
                                          numPartitions=str(partitions), **options).load()
    )


def template_questions(entities: DataFrame, templates: list[tuple[str, str]], regions: list[str], n: int, seed: int = 42) -> DataFrame:
    """SRC28: sampled questions from templates, regions and the distinct entities of a table.

    Templates and regions are short parameters exploded per entity; the sample is an ordered limit on a seeded hash.
    """
    rows = entities.select("entidade").distinct().select(
        "entidade", F.explode(F.array(*[F.struct(F.lit(t).alias("texto"), F.lit(i).alias("intencao")) for t, i in templates])).alias("t"),
    ).select("entidade", "t.*", F.explode(F.array(*[F.lit(r) for r in regions])).alias("regiao"))
    text = F.replace(F.replace("texto", F.lit("{entidade}"), F.col("entidade")), F.lit("{regiao}"), F.col("regiao"))
    key = F.xxhash64("entidade", "texto", "regiao", F.lit(seed))
    return rows.select(text.alias("question"), "intencao", "regiao", key.alias("_k")).orderBy("_k", "question").limit(n).drop("_k")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """FLT10: the same n rows in every run."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
