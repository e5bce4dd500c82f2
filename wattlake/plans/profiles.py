"""Meter and invoice profiles joined to the complaint frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions.text import key_text


def meter_profile(meters: DataFrame) -> DataFrame:
    """A61/JN09/WIN05: dominant meter type, distinct types and equipment per installation.

    The dominant type is the maximum of (count, reversed name) over pre-aggregated pairs, so neither a window nor
    a self join over detail rows is needed.
    """
    rows = meters.select(
        key_text(F.col("instalacao")).alias("instalacao"),
        F.trim(F.coalesce("tipo", F.lit(""))).alias("tipo"),
        F.trim(F.coalesce("equipamento", F.lit(""))).alias("equipamento"),
    ).filter("instalacao <> ''")
    pairs = rows.groupBy("instalacao", "tipo").agg(F.count(F.lit(1)).alias("qtd"))
    dominant = pairs.groupBy("instalacao").agg(
        F.min(F.struct((-F.col("qtd")).alias("neg"), "tipo"))["tipo"].alias("tipo_medidor_dominante"),
        F.count(F.lit(1)).cast("int").alias("tipos_distintos"),
    )
    equipment = rows.groupBy("instalacao").agg(F.countDistinct("equipamento").cast("int").alias("equipamentos_unicos"))
    return dominant.join(equipment, "instalacao").select(
        "instalacao",
        "tipo_medidor_dominante",
        (F.col("tipos_distintos") > 1).alias("instalacao_multi_tipo"),
        "equipamentos_unicos",
        "tipos_distintos",
    )


def invoice_profile(invoices: DataFrame, clean_keys: bool = False) -> DataFrame:
    """Complained invoice profile per order. Keys that are clean text already are left alone, as is their partitioning."""
    rows = invoices.select(
        F.col("ordem") if clean_keys else key_text(F.col("ordem")).alias("ordem"),
        F.col("valor_fatura_reclamada").cast("double").alias("valor"),
        F.nullif(F.trim("fat_reclamada"), F.lit("")).alias("fat"),
        F.datediff("data_reclamacao", "data_emissao_fat").cast("double").alias("emissao"),
        F.datediff("data_reclamacao", "data_vencimento").cast("double").alias("vencimento"),
    ).filter("ordem <> ''")
    return rows.groupBy("ordem").agg(
        F.avg("valor").alias("valor_fatura_reclamada_medio"),
        F.max("valor").alias("valor_fatura_reclamada_max"),
        F.avg("emissao").alias("dias_emissao_ate_reclamacao_medio"),
        F.avg("vencimento").alias("dias_vencimento_ate_reclamacao_medio"),
        F.coalesce(F.mode("fat", True), F.lit("")).alias("fat_reclamada_top"),
        F.count(F.lit(1)).alias("qtd_faturas_reclamadas"),
    )


METER_COLUMNS = {
    "tipo_medidor_dominante": "string",
    "instalacao_multi_tipo": "boolean",
    "equipamentos_unicos": "int",
    "tipos_distintos": "int",
}
INVOICE_COLUMNS = {
    "valor_fatura_reclamada_medio": "double",
    "valor_fatura_reclamada_max": "double",
    "dias_emissao_ate_reclamacao_medio": "double",
    "dias_vencimento_ate_reclamacao_medio": "double",
    "fat_reclamada_top": "string",
    "qtd_faturas_reclamadas": "long",
}


def with_meters(rows: DataFrame, meters: DataFrame) -> DataFrame:
    """JN09: left join of the meter profile by installation; a profile has one row per installation."""
    return rows.join(meters.select("instalacao", *METER_COLUMNS), "instalacao", "left")


def enrich(
    frame: DataFrame, meters: DataFrame | None, invoices: DataFrame | None, clean_keys: bool = False
) -> DataFrame:
    """JN10: left joins of both profiles with availability flags; an absent profile gives typed NULLs.

    The invoices come first: with ``clean_keys`` the rows are still dealt by order. Rows that have the meter columns already
    (``with_meters`` where an order is one row) keep them.
    """
    keys = {} if clean_keys else {"instalacao": key_text(F.col("instalacao")), "ordem": key_text(F.col("ordem"))}
    out = frame.withColumns(keys) if keys else frame
    if invoices is not None:
        out = out.join(invoices.select("ordem", *INVOICE_COLUMNS), "ordem", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in INVOICE_COLUMNS.items()})
    if meters is not None:
        out = with_meters(out, meters)
    elif not set(METER_COLUMNS) <= set(out.columns):
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in METER_COLUMNS.items()})
    return out.withColumns(
        {
            "perfil_fatura_disponivel": F.col("valor_fatura_reclamada_medio").isNotNull(),
            "perfil_medidor_disponivel": F.col("tipo_medidor_dominante").isNotNull(),
        }
    )
