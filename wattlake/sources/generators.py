"""Synthetic operational tables of any size, generated in parallel from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = ("CORTE", "RELIGACAO", "INSPECAO_PROGRAMADA", "ATUALIZACAO_CADASTRAL", "EMISSAO_SEGUNDA_VIA")
STATUSES = ("EXECUTADA", "FECHADA", "DEVOLVIDA", "ABERTA", "CANCELADA")
START = "2026-01-01"


def _day(offset: Column) -> Column:
    return F.date_add(F.lit(START).cast("date"), offset.cast("int"))


def _text(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit(""))


def _cycle(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values)).cast("int") + 1)


def _code(base: int, span: int | None = None) -> Column:
    return (F.lit(base) + (F.col("id") % span if span else F.col("id"))).cast("string")


def service_orders(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """SRC25: landing-format service orders."""
    df = spark.range(rows).withColumns({"_c": _day(F.col("id") % 90), "_r": F.floor(F.rand(seed) * 7) + 1})
    df = df.withColumn("_p", F.date_add("_c", F.col("_r").cast("int")))
    return df.select(
        _code(100000).alias("cod_nota"), _code(200000, 500).alias("cod_uc"), _code(300000, 400).alias("cod_instalacao"),
        _code(10, 4).alias("cod_distribuidora"), _code(10000, 24).alias("cod_base"), _code(900, 12).alias("cod_lote"),
        _cycle(SERVICES).alias("tipo_servico"), (F.col("id") % 2 == 0).cast("string").alias("flag_impacto_faturamento"),
        (F.col("id") % 9 == 0).cast("string").alias("area_classificada_risco"), (F.col("id") % 4).cast("string").alias("historico_incidentes_12m"),
        F.when(F.col("id") % 17 == 0, "SUBESTACAO").otherwise("RESIDENCIAL").alias("tipo_instalacao"),
        F.concat(F.lpad((F.col("id") % 12 + 6).cast("string"), 2, "0"), F.lit(":00")).alias("horario_agendado"),
        (F.col("id") % 29 == 0).cast("string").alias("flag_risco_manual"), _text(F.col("_c")).alias("data_criacao"),
        _text(F.col("_p")).alias("data_prevista"),
        _text(F.when(F.col("id") % 6 != 0, F.date_add("_p", (F.col("id") % 4).cast("int")))).alias("data_execucao"),
        _cycle(STATUSES).alias("status"), _code(4000, 40).alias("cod_colaborador"),
    )


def payments(spark: SparkSession, rows: int, seed: int = 44) -> DataFrame:
    """SRC25: landing-format payments with decimal commas."""
    df = spark.range(rows).withColumns({"_d": _day(F.col("id") % 90), "_v": F.round(F.rand(seed) * 400 + 75, 2)})
    money = F.translate(F.format_number("_v", 2), ",.", ".,")
    paid = F.col("id") % 5 != 0
    return df.select(
        _code(700000).alias("cod_pagamento"), _code(600000).alias("cod_fatura"), _code(200000, 500).alias("cod_uc"), money.alias("valor_fatura"),
        F.when(paid, money).otherwise("").alias("valor_pago"), _text(F.col("_d")).alias("data_vencimento"),
        _text(F.when(paid, F.date_add("_d", (F.col("id") % 25).cast("int")))).alias("data_pagamento"),
        F.when(F.col("id") % 3 == 0, "PIX").otherwise("BOLETO").alias("forma_pagamento"),
    )


def masters(spark: SparkSession, rows: int) -> dict[str, DataFrame]:
    """SRC26: consumer units, bases and workers sized by ``rows``."""
    number = (F.col("id") + 1).cast("string")
    return {
        "ucs": spark.range(max(rows, 500)).select(
            number.alias("cod_uc"), (F.col("id") % 24 + 1).cast("string").alias("cod_base"),
            _cycle(("RESIDENCIAL", "COMERCIAL", "INDUSTRIAL")).alias("classe_consumo"),
            F.when(F.col("id") % 7 != 0, "ATIVA").otherwise("SUSPENSA").alias("status_uc"),
        ),
        "bases": spark.range(max(rows // 60, 24)).select(
            number.alias("cod_base"), F.concat(F.lit("BASE "), number).alias("nome_base"),
            F.when(F.col("id") % 5 == 0, "POLO").otherwise("BASE").alias("tipo_base"),
        ),
        "colaboradores": spark.range(max(rows // 30, 40)).select(
            number.alias("cod_colaborador"), F.concat(F.lit("Colaborador "), number).alias("nome_colaborador"),
            F.when(F.col("id") % 2 == 0, "TECNICO_CAMPO").otherwise("SUPERVISOR").alias("funcao"),
        ),
    }
