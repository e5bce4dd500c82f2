"""Silver transforms: typed casts, business rules and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions import rules as ru
from wattlake.functions import text as tx
from wattlake.operators.dedup import latest_wins
from wattlake.sources.contracts import Contract


def cast_column(column: Column, kind: str, fmt: str | None) -> Column:
    """PRJ01: text to the declared type; unreadable text becomes NULL instead of failing the job."""
    text = F.nullif(F.trim(column), F.lit(""))
    if kind == "date":
        return F.try_to_timestamp(text, F.lit(fmt or "yyyy-MM-dd")).cast("date")
    if kind == "timestamp":
        return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "1", "t", "yes", "sim", "s"), True).when(text.isNotNull(), False)
    if kind.startswith("decimal") or kind in ("double", "float"):
        return tx.decimal_text(text).try_cast(kind)
    return text.try_cast(kind)


def apply_types(df: DataFrame, contract: Contract) -> DataFrame:
    typed = {c.name: cast_column(F.col(c.name), c.type, c.format).alias(c.name) for c in contract.columns}
    return df.select(*[typed.get(c, F.col(c)) for c in df.columns])


def reject_reasons(df: DataFrame, contract: Contract) -> DataFrame:
    """STR08: adds ``_reasons``, the contract rules a text row breaks."""
    checks = []
    for c in contract.columns:
        text = F.nullif(F.trim(F.col(c.name)), F.lit(""))
        if not c.nullable:
            checks.append(F.when(text.isNull(), f"{c.name}: missing"))
        checks.append(
            F.when(text.isNotNull() & cast_column(F.col(c.name), c.type, c.format).isNull(), f"{c.name}: not {c.type}")
        )
        if c.allowed_values:
            checks.append(F.when(text.isNotNull() & ~text.isin(*c.allowed_values), f"{c.name}: not allowed"))
    return df.withColumn("_reasons", F.array_compact(F.array(*checks)))


def silver_metadata(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """PRJ03."""
    source_run = F.col("_run_id") if "_run_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("_source_run_id", source_run).withColumns(
        {
            "_run_id": F.lit(run_id or str(uuid.uuid4())),
            "_processed_at": F.current_timestamp(),
            "_valid_from": F.current_timestamp(),
            "_valid_to": F.lit(None).cast("timestamp"),
            "_is_current": F.lit(True),
        }
    )


def _reference(reference: str | None) -> Column:
    return F.lit(reference).cast("date") if reference else F.current_date()


def notes(df: DataFrame, reference: str | None = None) -> DataFrame:
    """PRJ06-PRJ08: service class, delay days and status of service orders."""
    today = _reference(reference)
    upper = df.withColumns({"tipo_servico": F.upper(F.trim("tipo_servico")), "status": F.upper(F.trim("status"))})
    risk = ru.risk_flag(
        F.col("area_classificada_risco"), F.col("historico_incidentes_12m"), F.col("tipo_instalacao"),
        F.col("horario_agendado"), F.col("flag_risco_manual"),
    )
    return upper.withColumns(
        {
            "classificacao_acf_asf": ru.service_class(F.col("flag_impacto_faturamento"), F.col("tipo_servico"), risk),
            "dias_atraso": ru.delay_days(F.col("data_prevista"), F.col("data_execucao"), today),
            "status_atraso": ru.delay_status(F.col("data_prevista"), F.col("data_execucao"), today),
        }
    ).withColumn("flag_risco", F.col("classificacao_acf_asf") == "ASF_RISCO")


def deliveries(df: DataFrame, days_before_due: int = 5) -> DataFrame:
    """PRJ09: distance, inside 100 m, before the due date, days to deliver."""
    distance = ru.haversine(F.col("lat_entrega"), F.col("lon_entrega"), F.col("lat_uc"), F.col("lon_uc"))
    return df.withColumn("distancia_metros", distance).withColumns(
        {
            "flag_dentro_coordenada": F.col("distancia_metros") <= 100.0,
            "flag_antes_vencimento": F.coalesce(F.datediff("data_vencimento", "data_entrega") >= days_before_due, F.lit(False)),
            "dias_para_entrega": F.datediff("data_entrega", "data_emissao"),
        }
    )


def business_days_between(df: DataFrame, start: str, end: str, calendar: DataFrame, alias: str) -> DataFrame:
    """Business days after ``start`` up to ``end``. The calendar carries a running count of business days, so
    the answer is the difference of two equi-joined counts instead of a range join."""
    running = calendar.select("data", F.col("dias_uteis_acumulados"))
    a = running.select(F.col("data").alias(start), F.col("dias_uteis_acumulados").alias("_a"))
    z = running.select(F.col("data").alias(end), F.col("dias_uteis_acumulados").alias("_z"))
    return df.join(a, start, "left").join(z, end, "left").withColumn(alias, F.col("_z") - F.col("_a")).drop("_a", "_z")


def payments(df: DataFrame, reference: str | None = None) -> DataFrame:
    """PRJ10: unpaid for more than 30 days, and days late floored at zero when paid."""
    today = _reference(reference)
    return df.withColumns(
        {
            "flag_inadimplente": F.col("data_pagamento").isNull() & (F.datediff(today, F.col("data_vencimento")) > 30),
            "dias_atraso_pagamento": F.when(
                F.col("data_pagamento").isNotNull(),
                F.greatest(F.datediff("data_pagamento", "data_vencimento"), F.lit(0)),
            ).otherwise(F.datediff(today, F.col("data_vencimento"))),
        }
    )


def targets(df: DataFrame) -> DataFrame:
    """PRJ11."""
    return df.withColumn("indicador", F.upper("indicador")).withColumn(
        "pct_atingimento", F.try_divide(F.col("valor_realizado"), F.col("valor_meta")) * 100.0
    ).withColumn("status_meta", ru.target_status(F.col("pct_atingimento")))


def invoice_complaints(df: DataFrame) -> DataFrame:
    """PRJ12."""
    ident = F.regexp_replace(F.trim(F.col("id_reclamacao").cast("string")), r"\.0$", "")
    return df.withColumns(
        {
            "id_reclamacao": ident,
            "ordem": ident,
            "doc_impressao": F.trim("doc_impressao"),
            "fat_reclamada": F.trim("fat_reclamada"),
            "valor_fat_reclamada": tx.decimal_text(F.col("valor_fat_reclamada").cast("string")).try_cast("decimal(12,2)"),
            "dias_emissao_ate_reclamacao": F.datediff("data_reclamacao", "data_emissao_fat"),
            "dias_vencimento_ate_reclamacao": F.datediff("data_reclamacao", "data_vencimento"),
        }
    )


def masters(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ05: descriptive master columns upper-cased and trimmed."""
    return df.withColumns({c: F.upper(F.trim(c)) for c in columns})


CODE_COLUMNS = ("ordem", "instalacao", "grupo", "assunto", "status", "causa_raiz")


def complaints_simple(df: DataFrame) -> DataFrame:
    """PRJ13."""
    codes = {c: F.upper(F.trim(F.col(c).cast("string"))) for c in CODE_COLUMNS if c in df.columns}
    strip = lambda c: F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")))
    texts = {}
    for c in ("observacao_ordem", "devolutiva"):
        texts[f"{c}_raw"] = F.col(c).cast("string")
        texts[c] = strip(F.col(c).cast("string"))
    return df.withColumns(codes).withColumns(texts).withColumns(
        {
            "texto_completo": F.trim(F.concat_ws(" ", "observacao_ordem", "devolutiva")),
            "has_causa_raiz_label": F.col("causa_raiz").isNotNull(),
        }
    )


def rebilled(status: Column, answer: Column) -> Column:
    """PRJ15: the answer or the status speaks of a rebill."""
    return F.coalesce(answer.contains("refatur"), F.lit(False)) | tx.clean_text(status).contains("refatur")


def complaints(df: DataFrame) -> DataFrame:
    """PRJ14: normalised codes, cleaned texts, entities, flags and keep-last dedup per (order, region)."""
    missing = sorted({"ordem", "_source_region", "_sheet_name", "_data_type"} - set(df.columns))
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    out = df.withColumns({c: tx.code_text(F.col(c)) for c in CODE_COLUMNS if c in df.columns})
    for c in ("observacao_ordem", "devolutiva"):
        raw = F.col(c) if c in df.columns else F.lit("")
        out = out.withColumns({f"{c}_raw": raw, c: tx.clean_text(raw)})
    out = out.withColumn("texto_completo", F.trim(F.concat_ws(" ", "observacao_ordem", "devolutiva")))
    label = F.col("causa_raiz").isNotNull() if "causa_raiz" in df.columns else F.lit(False)
    status = F.col("status") if "status" in df.columns else F.lit(None).cast("string")
    out = out.withColumns(tx.extract_entities(F.col("texto_completo"))).withColumns(
        {
            "has_causa_raiz_label": label & (F.col("_source_region") != "SP"),
            "flag_resolvido_com_refaturamento": rebilled(status, F.col("devolutiva")),
        }
    )
    if "dt_ingresso" in df.columns:
        out = out.withColumn("dt_ingresso", F.col("dt_ingresso").try_cast("timestamp"))
    tie = [F.col("_source_hash")] if "_source_hash" in df.columns else []
    return latest_wins(out, ["ordem", "_source_region"], [F.col("_sheet_name"), *tie])


def relabel(df: DataFrame) -> DataFrame:
    """ML17: classifier labels for the training types, undefined for the rest."""
    from wattlake.functions.taxonomy import classify
    from wattlake.plans.frame import TRAINING_TYPES

    training = F.coalesce(F.col("_data_type").isin(*TRAINING_TYPES), F.lit(False))
    needed = df.withColumn("_text", F.when(training, F.col("texto_completo")).otherwise(""))
    return classify(needed, "_text").withColumns(
        {
            "causa_canonica_v3": F.when(training, F.col("classe")).otherwise("indefinido"),
            "causa_canonica_confidence": F.when(training, F.col("confidence")).otherwise("indefinido"),
        }
    ).drop("_text", "classe", "confidence")
