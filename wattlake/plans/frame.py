"""The wide complaint frame every view reads, and the filters applied to it."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions import taxonomy as tax
from wattlake.functions import text as tx
from wattlake.plans.profiles import INVOICE_COLUMNS, METER_COLUMNS, enrich

TRAINING_TYPES = ("erro_leitura", "base_n1_sp")

FRAME_COLUMNS = (
    "ordem", "data_ingresso", "mes_ingresso", "regiao", "tipo_origem", "causa_canonica",
    "causa_canonica_confidence", "status", "assunto", "grupo", "instalacao", "texto_completo",
    "observacao_ordem", "devolutiva", "flag_resolvido_com_refaturamento", "procedente_real",
    "procedencia_real", "procedencia_known", "has_causa_raiz_label", "instalacao_hash",
    "tipo_medidor_dominante", "instalacao_multi_tipo", "equipamentos_unicos", "tipos_distintos",
    "valor_fatura_reclamada_medio", "valor_fatura_reclamada_max", "dias_emissao_ate_reclamacao_medio",
    "dias_vencimento_ate_reclamacao_medio", "fat_reclamada_top", "qtd_faturas_reclamadas",
    "perfil_fatura_disponivel", "perfil_medidor_disponivel", "topic_id", "topic_name", "topic_keywords",
    "_source_region", "_data_type", "dt_ingresso", "causa_raiz",
)

# Columns that only some readers need, by part. A lookup with one row per key adds columns and no rows, so a frame without
# its part is the same rows without the join. ``digest`` is no column of the wide frame: it stands for the text.
PARTS = {
    "topic": ("topic_id", "topic_name", "topic_keywords"),
    "cause": ("causa_canonica", "causa_canonica_confidence"),
    "outcome": ("procedente_real", "procedencia_real", "procedencia_known"),
    "meter": (*METER_COLUMNS, "perfil_medidor_disponivel"),
    "invoice": (*INVOICE_COLUMNS, "perfil_fatura_disponivel"),
    "text": ("texto_completo", "observacao_ordem", "devolutiva"),
    "digest": ("texto_md5",),
}
WHOLE = ("topic", "cause", "outcome", "meter", "invoice", "text")

FILTER_COLUMNS = (
    "regiao", "tipo_origem", "causa_canonica", "causa_canonica_confidence", "topic_name", "status", "assunto",
)


def columns_of(parts: tuple[str, ...]) -> list[str]:
    """Columns of a frame with these parts, in the order of the wide frame."""
    unknown = sorted(set(parts) - set(PARTS))
    if unknown:
        raise ValueError(f"unknown parts: {unknown}")
    left_out = {c for part, columns in PARTS.items() if part not in parts for c in columns}
    extra = [c for part in parts for c in PARTS[part] if c not in FRAME_COLUMNS]
    return [c for c in FRAME_COLUMNS if c not in left_out] + extra


def outcome_lookup(outcomes: DataFrame) -> DataFrame:
    """SRC16: outcome label per order, last row wins by ``sequencia``."""
    label = F.upper(F.trim(F.coalesce("procedencia", F.lit(""))))
    return (
        outcomes.select(
            F.trim(F.col("ordem").cast("string")).alias("ordem"),
            F.when(label.isin("PROCEDENTE", "IMPROCEDENTE"), label).otherwise("NAO_INFORMADA").alias("rotulo"),
            "sequencia",
        )
        .groupBy("ordem")
        .agg(F.max_by("rotulo", "sequencia").alias("procedencia_real"))
    )


def attach_outcome(frame: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """PRJ20: outcome label, known flag and boolean; unknown orders fall back to the rebill flag."""
    rebill = F.coalesce("flag_resolvido_com_refaturamento", F.lit(False))
    if lookup is None:
        joined = frame.withColumn("procedencia_real", F.lit("NAO_INFORMADA"))
    else:
        joined = frame.join(lookup, "ordem", "left").withColumn(
            "procedencia_real", F.coalesce("procedencia_real", F.lit("NAO_INFORMADA"))
        )
    known = F.col("procedencia_real").isin("PROCEDENTE", "IMPROCEDENTE")
    return joined.withColumns(
        {
            "procedencia_known": known,
            "procedente_real": (F.col("procedencia_real") == "PROCEDENTE") | (~known & rebill),
        }
    )


def outcome_from_status(frame: DataFrame) -> DataFrame:
    """PRJ21: outcome from the status text when no lookup exists."""
    status = F.lower(F.coalesce("status", F.lit("")))
    rebill = F.coalesce("flag_resolvido_com_refaturamento", F.lit(False))
    negative = status.contains("improced")
    positive = status.contains("proced") & ~negative
    return frame.withColumns(
        {
            "procedencia_real": F.when(negative, "IMPROCEDENTE")
            .when(positive | rebill, "PROCEDENTE")
            .otherwise("IMPROCEDENTE"),
            "flag_resolvido_com_refaturamento": F.when(positive | negative, positive).otherwise(rebill),
        }
    )


def resolve_causes(silver: DataFrame) -> DataFrame:
    """PRJ19: relabelled cause if present, else human label, else text classifier, else the totals sentinel."""
    if "causa_canonica_v3" in silver.columns:
        raw = F.coalesce("causa_canonica_v3", F.lit(""))
        label = F.coalesce(tax.canonical_label(F.col("causa_canonica_v3")), raw)
        confidence = (
            F.col("causa_canonica_confidence")
            if "causa_canonica_confidence" in silver.columns
            else F.lit("high")
        )
        return silver.withColumns(
            {
                "causa_canonica": F.when(label.isin("", "nan"), "indefinido").otherwise(label),
                "causa_canonica_confidence": F.when(
                    confidence.isin("high", "low", "indefinido"), confidence
                ).otherwise("high"),
            }
        )
    labelled = silver.withColumn("_label", tax.canonical_label(F.col("causa_raiz")))
    scored = F.col("_label").isNull() & F.coalesce(F.col("_data_type").isin(*TRAINING_TYPES), F.lit(False))
    # Rows that already have a cause hand an empty text to the scorer, which then costs next to nothing.
    needed = labelled.withColumn("_text", F.when(scored, F.col("texto_completo")).otherwise(""))
    return (
        tax.classify(needed, "_text")
        .withColumns(
            {
                "causa_canonica": F.coalesce(
                    "_label", F.when(scored, F.col("classe")).otherwise("reclamacao_total_sem_causa")
                ),
                "causa_canonica_confidence": F.when(F.col("_label").isNotNull(), "high")
                .when(scored, F.col("confidence"))
                .otherwise("indefinido"),
            }
        )
        .drop("_label", "_text", "classe", "confidence")
    )


def _targets(mapping: DataFrame) -> DataFrame:
    return mapping.select(
        F.col("topic_id").cast("string").alias("topic_id"),
        F.col("canonical_target").alias("_target"),
        F.col("confidence").alias("_target_confidence"),
    )


def _take_targets(frame: DataFrame) -> DataFrame:
    hit = (F.col("causa_canonica") == "indefinido") & F.col("_target").isNotNull()
    return (
        frame.withColumn("_hit", hit)
        .withColumns(
            {
                "causa_canonica": F.when(F.col("_hit"), F.col("_target")).otherwise(F.col("causa_canonica")),
                "causa_canonica_confidence": F.when(
                    F.col("_hit"), F.coalesce("_target_confidence", F.lit("low"))
                ).otherwise(F.col("causa_canonica_confidence")),
            }
        )
        .drop("_target", "_target_confidence", "_hit")
    )


def apply_topic_causes(frame: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """JN12: rows with an undefined cause take the cause their topic maps to."""
    return frame if mapping is None else _take_targets(frame.join(_targets(mapping), "topic_id", "left"))


def topic_lookup(assignments: DataFrame, taxonomy: DataFrame | None, causes: DataFrame | None) -> DataFrame:
    """JN12: topic, its name, its keywords and the cause it maps to, one row per order that has a topic.

    Names and causes meet the assignments, not the frame: most rows of the frame have no topic, and all those would meet in
    the one task of the empty key.
    """
    out = assignments.select(
        F.col("ordem").cast("string").alias("ordem"), F.col("topic_id").cast("string").alias("topic_id")
    )
    if taxonomy is not None:
        names = taxonomy.select(
            F.col("topic_id").cast("string").alias("topic_id"),
            F.col("topic_name").cast("string").alias("topic_name"),
            tx.join_keywords(F.col("keywords")).alias("topic_keywords"),
        )
        out = out.join(names, "topic_id", "left")
    else:
        out = out.withColumns({"topic_name": F.lit(None).cast("string"), "topic_keywords": F.lit("")})
    if causes is not None:
        return out.join(_targets(causes), "topic_id", "left")
    return out.withColumns({c: F.lit(None).cast("string") for c in ("_target", "_target_confidence")})


def prepare_frame(
    silver: DataFrame,
    *,
    topic_assignments: DataFrame | None = None,
    topic_taxonomy: DataFrame | None = None,
    topic_causes: DataFrame | None = None,
    outcomes: DataFrame | None = None,
    meters: DataFrame | None = None,
    invoices: DataFrame | None = None,
    include_total: bool = False,
    parts: tuple[str, ...] = WHOLE,
    clean_keys: bool = False,
) -> DataFrame:
    """PRJ16: the wide frame with its fixed projection, or the asked ``parts`` of it.

    ``include_total`` keeps rows outside the training types. Totals have no topic and no classifier label, so one
    pass gives what labelled and total rows prepared apart would give (PRJ17). An order has one topic, an order one outcome
    and invoice profile, an installation one meter profile: a lookup whose part is not asked for is not joined. With
    ``clean_keys`` orders and installations are trimmed text already; rows dealt by order then meet all lookups of the order
    where they are.
    """
    columns = columns_of(parts)
    missing = sorted({"ordem", "_source_region", "_data_type", "dt_ingresso"} - set(silver.columns))
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    optional = {
        "causa_raiz": "string", "texto_completo": "string", "status": "string", "assunto": "string",
        "grupo": "string", "instalacao": "string", "observacao_ordem": "string", "devolutiva": "string",
        "flag_resolvido_com_refaturamento": "string", "has_causa_raiz_label": "string",
    }
    frame = silver.withColumns(
        {c: F.lit(None).cast(t) for c, t in optional.items() if c not in silver.columns}
    )
    training = F.coalesce(F.col("_data_type").isin(*TRAINING_TYPES), F.lit(False))
    if not include_total:
        frame = frame.filter(training)
    if "cause" in parts:
        frame = resolve_causes(frame)
    if not clean_keys:
        frame = frame.withColumn("ordem", F.trim(F.col("ordem").cast("string")))
    frame = frame.withColumns(
        {
            "data_ingresso": F.col("dt_ingresso").try_cast("timestamp"),
            "regiao": F.coalesce("_source_region", F.lit("NAO_INFORMADA")),
            "tipo_origem": F.coalesce("_data_type", F.lit("NAO_INFORMADO")),
            "flag_resolvido_com_refaturamento": tx.truthy(F.col("flag_resolvido_com_refaturamento")),
            "has_causa_raiz_label": tx.truthy(F.col("has_causa_raiz_label")),
            "instalacao_hash": tx.pseudonym(F.col("instalacao")),
            "instalacao": F.coalesce(F.col("instalacao").cast("string"), F.lit("")),
        }
    )
    if "digest" in parts:
        frame = frame.withColumn("texto_md5", F.md5("texto_completo"))
    if "outcome" in parts:
        frame = attach_outcome(frame, outcomes)
    if topic_assignments is not None and {"topic", "cause"} & set(parts):
        lookup = topic_lookup(topic_assignments, topic_taxonomy, topic_causes)
        found = [c for c in lookup.columns if c != "ordem"]
        frame = frame.join(lookup, "ordem", "left").withColumns({c: F.when(training, F.col(c)) for c in found})
        if "cause" in parts:
            frame = _take_targets(frame)
    else:
        frame = frame.withColumns({c: F.lit(None).cast("string") for c in PARTS["topic"]})
    frame = enrich(frame, meters if "meter" in parts else None, invoices if "invoice" in parts else None, clean_keys)
    return frame.withColumns(
        {
            "mes_ingresso": F.trunc("data_ingresso", "month"),
            "topic_name": F.coalesce("topic_name", F.lit("sem_topico")),
            "topic_keywords": F.coalesce("topic_keywords", F.lit("")),
        }
    ).select(*columns)


def training_only(frame: DataFrame) -> DataFrame:
    """FLT09: rows of the two training types."""
    return frame.filter(F.col("tipo_origem").isin(*TRAINING_TYPES))


def apply_filters(
    frame: DataFrame, filters: dict[str, Any] | None = None, default_regions: tuple[str, ...] = ("CE", "SP")
) -> DataFrame:
    """FLT01: default regions, whitelisted ``IN`` lists and an inclusive date range, all pushed to the scan."""
    filters = filters or {}
    if default_regions:
        frame = frame.filter(F.col("regiao").isin(*default_regions))
    for column in FILTER_COLUMNS:
        values = filters.get(column)
        if values in (None, "", []):
            continue
        values = [values] if isinstance(values, str) else [str(v) for v in values]
        frame = frame.filter(F.col(column).isin(*values))
    if filters.get("start_date"):
        frame = frame.filter(F.col("data_ingresso") >= F.lit(filters["start_date"]).cast("timestamp"))
    if filters.get("end_date"):
        frame = frame.filter(F.col("data_ingresso") <= F.lit(filters["end_date"]).cast("timestamp"))
    return frame


def dashboard_filters(
    frame: DataFrame,
    *,
    regions: tuple[str, ...] = (),
    causes: tuple[str, ...] = (),
    topics: tuple[str, ...] = (),
    start: date | str | None = None,
    end: date | str | None = None,
    only_rebilled: bool = False,
) -> DataFrame:
    """FLT02: interactive filters; an empty selection keeps everything."""
    for column, values in (("regiao", regions), ("causa_canonica", causes), ("topic_name", topics)):
        if values:
            frame = frame.filter(F.col(column).isin(*values))
    if start:
        frame = frame.filter(F.col("data_ingresso") >= F.lit(str(start)).cast("timestamp"))
    if end:
        frame = frame.filter(F.col("data_ingresso") <= F.lit(str(end)).cast("timestamp"))
    return frame.filter("flag_resolvido_com_refaturamento") if only_rebilled else frame


def filter_options(frame: DataFrame) -> DataFrame:
    """FLT03: sorted distinct regions, causes and topics with the date range, in one aggregation."""
    return frame.agg(
        F.array_sort(F.collect_set("regiao")).alias("regioes"),
        F.array_sort(F.collect_set("causa_canonica")).alias("causas"),
        F.array_sort(F.collect_set("topic_name")).alias("topicos"),
        F.min("data_ingresso").cast("date").alias("min_data"),
        F.max("data_ingresso").cast("date").alias("max_data"),
    )


def preset(frame: DataFrame, name: str) -> DataFrame:
    """FLT04: last 30 days of the data, CE only, or rebilled only."""
    if name == "last_30_days":
        last = frame.agg(F.max("data_ingresso").cast("date").alias("d")).select("d").scalar()
        day = F.col("data_ingresso").cast("date")
        return frame.filter((day >= F.date_sub(last, 30)) & (F.col("data_ingresso") <= last.cast("timestamp")))
    if name == "ce_only":
        return dashboard_filters(frame, regions=("CE",))
    if name == "rebilled_only":
        return dashboard_filters(frame, only_rebilled=True)
    raise ValueError(f"unknown preset: {name}")


def severity_scope(frame: DataFrame, severity: str | tuple[str, ...], min_confidence: str = "high") -> DataFrame:
    """FLT06/JN11: SP rows of the severity set with enough confidence, with taxonomy columns attached.

    The 18-class taxonomy is a literal map, so attaching it is a projection, not a join.
    """
    return (
        frame.filter((F.upper("regiao") == "SP") & tax.confidence_at_least(F.col("causa_canonica_confidence"), min_confidence))
        .withColumns(
            {
                "categoria": tax.category_of(F.col("causa_canonica")),
                "severidade": tax.severity_of(F.col("causa_canonica")),
                "peso_severidade": tax.severity_weight_of(F.col("causa_canonica")),
            }
        )
        .filter(F.col("severidade").isin(*tax.resolve_severities(severity)))
    )


def proc_flag() -> Column:
    return F.coalesce("procedente_real", F.lit(False))
