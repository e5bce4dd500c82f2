"""Complaint themes, playbook and action texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlake.functions.tables import first_match

# Themes in display order with label and severity.
THEMES: tuple[tuple[str, str, str], ...] = (
    ("refaturamento", "Refaturamento & Cobrança", "high"),
    ("geracao_distribuida", "Geração Distribuída (GD)", "high"),
    ("variacao_consumo", "Variação de Consumo", "medium"),
    ("media_estimativa", "Faturamento por Média/Estimativa", "high"),
    ("ouvidoria_juridico", "Ouvidoria & Auditoria", "medium"),
    ("religacao_multas", "Religação & Multas", "critical"),
    ("entrega_fatura", "Entrega da Fatura", "medium"),
    ("outros", "Outros", "low"),
)

# Ordered subject tokens per theme, first match wins.
THEME_TOKENS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("geracao_distribuida", (" GD", "GD ", "B2G", "RATEIO", "INJETADA", "MICRO GERA", "MINI GERA")),
    (
        "religacao_multas",
        ("AUTORELIG", "AUTO RELIG", "RELIGAC", "A REVELIA", "REVELIA", "MULTA", "TOI", "PERDAS", "CORTE"),
    ),
    (
        "entrega_fatura",
        (
            "CONTA NÃO ENTREGUE", "CONTA NAO ENTREGUE", "FATURA NÃO ENTREGUE", "FATURA NAO ENTREGUE",
            "ENTREGA DE CONTA", "ENTREGA DE FATURA", "FATURA DIGITAL", "END POSTAL", "EMAIL",
        ),
    ),
    (
        "media_estimativa",
        (
            "POR MEDIA", "POR MÉDIA", "FATURAMENTO POR M", "ESTIMAD", "AUSENCIA DE FATURAMENTO",
            "AUSENCIA DE FATURA",
        ),
    ),
    (
        "variacao_consumo",
        (
            "VARIACAO", "VARIAÇÃO", "CONSUMO ATIPICO", "CONSUMO ATÍPICO", "DESCONHECE A UC",
            "CUSTO DE DISPONIBILIDADE",
        ),
    ),
    ("ouvidoria_juridico", ("OUV", "OUVIDORIA", "AUD", "AUDITORIA", "JURID", "PROCON", "ANEEL")),
    (
        "refaturamento",
        (
            "REFAT", "REFATURAMENTO", "COBRANC", "COBRANÇ", "TARIFA", "ICMS", "FATURAMENTO", "CREDIT",
            "RESSARCIMEN", "ERRO DE LEITURA", "ITENS FINANCEIROS", "INCLUSAO DE VALORES", "PARCELAMENTO",
            "LIGAÇAO PROVISORIA", "LIGACAO PROVISORIA",
        ),
    ),
)

# Playbook patterns, action texts per cause, owner area per category.
PLAYBOOK: tuple[tuple[str, str, str], ...] = (
    ("refatur", "Revisar regra e comunicação de faturamento", "Alta"),
    ("leitura", "Priorizar inspeção de medição e tratativa de leitura", "Alta"),
    ("grupo", "Auditar enquadramento tarifário e histórico de mudanças", "Média"),
    ("estimativa", "Reduzir estimativas com coleta e validação adicional", "Média"),
    ("fatura", "Aprimorar jornada de emissão/entrega e contestação", "Média"),
)
PLAYBOOK_DEFAULT = ("Investigar raiz operacional e ajustar playbook local", "Média")
ACTIONS = {
    "leitura_estimada_media": "Forçar leitura presencial; bloquear estimativa por 2 ciclos.",
    "medidor_danificado": "Abrir OS de troca de medidor; congelar fatura até inspeção.",
    "consumo_elevado_revisao": (
        "Disparar análise de carga + comparativo sazonal e comunicar cliente em 48h."
    ),
    "refaturamento_corretivo": (
        "Refaturar conforme cálculo regulatório; notificar cliente via canal preferencial."
    ),
    "procedimento_administrativo": "Encerrar ordem com nota administrativa; sem necessidade de ação técnica.",
    "ajuste_numerico_sem_causa": (
        "Validar planilha de ajuste com Faturamento; documentar no run_id atual."
    ),
    "texto_incompleto": "Solicitar reabertura com descrição completa antes de classificar.",
    "solicitacao_canal_atendimento": "Encaminhar para canal correto; sem necessidade de OS técnica.",
}
ACTION_VALID = "Investigar causa-raiz específica desta categoria antes de qualquer ação corretiva."
ACTION_INVALID = "Confirmar improcedência via revisão amostral e arquivar com justificativa."
AREAS = {
    "processo_leitura": "Field — Leituristas",
    "equipamento": "Field — Manutenção / Medição",
    "contestacao_cliente": "Comercial — Análise de Consumo",
    "faturamento": "Faturamento / Refaturamento",
    "cadastro": "CRM — Cadastro & Titularidade",
    "canal_atendimento": "Atendimento — Canais",
    "acesso_fisico": "Operacional — Técnica",
}
AREA_DEFAULT = "Operacional — Triagem"


def theme_of(subject: Column) -> Column:
    """FN18: theme of a subject; blank or unknown subjects are ``outros``."""
    return F.coalesce(first_match(F.upper(F.coalesce(subject, F.lit(""))), THEME_TOKENS), F.lit("outros"))


def _pick(key: Column, pairs: dict[str, str], default: Column | str) -> Column:
    flat = [F.lit(v) for kv in pairs.items() for v in kv]
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(F.create_map(*flat), key), fallback)


def theme_label(theme: Column) -> Column:
    return _pick(theme, {t: label for t, label, _ in THEMES}, "Outros")


def theme_severity(theme: Column) -> Column:
    return _pick(theme, {t: sev for t, _, sev in THEMES}, "low")


def suggested_action(cause: Column, valid: Column) -> Column:
    """FN35: action text of a cause; the default depends on the outcome."""
    return _pick(cause, ACTIONS, F.when(valid, ACTION_VALID).otherwise(ACTION_INVALID))


def owner_area(category: Column) -> Column:
    """FN35: owner area of a category."""
    return _pick(category, AREAS, AREA_DEFAULT)


def themed_rules(subject: Column, note: Column) -> dict[str, Column]:
    """PRJ25: theme, cause, root-cause flag and rebill indicator from subject and note."""
    text = F.lower(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(note, F.lit(""))))

    def has(*parts: str) -> Column:
        hit = text.contains(parts[0])
        for part in parts[1:]:
            hit = hit | text.contains(part)
        return hit

    billing = has("refatur", "cobrança", "cobranca")
    typed = billing & has("erro") & has("leitura", "digita")
    averaged = billing & ~typed & has("estim", "media", "média")
    corrective = billing & ~typed & ~averaged & has("corretivo")
    generation = ~billing & has("gd", "geracao", "geração", "microgeracao")
    reconnect = ~billing & ~generation & has("religa", "corte", "multa")
    consumption = ~billing & ~generation & ~reconnect & has("consumo") & has("alto", "elevado", "variacao")
    return {
        "macrotema": F.when(averaged, "Faturamento por Média/Estim.")
        .when(billing, "Refaturamento & Cobrança")
        .when(generation, "Geração Distribuída (GD)")
        .when(reconnect, "Religação & Multas")
        .when(consumption, "Variação de Consumo")
        .otherwise("Outros"),
        "causa_raiz_inferida": F.when(typed, "digitacao")
        .when(averaged, "leitura_estimada_media")
        .when(corrective, "refaturamento_corretivo")
        .when(generation, "compensacao_gd")
        .when(consumption, "consumo_elevado_revisao")
        .otherwise("indefinido"),
        "is_root_cause": typed | averaged | corrective,
        "ind_refaturamento": F.when(typed | corrective, 1.0).otherwise(0.0),
    }
