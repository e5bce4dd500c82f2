"""Cause taxonomy and the expressions that resolve a cause from a label or from free text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.functions.tables import first_match, guarded_rlike, let
from wattlake.functions.text import fold


@dataclass(frozen=True)
class CauseClass:
    name: str
    category: str
    severity: str
    description: str
    terms: tuple[tuple[str, float], ...]
    patterns: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()


SEVERITY_WEIGHT = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
SEVERITY_ORDER = ("critical", "high", "medium", "low")
PATTERN_WEIGHT = 2.0

# The 18 cause classes with their weighted terms, patterns and negative terms.
CAUSE_CLASSES: tuple[CauseClass, ...] = (
    CauseClass(
        "digitacao", "processo_leitura", "high",
        "Digitacao ou transcricao incorreta da leitura pelo leiturista",
        (
            ("digitacao", 3.0), ("digitada errada", 3.0), ("numero errado", 2.5), ("leitura errada", 2.0),
            ("valor incorreto", 2.0), ("leitura incorreta", 2.0), ("inverteu", 2.0), ("invertida", 2.0),
            ("erro de transcricao", 1.0), ("erro do leiturista", 1.0), ("transposicao", 1.0),
        ),
        (
            r"\bleiturista\s+(registrou|anotou|digitou)\s+(errado|incorret)",
            r"\bnumero(s)?\s+(errado|incorret|trocad)",
        ),
    ),
    CauseClass(
        "leitura_estimada_media", "faturamento_por_media", "critical",
        "Faturamento por media devido a impedimento ou ausencia de leitura",
        (
            ("faturamento por media", 3.5), ("por media", 2.5), ("leitura estimada", 3.0), ("estimada", 2.0),
            ("plurimensal", 2.5), ("sem leitura", 2.0), ("leitura nao realizada", 2.5), ("calculo de m", 2.0),
            ("media de consumo", 1.0), ("bimestral", 1.0),
        ),
        (
            r"\baplicac[aã]o\s+(devida|indevida)\s+de\s+m[eé]dia",
            r"\bfatura(mento)?\s+por\s+m[eé]dia",
        ),
    ),
    CauseClass(
        "impedimento_acesso", "acesso_fisico", "high",
        "Leiturista sem acesso fisico ao medidor (portao fechado, animal, cadeado)",
        (
            ("impedimento de leitura", 3.5), ("impedimento", 2.5), ("nao da acesso", 3.0), ("sem acesso", 2.5),
            ("acesso negado", 3.0), ("portao fechado", 2.5), ("portao trancado", 2.5), ("cachorro", 1.5),
            ("cadeado", 1.5), ("dificil acesso", 2.0), ("local de dificil", 2.0), ("centro de medicao", 1.0),
            ("morador ausente", 1.0),
        ),
        (
            r"\bn[aã]o\s+(da|permite|permitiu)\s+acesso",
            r"\bim?pedim?(ento)?\s+de\s+leitura",
        ),
        ("tenho acesso", "com acesso", "tem acesso"),
    ),
    CauseClass(
        "medidor_danificado", "equipamento", "high",
        "Problemas fisicos no medidor (visor embacado, quebrado, travado)",
        (
            ("medidor danificado", 3.5), ("medidor quebrado", 3.5), ("medidor com defeito", 3.0),
            ("visor embacado", 3.0), ("tampa embacada", 2.5), ("visor", 1.5), ("defeito", 1.8), ("aferido", 1.5),
            ("aferica", 1.5), ("laudo", 1.5), ("medidor travado", 1.0), ("medidor parado", 1.0),
        ),
        (
            r"\bmedidor\s+(queimado|quebrad|com\s+defeito|danific)",
            r"\blaudo\s+da\s+aferic",
        ),
    ),
    CauseClass(
        "autoleitura_cliente", "contestacao_cliente", "high",
        "Cliente contesta com foto/video/autoleitura ou apresenta leitura propria (forte em SP)",
        (
            ("autoleitura", 3.5), ("foto da leitura", 3.0), ("foto do medidor", 3.0), ("video do medidor", 3.0),
            ("evidencia", 2.0), ("imagem", 1.5), ("foto apresentada", 2.5), ("cliente informa numero", 2.0),
            ("cliente apresenta leitura", 3.0), ("leitura apresentada", 2.5), ("passa a leitura", 2.5),
            ("informa a leitura", 2.5), ("leitura real", 2.5), ("leitura do dia", 2.0), ("leitura correta", 2.0),
            ("leitura do relogio", 2.5), ("leitura atual", 1.5), ("leitura registrada em fatura", 1.5),
            ("cliente fez a leitura", 1.0), ("encaminhou video", 1.0), ("encaminhou foto", 1.0), ("anexou foto", 1.0),
        ),
        (
            r"\bfoto\s+(do|da)\s+(medid|leitur)",
            r"\bv[ií]deo\s+(do|da)\s+medid",
            r"\bauto\s*leitura\b",
            r"\bcliente\s+(apresenta|informa|passa|encaminh|relata)\s+(a\s+)?leitura",
        ),
    ),
    CauseClass(
        "consumo_elevado_revisao", "contestacao_cliente", "medium",
        "Cliente contesta consumo alto / pede revisao sem evidencia especifica",
        (
            ("revisao de fatura", 2.5), ("revisar fatura", 2.5), ("revisao da fatura", 2.5),
            ("analise de conta", 2.0), ("analise da fatura", 2.0), ("analise da conta", 2.0),
            ("consumo elevado", 2.5), ("valor muito acima", 2.5), ("valor elevado", 2.0), ("fatura alta", 2.0),
            ("conta alta", 2.0), ("reclama do valor", 2.0), ("contestar", 1.8), ("contestacao", 1.8),
            ("variacao", 1.2), ("fora da media", 2.0), ("valor acima", 2.0), ("nao aceita", 1.2),
            ("acima da media", 1.0), ("saiu da media", 1.0),
        ),
        (
            r"\bconsumo\s+(muito\s+)?(alt|elevad)",
            r"\brevis[aã]o\s+(de|da)\s+fatura",
            r"\banal[ií]se\s+(de|da)\s+(conta|fatura)",
        ),
    ),
    CauseClass(
        "compensacao_gd", "geracao_distribuida", "critical",
        "Geracao distribuida — compensacao/rateio de energia injetada errada",
        (
            ("gd", 2.5), ("geracao distribuida", 3.5), ("energia injetada", 3.0), ("compensacao", 2.5),
            ("saldo de rateio", 3.0), ("creditos de energia", 2.5), ("inversao", 2.0), ("energia gerada", 2.0),
            ("mini gerador", 2.0), ("solar", 1.0), ("fotovoltaic", 1.0),
        ),
        (
            r"\bcompensac[aã]o\s+de\s+energia",
            r"\binvers[aã]o\s+de\s+(consumo|energia)",
        ),
    ),
    CauseClass(
        "refaturamento_corretivo", "resolucao", "medium",
        "Ordem resolvida via refaturamento (procedente)",
        (
            ("refaturamento", 3.0), ("refaturar", 2.5), ("refatur", 2.0), ("fatura corrigida", 2.5),
            ("ajuste da leitura", 2.5), ("ajuste da conta", 2.5), ("ajuste de fatura", 2.5),
            ("nota de credito", 2.0), ("estorno", 2.0), ("fatura cancelada", 2.5), ("cobranca cancelada", 1.0),
        ),
        (
            r"\brefatur(ad|ament|a\s)",
            r"\bfatura\s+ajustad",
        ),
    ),
    CauseClass(
        "cobranca_indevida", "faturamento", "high",
        "Multa, taxa ou produto indevido na fatura (crefaz, religacao, etc)",
        (
            ("cobranca indevida", 3.5), ("cobranca multa", 2.5), ("autoreligacao", 3.0), ("religacao", 2.0),
            ("multa", 2.0), ("crefaz", 2.5), ("produto", 1.2), ("excluir cobranca", 2.5), ("retirar produto", 2.5),
            ("exclusao de crefaz", 1.0), ("cancelar produto", 1.0),
        ),
    ),
    CauseClass(
        "troca_titularidade", "cadastro", "medium",
        "Erro relacionado a troca de titularidade (faturamento indevido)",
        (
            ("troca de titularidade", 3.5), ("titularidade", 2.5), ("novo titular", 2.0),
            ("mudanca de titular", 2.5), ("transferencia de titularidade", 1.0),
        ),
    ),
    CauseClass(
        "endereco_tipologia", "cadastro", "medium",
        "Endereco, tipologia ou unidade divergente / ordem em UC errada",
        (
            ("endereco divergente", 3.0), ("tipologia incorreta", 3.0), ("tipologia errada", 3.0),
            ("outra area", 2.5), ("unidade errada", 2.5), ("instalacao errada", 2.5), ("nova ordem", 1.5),
            ("mudou de endereco", 1.0), ("endereco errado", 1.0),
        ),
    ),
    CauseClass(
        "data_vencimento_ciclo", "ciclo_faturamento", "low",
        "Problemas de ciclo/vencimento (duas faturas no mes, data fixa)",
        (
            ("duas faturas", 3.0), ("mesmo mes", 1.5), ("data de vencimento", 2.5), ("vencimento proximo", 2.5),
            ("vecto fixo", 2.5), ("ciclo de leitura", 2.5), ("dt de leitura", 1.0), ("periodo de dias", 1.0),
        ),
    ),
    CauseClass(
        "art_113_regulatorio", "regulatorio", "critical",
        "Aplicacoes de ART 113 / recuperacao de consumo regulatoria",
        (
            ("art 113", 4.0), ("art. 113", 4.0), ("artigo 113", 3.5), ("recuperacao de consumo", 3.0),
            ("cocel", 2.0), ("prodist", 1.0),
        ),
    ),
    CauseClass(
        "leitura_confirmada_improcedente", "resolucao", "low",
        "Leitura aferida ou confirmada — reclamacao improcedente",
        (
            ("leitura confirmada", 3.5), ("leitura conferida", 3.0), ("improcedente", 3.0),
            ("procedente parcial", 2.0), ("sem divergencia", 2.5), ("fatura correta", 2.5),
            ("leitura aferida", 1.0), ("comprovada", 1.0), ("sem variacao", 1.0),
        ),
        (
            r"\bimpro?cedent",
            r"\bleitura\s+confer[ií]d",
        ),
    ),
    CauseClass(
        "procedimento_administrativo", "resolucao_administrativa", "low",
        "Resolucao administrativa sem causa tecnica explicita",
        (
            ("procedente conforme solicitado", 3.0), ("ajuste realizado em ordem", 3.0), ("ajuste concluido", 2.5),
            ("fatura atualizada para pagamento", 3.0), ("faturas atualizadas para pgto", 3.0),
            ("refaturamento ok", 2.5), ("conforme solicitado", 1.5), ("ajustado em ordem", 1.0),
            ("corrigido conforme", 1.0), ("fatura atualizada", 1.0),
        ),
        (
            r"\bprocedente\b.*\bconforme\s+solicitad",
            r"\bajuste\s+(realizad|conclu[ií]d)\b",
            r"\bfatura(s)?\s+(atualizad|corrigid)\s+para\s+(pgto|pagamento)",
        ),
    ),
    CauseClass(
        "ajuste_numerico_sem_causa", "resolucao_administrativa", "low",
        "Correcao numerica de consumo sem evidencia da causa raiz operacional",
        (
            ("corrigir consumo", 2.0), ("corrigido consumo", 2.0), ("corrigida referencia", 2.0), ("kwh", 1.0),
            ("ref 202", 1.0), ("referencia 20", 1.0), ("consumo da ref", 1.0),
        ),
        (
            r"\bcorrig\w+\s+consumo\s+(da\s+)?ref(erencia)?\s+\d{6}",
            r"\bajustad\w+\s+\w+\s+consumo\s+.*\d+\s*kwh",
            r"\b\d+\s*kwh\s+para\s+cada\s+mes",
        ),
    ),
    CauseClass(
        "texto_incompleto", "qualidade_texto", "low",
        "Texto truncado ou abreviado demais para inferir causa operacional",
        (("fvpou", 2.0), ("aten", 1.5), ("conf", 1.0), ("inst", 1.0), ("refat", 1.0), ("digita", 1.0)),
    ),
    CauseClass(
        "solicitacao_canal_atendimento", "canal_atendimento", "low",
        "Contato ou solicitacao por canal de atendimento sem causa tecnica",
        (
            ("telefone", 2.0), ("email", 2.0), ("e-mail", 2.0), ("whatsapp", 2.0), ("central", 1.5), ("sms", 1.5),
            ("agente", 1.2), ("contato via", 1.0), ("anexo", 1.0), ("mail", 1.0),
        ),
        (
            r"\b(contato|retorno)\s+(via|por)\s+(telefone|e-?mail|whatsapp|sms)",
            r"\banexo\s+(por|via)\s+(mail|e-?mail)",
        ),
    ),
)

# Ordered substrings that map a human label (accent-free, blanks as underscores) to a class.
LABEL_SUBSTRINGS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("digitacao", ("digitacao",)),
    (
        "leitura_estimada_media",
        ("media", "estimada", "faturamento_por_media", "plurimensal", "calculo_de_m", "aplicacao_de_media"),
    ),
    ("medidor_danificado", ("medidor", "defeito", "danificado", "visor", "embacada", "aferida")),
    ("impedimento_acesso", ("acesso", "impedimento", "portao", "sem_acesso")),
    ("autoleitura_cliente", ("autoleitura", "foto", "video", "evidencia")),
    ("endereco_tipologia", ("endereco", "tipologia", "outra_area", "localizacao")),
    (
        "refaturamento_corretivo",
        ("refatur", "fatura_corrigida", "ajuste_leitura", "ajuste_de_fatura", "nota_credito"),
    ),
    ("compensacao_gd", ("gd", "geracao_distribuida", "injetada", "compensacao")),
    ("cobranca_indevida", ("autoreligacao", "multa", "crefaz", "cobranca_indevida")),
    ("troca_titularidade", ("titularidade", "titular")),
    ("data_vencimento_ciclo", ("duas_faturas", "vencimento", "vecto", "ciclo")),
    ("art_113_regulatorio", ("art_113", "art.113", "artigo_113", "recuperacao")),
    ("leitura_confirmada_improcedente", ("confirmada", "conferida", "improcedente", "sem_variacao")),
    ("consumo_elevado_revisao", ("consumo_elevado", "variacao", "revisao")),
    (
        "procedimento_administrativo",
        ("procedimento_administrativo", "procedente_conforme", "ajuste_realizado"),
    ),
    ("ajuste_numerico_sem_causa", ("ajuste_numerico", "corrigir_consumo", "corrigido_consumo")),
    ("texto_incompleto", ("texto_incompleto", "truncado")),
    ("solicitacao_canal_atendimento", ("canal_atendimento", "telefone", "email", "whatsapp", "central")),
)

# Rules that settle a text before scoring.
RESOLUTION_PATTERN = (
    r"(procedente.*conforme|ajuste\s+(realizado|conclu)|"
    r"fatura\s+(atualizada|corrigida)\s+para\s+(pgto|pagamento)|refat\s+ok)"
)
CAUSE_HINT_PATTERN = (
    r"(medidor|leiturista|estim|digit|impedim|titularid|gd\s+|tarif|consumo\s+(elev|atip))"
)
TRUNCATION_TOKENS = ("refat", "digita", "conf", "inst", "fvpou", "aten")

MIN_SCORE = 0.6
MARGIN_RATIO = 1.02
HIGH_MIN_SCORE = 1.0
HIGH_MARGIN_RATIO = 1.05


def canonical_label(value: Column) -> Column:
    """FN17: class of a human label by ordered substrings; NULL when nothing matches."""
    text = F.lower(F.trim(value))
    key = F.replace(fold(value), F.lit(" "), F.lit("_"))
    named = F.when(text.isin(*[c.name for c in CAUSE_CLASSES]), text)
    return F.when((text != "") & (text != "nan"), F.coalesce(first_match(key, LABEL_SUBSTRINGS), named))


def class_scores(folded: Column, classes: tuple[CauseClass, ...] = CAUSE_CLASSES) -> Column:
    """Scores per class: term weights plus a bonus per pattern; a negative term zeroes the class.

    The struct sorts by score first and by the earlier class second.
    """

    def scored(text: Column) -> Column:
        entries = []
        for index, cause in enumerate(classes):
            total = F.lit(0.0)
            for term, weight in cause.terms:
                total = total + F.when(text.contains(term), weight).otherwise(0.0)
            for pattern in cause.patterns:
                total = total + F.when(guarded_rlike(text, pattern), PATTERN_WEIGHT).otherwise(0.0)
            for negative in cause.negatives:
                total = F.when(text.contains(negative), 0.0).otherwise(total)
            entries.append(
                F.struct(
                    F.round(total, 4).alias("score"), F.lit(-index).alias("rank"), F.lit(cause.name).alias("classe")
                )
            )
        return F.array(*entries)

    return let(folded, scored)


def preclass(folded: Column) -> Column:
    """Administrative resolutions and truncated texts, settled without scoring."""
    words = F.filter(F.split(folded, " "), lambda w: w != "")
    n_words = F.size(words)
    n_short = F.size(F.filter(words, lambda w: w.isin(*TRUNCATION_TOKENS)))
    resolution = folded.rlike(RESOLUTION_PATTERN) & ~folded.rlike(CAUSE_HINT_PATTERN)
    truncated = ((F.char_length(folded) <= 25) & (n_short > 0)) | ((n_words <= 6) & (n_short >= n_words * 0.6))
    return F.when(
        folded != "",
        F.when(resolution, "procedimento_administrativo").when(truncated, "texto_incompleto"),
    )


def classify(df: DataFrame, text_column: str, *, full: bool = False) -> DataFrame:
    """UDF05: adds ``classe`` and ``confidence`` (and probability, raw score and top three with ``full``).

    Everything is a column expression evaluated where the row already is, so no text is shuffled. A blank text
    skips the scoring.
    """
    empty = F.array(
        *[
            F.struct(F.lit(0.0).alias("score"), F.lit(-i).alias("rank"), F.lit(c.name).alias("classe"))
            for i, c in enumerate(CAUSE_CLASSES)
        ]
    )
    best = F.reverse(F.array_sort(class_scores(F.col("_folded"))))
    scored = (
        df.withColumn("_folded", fold(F.coalesce(F.col(text_column), F.lit(""))))
        .withColumn("_pre", preclass(F.col("_folded")))
        .withColumn("_sorted", F.when(F.col("_folded") == "", empty).otherwise(best))
        .withColumn("_top", F.element_at("_sorted", 1))
        .withColumn("_second", F.element_at("_sorted", 2)["score"])
    )
    top = F.col("_top")["score"]
    second = F.col("_second")
    weak = top < MIN_SCORE
    ambiguous = (second > 0) & (top < second * MARGIN_RATIO)
    label = F.when(weak | ambiguous, "indefinido").otherwise(F.col("_top")["classe"])
    confident = (top >= HIGH_MIN_SCORE) & ((second <= 0) | (top >= second * HIGH_MARGIN_RATIO))
    out = scored.withColumn("classe", F.coalesce("_pre", label)).withColumn(
        "confidence",
        F.when(F.col("_pre").isNotNull(), "high")
        .when(F.col("classe") == "indefinido", "indefinido")
        .when(confident, "high")
        .otherwise("low"),
    )
    if full:
        total = F.aggregate("_sorted", F.lit(0.0), lambda acc, e: acc + e["score"])
        share = lambda s: F.when(total > 0, s / total).otherwise(1.0 / len(CAUSE_CLASSES))
        settled = F.col("_pre").isNotNull()
        out = (
            out.withColumn("probabilidade", F.when(settled, 1.0).otherwise(F.round(share(top), 4)))
            .withColumn("score_bruto", F.when(settled, 99.0).otherwise(F.round(top, 2)))
            .withColumn(
                "top3",
                F.when(
                    settled,
                    F.array(
                        F.struct(
                            F.col("_pre").alias("classe"),
                            F.lit(1.0).alias("probabilidade"),
                            F.lit(99.0).alias("score_bruto"),
                        )
                    ),
                ).otherwise(
                    F.transform(
                        F.slice("_sorted", 1, 3),
                        lambda e: F.struct(
                            e["classe"].alias("classe"),
                            F.round(share(e["score"]), 4).alias("probabilidade"),
                            F.round(e["score"], 2).alias("score_bruto"),
                        ),
                    )
                ),
            )
            .withColumn("ambiguous", F.when(settled, False).otherwise(ambiguous))
            .withColumn("weak_signal", F.when(settled, False).otherwise(weak))
        )
    return out.drop("_folded", "_pre", "_sorted", "_top", "_second")


def classify_distinct(df: DataFrame, text_column: str) -> DataFrame:
    """JN19/SET05: classify every distinct text once and join the labels back by digest.

    Worth its shuffle only when copies dominate; the digest, not the text, is the join key. A hot digest (one text
    copied very often) is one row on the label side, so adaptive execution may split the other side freely.
    """
    keyed = df.withColumn("_digest", F.sha2(fold(F.coalesce(F.col(text_column), F.lit(""))), 256))
    distinct = keyed.groupBy("_digest").agg(F.first(text_column).alias("_text"))
    labels = classify(distinct, "_text").select("_digest", "classe", "confidence")
    return keyed.join(labels, "_digest", "left").drop("_digest")


def taxonomy_frame(spark: SparkSession) -> DataFrame:
    """One row per class; 18 rows, so joins against it stay map-side by its known size."""
    rows = [
        (c.name, c.category, c.severity, SEVERITY_WEIGHT[c.severity], c.description, len(c.terms))
        for c in CAUSE_CLASSES
    ]
    return spark.createDataFrame(
        rows,
        "classe string, categoria string, severidade string, peso_severidade double, descricao string, "
        "n_keywords int",
    )


def _lookup(key: Column, pairs: dict[str, object]) -> Column:
    flat = [F.lit(v) for kv in pairs.items() for v in kv]
    return F.try_element_at(F.create_map(*flat), key)


def category_of(cause: Column) -> Column:
    return F.coalesce(_lookup(cause, {c.name: c.category for c in CAUSE_CLASSES}), F.lit("nao_classificada"))


def severity_of(cause: Column) -> Column:
    return F.coalesce(_lookup(cause, {c.name: c.severity for c in CAUSE_CLASSES}), F.lit("low"))


def severity_weight_of(cause: Column) -> Column:
    return F.coalesce(
        _lookup(cause, {c.name: SEVERITY_WEIGHT[c.severity] for c in CAUSE_CLASSES}), F.lit(1.0)
    )


# Alias words of a severity and the rank of a confidence.
SEVERITY_ALIAS = {
    "alta": "high", "high": "high", "critica": "critical", "critical": "critical",
    "media": "medium", "medium": "medium", "baixa": "low", "low": "low",
}
CONFIDENCE_RANK = {"indefinido": 0, "low": 1, "high": 2}


def resolve_severities(value: str | tuple[str, ...] | list[str]) -> list[str]:
    """FN19: severity names of an alias or a list of aliases."""
    words = [value] if isinstance(value, str) else list(value)
    words = [w.lower() for w in words]
    if any(w in ("demais", "outras", "media_baixa") for w in words):
        return ["medium", "low"]
    return [SEVERITY_ALIAS.get(w, w) for w in words]


def confidence_at_least(confidence: Column, minimum: str = "high") -> Column:
    """FLT07: confidence rank reaches the minimum; ``all`` keeps every row."""
    if minimum in ("", "all", "todos", "any"):
        return F.lit(True)
    rank = F.coalesce(_lookup(F.lower(confidence), CONFIDENCE_RANK), F.lit(0))
    return rank >= CONFIDENCE_RANK.get(minimum, CONFIDENCE_RANK["high"])
