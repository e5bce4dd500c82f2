"""Question normalisation, routing and safety flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlake.functions.tables import any_of, let
from wattlake.functions.characters import fold_characters
from wattlake.functions.text import mask_pii, squeeze

# Words left out of a token set.
STOPWORDS = (
    "a", "o", "os", "as", "um", "uma", "de", "do", "da", "dos", "das", "no", "na", "nos", "nas", "em", "para", "por",
    "que", "com", "como", "qual", "quais", "e", "ou", "ao", "à", "às", "se", "tem", "ter", "dada", "dado", "sobre",
)

# Ordered intent terms.
INTENT_TERMS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("cortesia", ("obrigad", "valeu", "tchau", "até logo")),
    ("sprint", ("sprint", "entregável", "roadmap")),
    ("ml", ("modelo", "classific", "predict", "acurácia")),
    ("dashboard_howto", ("dashboard", "aba", "gráfico", "filtro", "streamlit")),
    (
        "analise_dados",
        (
            "por que", "porque", "causa", "explique", "análise", "analise", "quantos", "quantas", "volume", "taxa",
            "percentual", "mensal", "total", "reclama", "problema", "problemas", "erro de leitura", "digita", "instala",
            "uc", "medidor", "tipos de medidor", "tipo de medidor", "compare", "compar", "resumo", "dados", "taxonomia",
        ),
    ),
    ("dev", ("como rodar", "como executar", "como instalar", "comando")),
)
GREETING = r"^\s*(olá|ola|oi+|bom\s*dia|boa\s*tarde|boa\s*noite|hello|hi|hey|e\s*aí)\b"

# Injection phrases, region patterns.
INJECTION_PHRASES = (
    "ignore previous", "ignore all previous", "disregard the above", "ignore suas instruções", "ignore as instruções",
    "reveal your prompt", "mostre seu prompt", "system prompt:", "jailbreak", "DAN mode", "act as a different",
)
OTHER_STATES = (
    r"\b(rio de janeiro|minas gerais|bahia|pernambuco|paraná|parana|paraíba|paraiba|rio grande do sul|rio grande do norte|"
    r"goiás|goias|mato grosso|santa catarina|amazonas|pará|maranhão|maranhao|alagoas|sergipe|piauí|piaui|tocantins|"
    r"rondônia|rondonia|acre|amapá|amapa|roraima|espírito santo|espirito santo|distrito federal)"
)
OTHER_STATE_CODES = r"\b(RJ|MG|BA|PE|PR|PB|RS|RN|GO|MT|MS|SC|AM|PA|MA|AL|SE|PI|TO|RO|AC|AP|RR|ES|DF)\b"
HOME_SCOPE = r"(ceará|cearense|\bce\b|são paulo|paulista|\bsp\b)"
CE_SCOPE = r"(ceará|cearense|fortaleza|\bce\b)"
SP_SCOPE = r"(são paulo|paulista|\bsp\b)"

# Query expansion and document-type routing.
EXPANSIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("reincid", ("recorrência", "repetição", "mesma instalação")),
    ("sazon", ("mensal", "pico", "tendência temporal")),
    ("assunto", ("tema", "categoria de reclamação")),
    ("causa", ("causa-raiz", "motivo")),
    ("motivo", ("causa-raiz", "driver operacional", "recorrência")),
    ("recorrent", ("reincidência", "frequência", "série mensal")),
    ("instala", ("uc", "unidade consumidora")),
    ("medidor", ("tipo de medidor", "digital", "analógico", "ciclométrico")),
    ("digital", ("medidor digital", "causa por tipo", "percentual no tipo")),
    ("refaturamento produtos", ("ce total", "assunto causa", "refaturamento corretivo")),
    ("fatura", ("valor da fatura", "emissão", "vencimento")),
)
ROUTES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (r"(?U)(ceará|cearense|fortaleza|\bce\b)", ("data", "business", "viz")),
    (r"(?U)(são paulo|paulista|\bsp\b)", ("data", "business", "viz")),
    (
        any_of(
            (
                "quantos", "quantas", "volume", "total de", "percentual", "porcentagem", "top ", "ranking", "maior",
                "mais frequente", "evolução", "mensal", "reclamações", "reclamacoes", "causa-raiz", "causa raiz", "assunto",
                "reincid", "sazon", "perfil", "medidor", "fatura", "taxonomia",
            )
        ),
        ("data", "business", "viz"),
    ),
    (any_of(("sprint", "entregável", "deliverable")), ("sprint",)),
    (any_of(("acf", "asf")), ("business", "viz")),
    (any_of(("refatur", "religa", "grupo b", "grupo a", "gd ")), ("data", "business", "viz")),
    (any_of(("modelo", "predict", "feature", "isolation", "lightgbm", "xgboost")), ("ml",)),
    (any_of(("endpoint", "fastapi", "api ", "rota")), ("api",)),
    (any_of(("bronze", "silver", "gold", "ingestão", "spark", "iceberg")), ("architecture",)),
    (any_of(("dashboard", "streamlit", "plotly", "aba", "filtro")), ("viz",)),
)
# SP card boosts by question pattern (callers may pass further rules per region).
CARD_BOOSTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (r"\b(causa|causas|motivo|motivos|principal|principais)\b", ("sp-n1-causas", "sp-n1-assuntos")),
    (r"\b(assunto|assuntos|tipo de reclama|reclama)\b", ("sp-n1-assuntos", "sp-n1-causas")),
    (
        r"\b(mensal|mês|meses|tempo|evolu|série|serie|repete|repetem|ao longo|tendência|tendencia|pico)\b",
        ("sp-n1-mensal",),
    ),
    (r"\b(grupo|tarifári|tarifario|\bgb\b|\bga\b)\b", ("sp-n1-grupo",)),
    (r"\b(quantas|quantos|total|totais|volume|visão geral|visao geral|resumo|tickets?)\b", ("sp-n1-overview",)),
    (
        r"\b(instala\w*|\buc\b|ucs|cliente|clientes|consumidor|consumidores|medidor)\b",
        ("sp-n1-top-instalacoes", "sp-tipos-medidor"),
    ),
)


def canonical_question(x: Column) -> Column:
    """FN23: lower case with quotes, brackets and numbers as a placeholder and punctuation removed."""
    t = F.trim(F.lower(x))
    t = F.regexp_replace(t, r"""['"][^'"]{0,200}['"]""", "§")
    t = F.regexp_replace(t, r"\[[^\]]{0,80}\]", "§")
    t = F.regexp_replace(t, r"\b\d{2,}\b", "§")
    t = F.regexp_replace(t, r"""[\.,;:!\?\(\)\[\]\{\}"'\-_/\\]+""", " ")
    return squeeze(t)


def token_set(x: Column) -> Column:
    """FN24: sorted distinct words of the canonical form without stopwords."""
    words = F.filter(F.split(canonical_question(x), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return F.concat_ws(" ", F.array_sort(F.array_distinct(words)))


def candidate_digests(x: Column) -> Column:
    """FN25: digests of the canonical form, the token set and the plain lower-case text."""
    return F.array(F.sha2(canonical_question(x), 256), F.sha2(token_set(x), 256), F.sha2(F.trim(F.lower(x)), 256))


def normal_question(x: Column) -> Column:
    """TXT12: accent-free lower case without punctuation."""
    folded = fold_characters(x)
    return squeeze(F.regexp_replace(folded, r"(?U)[^\w\s]", " "))


def intent(x: Column) -> Column:
    """FN31: first matching intent."""

    def body(t: Column) -> Column:
        cases = F.when(t.rlike(GREETING), "saudacao")
        for name, terms in INTENT_TERMS:
            cases = cases.when(t.rlike(any_of(terms)), name)
        return cases.otherwise("glossario")

    return let(F.trim(F.lower(x)), body)


def region_of(x: Column) -> Column:
    """Regional scope named in a question: CE, SP, both or none."""
    ce, sp = F.lower(x).rlike("(?U)" + CE_SCOPE), F.lower(x).rlike("(?U)" + SP_SCOPE)
    return F.when(ce & sp, "CE+SP").when(ce, "CE").when(sp, "SP")


def out_of_region(x: Column) -> Column:
    """FN30: another state is named and the home states are not."""
    other = F.lower(x).rlike("(?U)" + OTHER_STATES) | x.rlike(OTHER_STATE_CODES)
    return other & ~F.lower(x).rlike("(?U)" + HOME_SCOPE)


def input_check(x: Column) -> Column:
    """FN29: allowed flag, reason and masked text."""
    t = F.trim(x)
    low = F.lower(t)
    injected = low.rlike(any_of(INJECTION_PHRASES))
    reason = (
        F.when(t == "", "empty").when(F.char_length(t) > 2000, "too_long").when(injected, "injection").otherwise("")
    )
    return let(
        reason,
        lambda r: F.struct(
            (r == "").alias("allowed"), r.alias("reason"), F.when(r == "", mask_pii(t)).otherwise("").alias("sanitized")
        ),
    )


def expand_query(x: Column) -> Column:
    """FN34: question with the synonyms of its trigger words appended."""
    t = F.trim(x)
    extras = [F.when(F.lower(t).contains(trigger), " ".join(words)) for trigger, words in EXPANSIONS]
    return F.concat_ws(" ", t, *extras)


def route(x: Column) -> Column:
    """FN33: document types worth searching; NULL for all."""

    def body(t: Column) -> Column:
        cases = None
        for pattern, kinds in ROUTES:
            value = F.array(*[F.lit(k) for k in kinds])
            cases = F.when(t.rlike(pattern), value) if cases is None else cases.when(t.rlike(pattern), value)
        return cases

    return let(F.lower(x), body)


def card_boosts(x: Column, rules: tuple[tuple[str, tuple[str, ...]], ...] = CARD_BOOSTS) -> Column:
    """FN32: ordered distinct anchors of all matching rules."""
    none = F.array().cast("array<string>")
    hits = [
        F.when(F.lower(x).rlike("(?U)" + p), F.array(*[F.lit(a) for a in anchors])).otherwise(none) for p, anchors in rules
    ]
    return F.array_distinct(F.flatten(F.array(*hits)))


def money_text(x: Column) -> Column:
    """FN26: amount as ``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", ".,"))


def percent_text(x: Column, digits: int = 1) -> Column:
    """FN26: percentage with a decimal comma."""
    return F.concat(F.translate(F.format_number(x, digits), ",.", ".,"), F.lit("%"))


def count_text(x: Column) -> Column:
    """FN26: whole number with thousands dots."""
    return F.translate(F.format_number(x, 0), ",", ".")
