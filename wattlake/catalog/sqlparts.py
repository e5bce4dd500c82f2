"""SQL fragments for the twins, written for DuckDB over the driver tables."""

from __future__ import annotations

import html.entities

from wattlake import bindings as b
from wattlake.functions import taxonomy as tax
from wattlake.functions import text as tx
from wattlake.functions import themes as th


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return squeeze(f"replace(lower(strip_accents({x})), 'ß', 'ss')")


# The same list of names as the library, looked up by DuckDB. Numbers need only chr(); the tests hold the odd ones against the standard.
_NAMES = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in html.entities.html5.items() if k.endswith(";")) + "}"
_BARE = "^(" + "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)) + ")"
_BARE_NAMES = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in html.entities.html5.items() if not k.endswith(";")) + "}"


def unescape(x: str) -> str:
    """References decoded once, for texts that hold an ampersand."""
    named, bare = "regexp_extract(p, '^[A-Za-z0-9]+;')", f"regexp_extract(p, {lit(_BARE)})"
    number = "regexp_extract(p, '^#([0-9]+);?', 1)"
    piece = (
        f"CASE WHEN {number} <> '' THEN chr({number}::INT) || regexp_replace(p, '^#[0-9]+;?', '') "
        f"WHEN {_NAMES}[{named}] IS NOT NULL THEN {_NAMES}[{named}] || substr(p, length({named}) + 1) "
        f"WHEN {bare} <> '' THEN {_BARE_NAMES}[{bare}] || substr(p, length({bare}) + 1) ELSE '&' || p END"
    )
    split = f"string_split({x}, '&')"
    return f"CASE WHEN contains({x}, '&') THEN {split}[1] || array_to_string(list_transform({split}[2:], lambda p: {piece}), '') ELSE {x} END"


def clean(x: str) -> str:
    return fold(f"regexp_replace({unescape(f"coalesce({x}, '')")}, '<[^>]+>', ' ', 'g')")


def modal(x: str) -> str:
    """Most frequent non-blank text, smallest on ties."""
    return (
        f"coalesce(list_sort(list_transform(map_entries(histogram(nullif(trim({x}), ''))), "
        "lambda e: {'n': -(e.value::BIGINT), 'k': e.key}))[1].k, '')"
    )


def case_contains(key: str, ladder, otherwise: str = "NULL") -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({key}, {lit(p)})" for p in parts) + f" THEN {lit(name)}"
        for name, parts in ladder
    )
    return f"CASE {whens} ELSE {otherwise} END"


def canonical_label(x: str) -> str:
    key = f"replace({fold(x)}, ' ', '_')"
    names = in_list(c.name for c in tax.CAUSE_CLASSES)
    low = f"lower(trim({x}))"
    tail = f"CASE WHEN {low} IN {names} THEN {low} END"
    return f"CASE WHEN {low} NOT IN ('', 'nan') THEN {case_contains(key, tax.LABEL_SUBSTRINGS, tail)} END"


def map_case(x: str, pairs, otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs) + f" ELSE {otherwise} END"


def category(x: str) -> str:
    return map_case(x, [(c.name, c.category) for c in tax.CAUSE_CLASSES], "'nao_classificada'")


def severity(x: str) -> str:
    return map_case(x, [(c.name, c.severity) for c in tax.CAUSE_CLASSES], "'low'")


def weight(x: str) -> str:
    return map_case(x, [(c.name, tax.SEVERITY_WEIGHT[c.severity]) for c in tax.CAUSE_CLASSES], "1.0")


def classifier_ctes(source: str) -> str:
    """CTE chain ``cls(txt, classe, confidence, probabilidade, score_bruto, top3)`` over ``source(txt)``."""
    scores = []
    for i, c in enumerate(tax.CAUSE_CLASSES):
        parts = [f"CASE WHEN contains(f, {lit(t)}) THEN {w} ELSE 0 END" for t, w in c.terms]
        parts += [f"CASE WHEN regexp_matches(f, {lit(p)}) THEN 2.0 ELSE 0 END" for p in c.patterns]
        total = "round(CAST(" + " + ".join(parts) + " AS DOUBLE), 4)"
        if c.negatives:
            bad = " OR ".join(f"contains(f, {lit(n)})" for n in c.negatives)
            total = f"CASE WHEN {bad} THEN 0.0::DOUBLE ELSE {total} END"
        scores.append(f"{{'score': {total}, 'rnk': {-i}, 'classe': {lit(c.name)}}}")
    short = in_list(tax.TRUNCATION_TOKENS)
    return f"""
cls_fold AS MATERIALIZED (SELECT txt, {fold("coalesce(txt, '')")} AS f FROM (SELECT DISTINCT txt FROM {source})),
cls_score AS MATERIALIZED (
  SELECT txt, f, list_sort([{", ".join(scores)}], 'DESC') AS s,
         list_filter(string_split(f, ' '), lambda w: w <> '') AS ws FROM cls_fold),
cls_pre AS (
  SELECT *, len(ws) AS nw, len(list_filter(ws, lambda w: w IN {short})) AS ns, s[1].score AS top, s[2].score AS sec
  FROM cls_score),
cls_lab AS (
  SELECT *, CASE WHEN f = '' THEN NULL
       WHEN regexp_matches(f, {lit(tax.RESOLUTION_PATTERN)}) AND NOT regexp_matches(f, {lit(tax.CAUSE_HINT_PATTERN)})
       THEN 'procedimento_administrativo'
       WHEN (length(f) <= 25 AND ns > 0) OR (nw <= 6 AND ns >= nw * 0.6) THEN 'texto_incompleto' END AS pre,
       (top < 0.6 OR (sec > 0 AND top < sec * 1.02)) AS undef,
       list_sum(list_transform(s, lambda e: e.score)) AS tot
  FROM cls_pre),
cls AS (
  SELECT txt, coalesce(pre, CASE WHEN undef THEN 'indefinido' ELSE s[1].classe END) AS classe,
         CASE WHEN pre IS NOT NULL THEN 'high' WHEN undef THEN 'indefinido'
              WHEN top >= 1.0 AND (sec <= 0 OR top >= sec * 1.05) THEN 'high' ELSE 'low' END AS confidence,
         CASE WHEN pre IS NOT NULL THEN 1.0 ELSE round(CASE WHEN tot > 0 THEN top / tot ELSE 1.0 / 18 END, 4) END
           AS probabilidade,
         CASE WHEN pre IS NOT NULL THEN 99.0 ELSE round(top, 2) END AS score_bruto,
         CASE WHEN pre IS NOT NULL THEN pre ELSE array_to_string(list_transform(s[1:3], lambda e: e.classe), '|') END
           AS top3
  FROM cls_lab)"""


def _picked(values, index: str) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], {index})"


COMPLAINTS = f"""
docs AS (SELECT doc_id, {clean("text")} AS obs FROM documents),
complaints0 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS ordem, l_linenumber AS linha,
    CASE WHEN r_name IN ('AFRICA','EUROPE') THEN 'CE' WHEN r_name IN ('AMERICA','ASIA') THEN 'SP' ELSE 'OUTRA' END
      AS _source_region,
    CASE o_orderstatus WHEN 'P' THEN 'reclamacao_total' WHEN 'O' THEN 'erro_leitura' ELSE 'base_n1_sp' END AS _data_type,
    o_orderdate AS dt_ingresso,
    nullif({_picked(b.LABELS, "CAST(replace(p_brand, 'Brand#', '') AS INTEGER)")}, '') AS causa_raiz,
    {_picked(b.SUBJECTS, "(CAST(o_orderpriority[1] AS INTEGER) - 1) * 3 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END")}
      AS assunto,
    CASE WHEN c_mktsegment IN ('BUILDING','HOUSEHOLD','FURNITURE') THEN 'GB' WHEN c_mktsegment = 'MACHINERY' THEN 'GA' END
      AS grupo,
    CASE o_orderstatus WHEN 'F' THEN 'ENCERRADA' WHEN 'O' THEN 'ABERTA' ELSE 'EM ANALISE' END AS status,
    CAST(o_custkey AS VARCHAR) AS instalacao, coalesce(obs, '') AS observacao_ordem,
    p_name || ' ' || coalesce({_picked(b.ANSWERS, "l_linenumber")}, '')
      || CASE WHEN l_returnflag = 'R' THEN ' refaturamento efetuado' ELSE '' END AS devolutiva
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey LEFT JOIN docs ON doc_id = o_orderkey),
complaints AS (
  SELECT *, trim(observacao_ordem || ' ' || devolutiva) AS texto_completo,
    contains(devolutiva, 'refatur') AS flag_resolvido_com_refaturamento,
    causa_raiz IS NOT NULL AND _source_region <> 'SP' AS has_causa_raiz_label
  FROM complaints0)"""

METERS = """
meter_rows AS (
  SELECT CAST(o_custkey AS VARCHAR) AS instalacao, p_type AS tipo, CAST(l_suppkey AS VARCHAR) AS equipamento
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
meter_rank AS (
  SELECT instalacao, tipo, row_number() OVER (PARTITION BY instalacao ORDER BY count(*) DESC, tipo) AS rn
  FROM meter_rows GROUP BY instalacao, tipo),
meter_profile AS (
  SELECT m.instalacao, max(r.tipo) AS tipo_medidor_dominante, count(DISTINCT m.tipo) > 1 AS instalacao_multi_tipo,
    CAST(count(DISTINCT equipamento) AS INTEGER) AS equipamentos_unicos,
    CAST(count(DISTINCT m.tipo) AS INTEGER) AS tipos_distintos
  FROM meter_rows m JOIN meter_rank r ON r.instalacao = m.instalacao AND rn = 1 GROUP BY m.instalacao)"""

INVOICES = f"""
invoice_profile AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS ordem, avg(l_extendedprice) AS valor_fatura_reclamada_medio,
    max(l_extendedprice) AS valor_fatura_reclamada_max,
    avg(date_diff('day', o_orderdate, l_shipdate)) AS dias_emissao_ate_reclamacao_medio,
    avg(date_diff('day', o_orderdate + INTERVAL 30 DAY, l_shipdate)) AS dias_vencimento_ate_reclamacao_medio,
    {modal("strftime(l_shipdate, '%Y-%m')")} AS fat_reclamada_top, count(*) AS qtd_faturas_reclamadas
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""

# DuckDB sometimes fails with an internal error on string functions over dictionary-encoded columns of a materialised
# CTE. Appending the text to an empty prefix of another column keeps every value and stores the columns plainly.
_FLAT = ", ".join(
    f"left(ordem, 0) || {c} AS {c}"
    for c in (
        "regiao", "tipo_origem", "causa_canonica", "causa_canonica_confidence", "status", "assunto", "grupo", "texto_completo",
        "devolutiva", "tipo_medidor_dominante", "topic_name", "topic_keywords",
    )
)
_TOPIC_TARGET = "CASE label " + " ".join(f"WHEN {t} THEN {lit(c)}" for t, c, _ in b.TOPIC_CAUSES) + " END"

FRAME = f"""{COMPLAINTS},
cause0 AS (SELECT *, {canonical_label("causa_raiz")} AS lab, _data_type <> 'reclamacao_total' AS train FROM complaints),
need AS (SELECT texto_completo AS txt FROM cause0 WHERE lab IS NULL AND train),
{classifier_ctes("need")},
outcome AS (SELECT CAST(doc_id AS VARCHAR) AS ordem, CASE quality WHEN 1 THEN 'PROCEDENTE' ELSE 'IMPROCEDENTE' END AS proc
            FROM labels),
{METERS},
{INVOICES},
frame_rows AS (
  SELECT c.ordem, c.linha, c.dt_ingresso AS data_ingresso, CAST(date_trunc('month', c.dt_ingresso) AS DATE) AS mes_ingresso,
    c._source_region AS regiao, c._data_type AS tipo_origem,
    CASE WHEN base_cause = 'indefinido' AND tgt IS NOT NULL THEN tgt ELSE base_cause END AS causa_canonica,
    CASE WHEN base_cause = 'indefinido' AND tgt IS NOT NULL THEN 'low' ELSE base_conf END AS causa_canonica_confidence,
    c.status, c.assunto, c.grupo, c.instalacao, c.texto_completo, c.observacao_ordem, c.devolutiva,
    c.flag_resolvido_com_refaturamento, c.has_causa_raiz_label, c.causa_raiz, c._source_region, c._data_type,
    coalesce(proc, 'NAO_INFORMADA') AS procedencia_real,
    proc IS NOT NULL AS procedencia_known,
    coalesce(proc = 'PROCEDENTE', c.flag_resolvido_com_refaturamento) AS procedente_real,
    substr(sha256(c.instalacao), 1, 12) AS instalacao_hash,
    tipo_medidor_dominante, instalacao_multi_tipo, equipamentos_unicos, tipos_distintos,
    valor_fatura_reclamada_medio, valor_fatura_reclamada_max, dias_emissao_ate_reclamacao_medio,
    dias_vencimento_ate_reclamacao_medio, fat_reclamada_top, qtd_faturas_reclamadas,
    valor_fatura_reclamada_medio IS NOT NULL AS perfil_fatura_disponivel,
    tipo_medidor_dominante IS NOT NULL AS perfil_medidor_disponivel,
    topic AS topic_id, coalesce('topico_' || topic, 'sem_topico') AS topic_name,
    CASE WHEN topic IS NULL THEN '' ELSE 'leitura, medidor do cliente, termo' || topic END AS topic_keywords
  FROM (
    SELECT x.*, coalesce(lab, CASE WHEN train THEN coalesce(classe, 'indefinido') ELSE 'reclamacao_total_sem_causa' END)
             AS base_cause,
      CASE WHEN lab IS NOT NULL THEN 'high' WHEN train THEN coalesce(confidence, 'indefinido') ELSE 'indefinido' END
             AS base_conf,
      CASE WHEN train THEN CAST(e.label AS VARCHAR) END AS topic,
      CASE WHEN train THEN {_TOPIC_TARGET} END AS tgt
    FROM cause0 x LEFT JOIN cls ON lab IS NULL AND train AND cls.txt = x.texto_completo
    LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = x.ordem) c
  LEFT JOIN outcome ON outcome.ordem = c.ordem
  LEFT JOIN meter_profile mp ON mp.instalacao = c.instalacao
  LEFT JOIN invoice_profile ip ON ip.ordem = c.ordem),
frame_all AS MATERIALIZED (SELECT * REPLACE ({_FLAT}) FROM frame_rows),
frame AS (SELECT * FROM frame_all WHERE regiao IN ('CE', 'SP')),
train AS (SELECT * FROM frame WHERE tipo_origem IN ('erro_leitura', 'base_n1_sp')),
sp AS (SELECT * FROM frame WHERE regiao = 'SP')"""


def over_frame(sql: str) -> str:
    """Full statement whose body may start with further CTEs (text ``, name AS (...)``) or with SELECT."""
    body = sql.strip()
    return f"WITH {FRAME}{'' if body.startswith(',') else ''}\n{body}"


def theme(x: str) -> str:
    return case_contains(f"upper(coalesce({x}, ''))", th.THEME_TOKENS, "'outros'")


def theme_label(x: str) -> str:
    return map_case(x, [(t, label) for t, label, _ in th.THEMES], "'Outros'")
