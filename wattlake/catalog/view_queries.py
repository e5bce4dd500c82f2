"""All registered views over the wide frame, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlake import bindings as b
from wattlake.catalog.base import add
from wattlake.catalog.sqlparts import (
    case_contains,
    category,
    fold,
    in_list,
    lit,
    map_case,
    modal,
    over_frame,
    severity,
    theme,
    theme_label,
    weight,
)
from wattlake.functions import taxonomy as tax
from wattlake.functions import themes as th
from wattlake.plans import surfaces, theme_views, views
from wattlake.plans import severity as sv
from wattlake.plans.registry import VIEWS, aggregate, parts_of

REFERENCE_DAY = "2002-01-01"


def rounded(df):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles}) if doubles else df


def view(view_id: str, sql: str, shape=None, **overrides) -> None:
    """Register a view under its id."""

    def run(spark, sf):
        spec = VIEWS[view_id]
        frame = b.scope(spark, sf, include_total=True, parts=spec.parts)
        if overrides:
            data = frame if spec.needs_totals else b.scope(spark, sf, include_total=False, parts=spec.parts)
            out = spec.run(data, **overrides)
        else:
            out = aggregate(frame, view_id)
        return rounded(shape(out) if shape else out)

    add(view_id, run, over_frame(sql))


RATE = "round(avg(flag_resolvido_com_refaturamento::INT), 6)"
N = "count(DISTINCT ordem)"

_KPIS = f"""SELECT count(*) AS total_registros, count(*) FILTER (tipo_origem IN ('erro_leitura','base_n1_sp')) AS total_erros,
  count(DISTINCT regiao) AS regioes, count(DISTINCT topic_name) FILTER (topic_name <> 'sem_topico') AS topicos,
  {RATE} AS taxa_refaturamento, round(avg(has_causa_raiz_label::INT), 6) AS taxa_rotulo_origem,
  (SELECT count(*) FROM (SELECT instalacao_hash FROM train GROUP BY 1 HAVING {N} > 1)) AS instalacoes_reincidentes
FROM train"""
view("kpis", _KPIS)
view("overview", _KPIS)
view(
    "top_assuntos",
    f"""SELECT assunto, {N} AS qtd_ordens, round({N} / (SELECT {N} FROM train), 6) AS percentual FROM train
GROUP BY assunto ORDER BY qtd_ordens DESC, assunto NULLS LAST LIMIT 12""",
)
view(
    "top_causas",
    f"""SELECT causa_canonica, {N} AS qtd_ordens, round({N} / (SELECT {N} FROM train), 6) AS percentual FROM train
GROUP BY causa_canonica ORDER BY qtd_ordens DESC, causa_canonica LIMIT 12""",
)
view(
    "refaturamento_summary",
    f"SELECT {N} AS total, CAST(sum(flag_resolvido_com_refaturamento::INT) AS BIGINT) AS refaturadas, "
    f"{RATE} AS taxa_refaturamento FROM train",
)
view(
    "by_group",
    f"""SELECT coalesce(grupo, '(nao informado)') AS grupo, {N} AS qtd_ordens,
round({N} / (SELECT {N} FROM train), 6) AS percentual FROM train GROUP BY 1 ORDER BY qtd_ordens DESC, grupo LIMIT 6""",
)
view("monthly_volume", f"SELECT mes_ingresso, regiao, {N} AS qtd_erros FROM train GROUP BY 1, 2")
view(
    "root_cause_distribution",
    f"""SELECT *, round(qtd_erros / sum(qtd_erros) OVER (), 6) AS percentual FROM (
SELECT causa_canonica, {N} AS qtd_erros, {RATE} AS taxa_refaturamento FROM train GROUP BY 1
ORDER BY qtd_erros DESC, causa_canonica LIMIT 12)""",
)
view(
    "region_cause_matrix",
    f"""SELECT causa_canonica, count(DISTINCT ordem) FILTER (regiao = 'CE') AS CE,
count(DISTINCT ordem) FILTER (regiao = 'SP') AS SP FROM train GROUP BY 1""",
)
view(
    "topic_distribution",
    f"""SELECT topic_name, topic_keywords, {N} AS qtd_erros, {RATE} AS taxa_refaturamento FROM train GROUP BY 1, 2
ORDER BY qtd_erros DESC, topic_name LIMIT 12""",
)
view(
    "refaturamento_by_cause",
    f"""SELECT causa_canonica, {N} AS qtd_erros, {RATE} AS taxa_refaturamento FROM train GROUP BY 1
ORDER BY avg(flag_resolvido_com_refaturamento::INT) DESC, qtd_erros DESC, causa_canonica LIMIT 10""",
)
view(
    "radar_causes_by_region",
    f""", c AS (SELECT regiao, causa_canonica, {N} AS q FROM train GROUP BY 1, 2),
t AS (SELECT causa_canonica FROM c GROUP BY 1 ORDER BY sum(q) DESC, causa_canonica LIMIT 10),
g AS (SELECT r.regiao, t.causa_canonica, CAST(coalesce(c.q, 0) AS BIGINT) AS qtd_erros
  FROM (SELECT DISTINCT regiao FROM c) r, t LEFT JOIN c ON c.regiao = r.regiao AND c.causa_canonica = t.causa_canonica)
SELECT *, round(qtd_erros / greatest(sum(qtd_erros) OVER (PARTITION BY regiao), 1), 6) AS percentual FROM g""",
)
view(
    "category_breakdown",
    f"""SELECT *, round(qtd_erros / sum(qtd_erros) OVER (PARTITION BY regiao), 6) AS percentual FROM (
SELECT {category("causa_canonica")} AS categoria, regiao, {N} AS qtd_erros FROM train GROUP BY 1, 2)""",
)
_HEATMAP = f"""SELECT regiao, {severity("causa_canonica")} AS severidade, {N} AS qtd_erros,
{RATE} AS taxa_refaturamento FROM train GROUP BY 1, 2"""
view("severity_heatmap", _HEATMAP)
_MIS = f""", rep AS (SELECT regiao, count(*) FILTER (n > 1) AS k FROM (
  SELECT regiao, instalacao_hash, {N} AS n FROM train GROUP BY 1, 2) GROUP BY 1),
lead1 AS (SELECT * FROM (SELECT regiao, causa_canonica, {N} AS n,
  row_number() OVER (PARTITION BY regiao ORDER BY {N} DESC, causa_canonica) AS rn FROM train GROUP BY 1, 2) WHERE rn = 1),
agg AS (SELECT regiao, {N} AS volume_total, {RATE} AS taxa_refaturamento,
  round(avg(has_causa_raiz_label::INT), 6) AS cobertura_rotulo, round(avg({weight("causa_canonica")}), 2) AS severidade_media,
  round(avg(({severity("causa_canonica")} = 'critical')::INT), 6) AS share_critico FROM train GROUP BY 1)
SELECT regiao, volume_total, taxa_refaturamento, cobertura_rotulo, k AS instalacoes_reincidentes,
  causa_canonica AS causa_dominante, round(n / volume_total, 6) AS share_causa_dominante, severidade_media, share_critico
FROM agg JOIN rep USING (regiao) JOIN lead1 USING (regiao)"""
view("mis", _MIS)
view("mis_executive_summary", _MIS)
_TREND = f"""SELECT mes_ingresso, regiao, qtd_erros,
round(coalesce((qtd_erros - lag(qtd_erros) OVER w) / lag(qtd_erros) OVER w, 0), 6) AS mom,
round(avg(qtd_erros) OVER (PARTITION BY regiao ORDER BY mes_ingresso ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)
  AS media_movel_3m
FROM (SELECT mes_ingresso, regiao, {N} AS qtd_erros FROM train GROUP BY 1, 2)
WINDOW w AS (PARTITION BY regiao ORDER BY mes_ingresso)"""
view("mis_monthly_mis", _TREND)
BUCKET = "CASE WHEN n <= 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' WHEN n <= 9 THEN '5-9' ELSE '10+' END"
view(
    "reincidence_matrix",
    f"""SELECT regiao, {BUCKET} AS faixa, count(*) AS qtd_instalacoes FROM (
SELECT regiao, instalacao_hash, {N} AS n FROM train GROUP BY 1, 2) GROUP BY 1, 2""",
)
view(
    "classifier_coverage",
    f""", t AS (SELECT regiao, {N} AS tot, count(DISTINCT ordem) FILTER (causa_canonica = 'indefinido') AS ind
  FROM train GROUP BY 1)
SELECT regiao, causa_canonica_confidence, {N} AS qtd_ordens, round({N} / any_value(tot), 6) AS percentual,
  any_value(ind) AS indefinidos, round(any_value(ind) / any_value(tot), 6) AS indefinido_pct
FROM train JOIN t USING (regiao) GROUP BY 1, 2""",
)
view(
    "classifier_indefinido_tokens",
    f""", x AS MATERIALIZED (SELECT topic_keywords || ' . ' || coalesce(assunto, '') AS t, count(*) AS n FROM train
  WHERE causa_canonica = 'indefinido' GROUP BY 1),
y AS MATERIALIZED (SELECT regexp_extract_all({fold("t")}, '\\b[a-z0-9_]{{3,}}\\b') AS ws, n FROM x),
z AS MATERIALIZED (SELECT ws[i] AS token, n FROM y JOIN range(1, 60) r(i) ON i <= len(ws))
SELECT token, CAST(sum(n) AS BIGINT) AS qtd_ocorrencias FROM z WHERE token NOT IN {in_list(views.TOKEN_STOPWORDS)}
GROUP BY 1 ORDER BY qtd_ocorrencias DESC, token LIMIT 20""",
)
_TAX_ROWS = ", ".join(
    f"({lit(c.name)}, {lit(c.category)}, {lit(c.severity)}, {tax.SEVERITY_WEIGHT[c.severity]}::DOUBLE, "
    f"{lit(c.description)}, {len(c.terms)})"
    for c in tax.CAUSE_CLASSES
)
view(
    "taxonomy_reference",
    f"""SELECT classe, categoria, severidade, peso_severidade, descricao, n_keywords, coalesce(n, 0) AS qtd_ordens
FROM (VALUES {_TAX_ROWS}) v(classe, categoria, severidade, peso_severidade, descricao, n_keywords)
LEFT JOIN (SELECT causa_canonica, {N} AS n FROM train GROUP BY 1) ON classe = causa_canonica""",
)
view(
    "top_instalacoes",
    f"""SELECT instalacao, {N} AS qtd_ordens, {modal("assunto")} AS assunto_top, {modal("causa_canonica")} AS causa_top,
{RATE} AS taxa_refaturamento, {modal("tipo_medidor_dominante")} AS tipo_medidor_dominante,
bool_or(instalacao_multi_tipo) AS instalacao_multi_tipo FROM train GROUP BY 1 ORDER BY qtd_ordens DESC, instalacao LIMIT 20""",
)
view(
    "top_instalacoes_por_regional",
    f"""SELECT regiao, instalacao, qtd_ordens, assunto_top, tipo_medidor_dominante FROM (
SELECT regiao, instalacao, {N} AS qtd_ordens, {modal("assunto")} AS assunto_top,
{modal("tipo_medidor_dominante")} AS tipo_medidor_dominante,
row_number() OVER (PARTITION BY regiao ORDER BY {N} DESC, instalacao) AS rn FROM train GROUP BY 1, 2) WHERE rn <= 5""",
)
DIGIT = "(contains(lower(causa_canonica), 'digit') OR contains(lower(texto_completo), 'digit'))"
view(
    "top_instalacoes_digitacao",
    f"""SELECT regiao, instalacao, {N} AS qtd_ordens, {modal("assunto")} AS assunto_top,
{modal("tipo_medidor_dominante")} AS tipo_medidor_dominante FROM train WHERE {DIGIT} GROUP BY 1, 2
ORDER BY qtd_ordens DESC, regiao, instalacao LIMIT 20""",
)


def _meter_types(where: str, limit: int) -> str:
    return f""", m AS (SELECT * FROM train WHERE regiao = 'SP' AND trim(tipo_medidor_dominante) <> '' AND {where})
SELECT 'SP' AS regiao, tipo_medidor_dominante, {N} AS qtd_ordens, count(DISTINCT instalacao) AS qtd_instalacoes,
round({N} / (SELECT {N} FROM m), 6) AS percentual FROM m GROUP BY 2 ORDER BY qtd_ordens DESC, 2 LIMIT {limit}"""


view("sp_tipos_medidor", _meter_types("true", 12))
view("sp_tipos_medidor_digitacao", _meter_types(DIGIT, 10))
view(
    "sp_causas_por_tipo_medidor",
    f""", m AS (SELECT * FROM train WHERE regiao = 'SP' AND trim(tipo_medidor_dominante) <> ''),
t AS (SELECT tipo_medidor_dominante, {N} AS qtd_total_tipo FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
SELECT * FROM (SELECT 'SP' AS regiao, tipo_medidor_dominante, causa_canonica, {N} AS qtd_ordens,
  any_value(qtd_total_tipo) AS qtd_total_tipo, round({N} / any_value(qtd_total_tipo), 6) AS percentual_no_tipo,
  CAST(row_number() OVER (PARTITION BY tipo_medidor_dominante ORDER BY {N} DESC, causa_canonica) AS INTEGER) AS rank
  FROM m JOIN t USING (tipo_medidor_dominante) GROUP BY 2, 3) WHERE rank <= 5""",
)
INV = """round(avg(valor_fatura_reclamada_medio), 6) AS valor_fatura_reclamada_medio,
max(valor_fatura_reclamada_max) AS valor_fatura_reclamada_max,
round(avg(dias_emissao_ate_reclamacao_medio), 6) AS dias_emissao_ate_reclamacao_medio"""
DUE = "round(avg(dias_vencimento_ate_reclamacao_medio), 6) AS dias_vencimento_ate_reclamacao_medio"
view(
    "sp_faturas_altas",
    f"""SELECT 'SP' AS regiao, instalacao, fat_reclamada_top, {INV}, {DUE}, {modal("tipo_medidor_dominante")}
AS tipo_medidor_dominante, {modal("assunto")} AS assunto_top, {modal("causa_canonica")} AS causa_top, {N} AS qtd_ordens
FROM train WHERE regiao = 'SP' AND fat_reclamada_top <> '' GROUP BY 2, 3
ORDER BY valor_fatura_reclamada_max DESC, instalacao, fat_reclamada_top LIMIT 10""",
)
_SPM = "FROM train WHERE regiao = 'SP' AND trim(tipo_medidor_dominante) <> ''"
view(
    "sp_fatura_medidor",
    f"""SELECT 'SP' AS regiao, tipo_medidor_dominante, {N} AS qtd_ordens, count(DISTINCT instalacao) AS qtd_instalacoes,
{INV}, {DUE}, {modal("assunto")} AS assunto_top, {modal("causa_canonica")} AS causa_top {_SPM} GROUP BY 2
ORDER BY qtd_ordens DESC, valor_fatura_reclamada_max DESC, 2 LIMIT 12""",
)
view(
    "sp_digitacao_fatura_medidor",
    f"""SELECT 'SP' AS regiao, tipo_medidor_dominante, {N} AS qtd_ordens, count(DISTINCT instalacao) AS qtd_instalacoes,
{INV}, {DUE}, {modal("assunto")} AS assunto_top {_SPM} AND {DIGIT} GROUP BY 2
ORDER BY qtd_ordens DESC, valor_fatura_reclamada_max DESC, 2 LIMIT 12""",
)
view(
    "sp_medidores_problema_reclamacao",
    f"""SELECT 'SP' AS regiao, tipo_medidor_dominante, {modal("assunto")} AS assunto_top, {modal("causa_canonica")}
AS causa_top, {N} AS qtd_ordens, count(DISTINCT instalacao) AS qtd_instalacoes, {INV} {_SPM} GROUP BY 2
ORDER BY qtd_ordens DESC, qtd_instalacoes DESC, 2 LIMIT 12""",
)
view(
    "ce_total_assunto_causa",
    f""", r AS (SELECT ordem, trim(assunto) AS assunto, causa_canonica FROM frame WHERE regiao = 'CE'
  AND tipo_origem = 'reclamacao_total' AND trim(assunto) <> ''),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY qtd_assunto DESC, assunto) AS INTEGER) AS rank_assunto FROM (
  SELECT assunto, {N} AS qtd_assunto FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6))
SELECT * FROM (SELECT 'CE' AS regiao, assunto, causa_canonica, {N} AS qtd_ordens, any_value(qtd_assunto) AS qtd_assunto,
  round({N} / any_value(qtd_assunto), 6) AS percentual_no_assunto, any_value(rank_assunto) AS rank_assunto,
  CAST(row_number() OVER (PARTITION BY assunto ORDER BY {N} DESC, causa_canonica) AS INTEGER) AS rank_causa
  FROM r JOIN t USING (assunto) GROUP BY 2, 3) WHERE rank_causa <= 4""",
)
view(
    "motivos_taxonomia",
    f""", r AS (SELECT ordem, regiao, trim(assunto) AS assunto, causa_canonica FROM train WHERE trim(assunto) <> '')
SELECT regiao, assunto, causa_canonica, assunto || ' | ' || causa_canonica AS motivo_taxonomia, {N} AS qtd_ordens,
round({N} / (SELECT {N} FROM r), 6) AS percentual FROM r GROUP BY 1, 2, 3
ORDER BY qtd_ordens DESC, regiao, assunto, causa_canonica LIMIT 20""",
)


def _monthly(key: str, where: str) -> str:
    return f""", c AS (SELECT mes_ingresso, {key}, {N} AS qtd_ordens,
  CAST(row_number() OVER (PARTITION BY mes_ingresso ORDER BY {N} DESC, {key}) AS INTEGER) AS rank
  FROM train WHERE {where} GROUP BY 1, 2)
SELECT * FROM c WHERE rank <= 3 AND mes_ingresso IN (SELECT DISTINCT mes_ingresso FROM c ORDER BY 1 DESC LIMIT 18)"""


view("monthly_assunto_breakdown", _monthly("assunto", "assunto IS NOT NULL"))
view(
    "monthly_causa_breakdown",
    _monthly("causa_canonica", "has_causa_raiz_label AND NOT contains(lower(causa_canonica), 'sem_causa')"),
)
view(
    "sp_causa_observacoes",
    f""", s AS (SELECT * FROM train WHERE regiao = 'SP'),
l AS (SELECT causa_canonica AS c FROM s GROUP BY 1 ORDER BY (causa_canonica = 'indefinido'), {N} DESC, 1 LIMIT 1),
o AS (SELECT DISTINCT trim(texto_completo) AS t FROM s JOIN l ON causa_canonica = c WHERE trim(texto_completo) <> ''
  ORDER BY 1 LIMIT 3)
SELECT 'SP' AS regiao, c AS causa_lider, {N} AS qtd_ordens, round({N} / (SELECT {N} FROM s), 6) AS percentual,
{modal("assunto")} AS assunto_top, (SELECT string_agg(x, ' | ' ORDER BY x) FROM (SELECT substr(t, 1, 180) AS x FROM o))
AS observacoes_exemplo FROM s JOIN l ON causa_canonica = c GROUP BY c""",
)
view(
    "sp_perfil_assunto_lider",
    f""", s AS (SELECT * FROM train WHERE regiao = 'SP'),
l AS (SELECT assunto AS a FROM s WHERE assunto IS NOT NULL GROUP BY 1 ORDER BY {N} DESC, 1 LIMIT 1)
SELECT 'SP' AS regiao, a AS assunto_lider, {N} AS qtd_ordens, round({N} / (SELECT {N} FROM s), 6) AS percentual,
{modal("fat_reclamada_top")} AS fat_reclamada_top,
round(avg(dias_emissao_ate_reclamacao_medio), 6) AS dias_emissao_ate_reclamacao_medio,
{modal("tipo_medidor_dominante")} AS tipo_medidor_dominante,
round(avg(valor_fatura_reclamada_medio), 6) AS valor_fatura_reclamada_medio,
round(avg(perfil_fatura_disponivel::INT), 6) AS cobertura_fatura_pct,
round(avg(perfil_medidor_disponivel::INT), 6) AS cobertura_medidor_pct
FROM s JOIN l ON assunto = a GROUP BY a""",
)
view(
    "sazonalidade_reclamacoes",
    f"""SELECT regiao, strftime(mes_ingresso, '%Y-%m') AS mes_pico, q AS qtd_pico, round(m, 6) AS media_mensal,
round(q / m, 6) AS indice_sazonal_pico FROM (SELECT *, avg(q) OVER (PARTITION BY regiao) AS m,
row_number() OVER (PARTITION BY regiao ORDER BY q DESC, mes_ingresso) AS rn FROM (
SELECT regiao, mes_ingresso, {N} AS q FROM train GROUP BY 1, 2)) WHERE rn = 1""",
)
view(
    "reincidencia_por_assunto",
    f""", r AS (SELECT ordem, instalacao, trim(assunto) AS assunto FROM train WHERE trim(assunto) <> ''),
i AS (SELECT assunto, count(*) AS qtd_instalacoes, count(*) FILTER (n >= 2) AS k FROM (
  SELECT assunto, instalacao, {N} AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT assunto, {N} AS qtd_ordens, any_value(qtd_instalacoes) AS qtd_instalacoes,
any_value(k) AS qtd_instalacoes_reincidentes, round(any_value(k) / any_value(qtd_instalacoes), 6) AS taxa_reincidencia
FROM r JOIN i USING (assunto) GROUP BY 1
ORDER BY any_value(k) / any_value(qtd_instalacoes) DESC, qtd_instalacoes_reincidentes DESC, assunto LIMIT 12""",
)
_PLAY = [(p, a) for p, a, _ in th.PLAYBOOK]
view(
    "playbook_dificuldade_acoes",
    f""", p AS (SELECT
  (SELECT assunto FROM train WHERE assunto IS NOT NULL GROUP BY 1 ORDER BY {N} DESC, 1 LIMIT 1) AS a,
  (SELECT causa_canonica FROM train GROUP BY 1 ORDER BY {N} DESC, 1 LIMIT 1) AS c)
SELECT a || ' / ' || c AS dificuldade_principal,
{case_contains("lower(a || ' ' || c)", [(act, (p,)) for p, act, _ in th.PLAYBOOK], lit(th.PLAYBOOK_DEFAULT[0]))}
AS medida_recomendada,
{case_contains("lower(a || ' ' || c)", [(pri, (p,)) for p, _, pri in th.PLAYBOOK], lit(th.PLAYBOOK_DEFAULT[1]))}
AS prioridade FROM p""",
)
view(
    "governance_health",
    f""", g AS (SELECT count(*) AS n, count(DISTINCT regiao) AS r, avg((trim(causa_canonica) <> '')::INT) AS c,
  avg((trim(topic_name) <> '')::INT) AS t, CAST(max(data_ingresso) AS DATE) AS d FROM train),
h AS (SELECT *, date_diff('day', d, DATE '{REFERENCE_DAY}') AS k FROM g)
SELECT 'Volume carregado' AS label, replace(format('{{:,}}', n), ',', '.') AS value, r || ' regiões' AS sub,
  CASE WHEN n > 0 THEN 'ok' ELSE 'crit' END AS status FROM h
UNION ALL SELECT 'Cobertura taxonomia', format('{{:.1f}}%', c * 100), 'causa_canonica não-vazia',
  CASE WHEN c >= 0.85 THEN 'ok' WHEN c >= 0.6 THEN 'warn' ELSE 'crit' END FROM h
UNION ALL SELECT 'Cobertura tópicos ML', format('{{:.1f}}%', t * 100), 'topic_name não-vazio',
  CASE WHEN t >= 0.8 THEN 'ok' WHEN t >= 0.5 THEN 'warn' ELSE 'crit' END FROM h
UNION ALL SELECT 'Frescor do dataset', CAST(d AS VARCHAR), 'há ' || k || ' dias',
  CASE WHEN k <= 7 THEN 'ok' WHEN k <= 30 THEN 'warn' ELSE 'crit' END FROM h""",
    reference=REFERENCE_DAY,
)

# ---- severity views -------------------------------------------------------------------------------------------
_SEV = f""", sev0 AS (SELECT *, {category("causa_canonica")} AS categoria, {severity("causa_canonica")} AS severidade
  FROM train WHERE regiao = 'SP' AND causa_canonica_confidence = 'high')"""


def _scope(names: list[str]) -> str:
    return f"{_SEV}, s AS (SELECT * FROM sev0 WHERE severidade IN {in_list(names)})"


view(
    "sp_severidade_distribution",
    f"""{_SEV}, o AS (SELECT severidade, ordem, bool_or(procedente_real) AS p FROM sev0 GROUP BY 1, 2),
d AS (SELECT v.severidade, count(ordem) AS q, count(*) FILTER (p) AS p FROM (VALUES ('critical'), ('high'), ('medium'),
  ('low')) v(severidade) LEFT JOIN o ON o.severidade = v.severidade GROUP BY 1)
SELECT severidade, q AS qtd_erros, p AS procedentes, q - p AS improcedentes, round(q / (SELECT sum(q) FROM d), 4) AS pct
FROM d""",
)
ACTION_CASE = "CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in th.ACTIONS.items()) + (
    " ELSE CASE WHEN {p} THEN " + lit(th.ACTION_VALID) + " ELSE " + lit(th.ACTION_INVALID) + " END END"
)


def excerpt(x: str) -> str:
    sq = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    return (
        f"CASE WHEN length({sq}) <= 220 THEN {sq} ELSE regexp_replace(substr({sq}, 1, 219), ' [^ ]*$', '') || '…' END"
    )


TITLE = (
    "array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
    "lambda w: upper(w[1]) || substr(w, 2)), ' ')"
)


def _tree(names: list[str]) -> str:
    return f"""{_scope(names)}, ct AS (SELECT categoria, {N} AS categoria_qtd FROM s GROUP BY 1),
h AS (SELECT * FROM ct ORDER BY 2 DESC, 1 LIMIT 8),
ex AS (SELECT * FROM (SELECT categoria, causa_canonica, ordem, trim(texto_completo) AS t, data_ingresso,
  procedente_real AS p, valor_fatura_reclamada_medio AS v, row_number() OVER (PARTITION BY categoria, causa_canonica
  ORDER BY valor_fatura_reclamada_medio DESC, ordem, trim(texto_completo), procedente_real) AS rn
  FROM s WHERE trim(texto_completo) <> '') WHERE rn = 1),
k AS (SELECT categoria, causa_canonica, {N} AS qtd, count(*) FILTER (procedente_real) AS pr,
  row_number() OVER (PARTITION BY categoria ORDER BY {N} DESC, causa_canonica) AS rn FROM s GROUP BY 1, 2)
SELECT k.categoria AS categoria_id, {TITLE.format(x="k.categoria")} AS categoria_label, categoria_qtd,
  round(categoria_qtd / (SELECT sum(categoria_qtd) FROM ct) * 100, 2) AS categoria_pct,
  k.causa_canonica AS subcausa_id, k.causa_canonica AS subcausa_label, qtd,
  round(qtd / categoria_qtd * 100, 2) AS percentual_na_categoria, pr AS procedentes, qtd - pr AS improcedentes,
  'ORD-' || ex.ordem AS exemplo_id, strftime(data_ingresso, '%Y-%m-%d') AS exemplo_data,
  {excerpt("t")} AS exemplo_descricao, CASE WHEN p THEN 'procedente' ELSE 'improcedente' END AS exemplo_status,
  round(v, 6) AS exemplo_valor_fatura, {ACTION_CASE.format(c="k.causa_canonica", p="pr > qtd - pr")}
  AS recomendacao_operacional
FROM k JOIN h USING (categoria) LEFT JOIN ex ON ex.categoria = k.categoria AND ex.causa_canonica = k.causa_canonica
WHERE k.rn <= 6"""


def _spark_text(df):
    return df.withColumn("spark", F.concat_ws(",", F.transform("spark", lambda x: x.cast("string"))))


def _inst_text(df):
    return df.withColumn(
        "top_instalacoes",
        F.concat_ws(
            ";",
            F.transform(
                "top_instalacoes", lambda e: F.concat_ws(":", e["inst"], e["reinc"].cast("string"), e["cidade"])
            ),
        ),
    )


for _name, _names in (("alta", ["high"]), ("critica", ["critical"]), ("demais", ["medium", "low"])):
    _S = _scope(_names)
    view(
        f"sp_severidade_{_name}_overview",
        f"""{_S}, o AS (SELECT ordem, bool_or(procedente_real) AS p FROM s GROUP BY 1),
t AS (SELECT count(*) AS total, count(*) FILTER (p) AS pr FROM o),
m AS (SELECT mes_ingresso, {N} AS n, row_number() OVER (ORDER BY mes_ingresso DESC) AS r FROM s GROUP BY 1),
q AS (SELECT sum(n) FILTER (r <= 3) AS a, sum(n) FILTER (r BETWEEN 4 AND 6) AS b, count(*) AS k FROM m)
SELECT total, pr AS procedentes, total - pr AS improcedentes, round(pr / total, 4) AS pct_procedentes,
  (SELECT count(*) FROM (SELECT instalacao_hash FROM s GROUP BY 1 HAVING {N} > 1)) AS reincidentes_clientes,
  round((SELECT avg(valor_fatura_reclamada_medio) FROM s), 2) AS valor_medio_fatura,
  (SELECT count(DISTINCT categoria) FROM s) AS categorias_count,
  round((SELECT sum(n) FROM (SELECT {N} AS n FROM s GROUP BY categoria ORDER BY 1 DESC LIMIT 3)) / total, 4) AS top3_share,
  round(CASE WHEN k >= 6 THEN (a - b) / b ELSE 0 END, 4) AS delta_trimestre FROM t, q""",
    )
    view(
        f"sp_severidade_{_name}_mensal",
        f"""{_S} SELECT CAST(mes_ingresso AS VARCHAR) AS mes_ingresso, {N} AS qtd_erros,
count(*) FILTER (procedente_real) AS procedentes, {N} - count(*) FILTER (procedente_real) AS improcedentes
FROM s GROUP BY 1""",
    )
    view(
        f"sp_severidade_{_name}_categorias",
        f"""{_S}, c AS (SELECT categoria, {N} AS vol, row_number() OVER (ORDER BY {N} DESC, categoria) AS rn FROM s GROUP BY 1),
t AS (SELECT sum(vol) AS t FROM c)
SELECT categoria AS categoria_id, categoria, vol, round(vol / t * 100, 2) AS pct FROM c, t WHERE rn <= 2
UNION ALL SELECT 'outros', 'Demais (' || count(*) || ')', CAST(sum(vol) AS BIGINT), round(sum(vol) / any_value(t) * 100, 2)
FROM c, t WHERE rn > 2 HAVING count(*) > 0""",
        limit=2,
    )
    view(
        f"sp_severidade_{_name}_causas",
        f"""{_S}, r AS (SELECT causa_canonica, count(*) FILTER (n > 1) AS k FROM (SELECT causa_canonica, instalacao_hash,
  {N} AS n FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT 'c' || lpad(CAST(row_number() OVER (ORDER BY vol DESC, nome) AS VARCHAR), 2, '0') AS id, nome, vol, proc, reinc, cat
FROM (SELECT causa_canonica AS nome, {N} AS vol, round(avg(procedente_real::INT) * 100, 2) AS proc, any_value(k) AS reinc,
  min(categoria) AS cat FROM s JOIN r USING (causa_canonica) GROUP BY 1 ORDER BY vol DESC, nome LIMIT 14)""",
    )
    view(
        f"sp_severidade_{_name}_ranking",
        f"""{_S}, l AS (SELECT instalacao_hash, {N} AS reinc FROM s GROUP BY 1 HAVING {N} > 1 ORDER BY 2 DESC, 1 LIMIT 10),
mm AS (SELECT instalacao_hash, mes_ingresso, {N} AS n, row_number() OVER (PARTITION BY instalacao_hash
  ORDER BY mes_ingresso DESC) AS r FROM s JOIN l USING (instalacao_hash) GROUP BY 1, 2),
sp9 AS (SELECT instalacao_hash, list(n ORDER BY mes_ingresso) AS a FROM mm WHERE r <= 9 GROUP BY 1)
SELECT max(instalacao) AS inst, {modal("categoria")} AS cat, {modal("causa_canonica")} AS causa, any_value(reinc) AS reinc,
round(avg(valor_fatura_reclamada_medio), 6) AS valor,
any_value(array_to_string(list_concat(list_transform(range(9 - len(a)), lambda x: 0), a), ',')) AS spark, 'SP/SP' AS cidade
FROM s JOIN l USING (instalacao_hash) JOIN sp9 USING (instalacao_hash) GROUP BY instalacao_hash""",
        shape=_spark_text,
    )
    view(
        f"sp_severidade_{_name}_descricoes",
        f"""{_S}, w AS (SELECT *, trim(texto_completo
    || CASE WHEN topic_name <> '' AND topic_name <> texto_completo THEN ' — ' || topic_name ELSE '' END
    || CASE WHEN topic_keywords <> '' THEN ' — ' || replace(topic_keywords, ',', ', ') ELSE '' END) AS t FROM s
  WHERE texto_completo <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY ordem ORDER BY valor_fatura_reclamada_medio DESC, length(t), t,
  causa_canonica) AS rn FROM w),
p AS (SELECT * FROM o WHERE rn = 1 ORDER BY valor_fatura_reclamada_medio DESC, length(t), ordem LIMIT 10),
i AS (SELECT causa_canonica, instalacao_hash, max(instalacao) AS inst, {N} AS reinc, row_number() OVER (
  PARTITION BY causa_canonica ORDER BY {N} DESC, instalacao_hash) AS r FROM s GROUP BY 1, 2),
il AS (SELECT causa_canonica, string_agg(inst || ':' || reinc || ':SP', ';' ORDER BY r) AS top_instalacoes FROM i
  WHERE r <= 10 GROUP BY 1)
SELECT 'ORD-' || ordem AS id, {TITLE.format(x="categoria")} AS cat, categoria AS categoria_id, causa_canonica AS causa,
strftime(data_ingresso, '%Y-%m-%d') AS data, flag_resolvido_com_refaturamento AS proc,
round(valor_fatura_reclamada_medio, 6) AS valor, {excerpt("t")} AS resumo,
{ACTION_CASE.format(c="causa_canonica", p="flag_resolvido_com_refaturamento")} AS sugestao,
{map_case("categoria", th.AREAS.items(), lit(th.AREA_DEFAULT))} AS area, top_instalacoes
FROM p JOIN il USING (causa_canonica)""",
        shape=_inst_text,
    )
    view(f"sp_categoria_subcausa_tree_{_name}", _tree(_names))
view("sp_categoria_subcausa_tree", _tree(list(tax.SEVERITY_ORDER)))

# ---- CE theme views -------------------------------------------------------------------------------------------
_CE0 = f""", ce0 AS (SELECT *, upper(trim(coalesce(assunto, '(sem assunto)'))) AS assunto_clean FROM frame
  WHERE _source_region = 'CE' AND _data_type = 'reclamacao_total'),
ce1 AS (SELECT *, {theme("assunto_clean")} AS macro_tema FROM ce0),
ce AS (SELECT *, {theme_label("macro_tema")} AS macro_tema_label, strftime(dt, '%Y-%m') AS ano_mes,
  coalesce(nullif(upper(trim(grupo)), ''), 'ND') AS grupo_norm, trim(coalesce(causa_raiz, '')) AS causa_raiz_clean
  FROM (SELECT *, data_ingresso AS dt FROM ce1))"""


def ce_query(name: str, fn, sql: str) -> None:
    add(
        name,
        lambda spark, sf: rounded(fn(theme_views.prepare(b.scope(spark, sf, parts=parts_of(name))))),
        over_frame(_CE0 + sql),
    )


view(
    "ce_macro_distribution",
    _CE0 + """ SELECT macro_tema, macro_tema_label, count(*) AS qtd, round(count(*) / (SELECT count(*) FROM ce), 6)
AS percentual FROM ce GROUP BY 1, 2""",
)
view(
    "ce_monthly_trend_by_tema",
    _CE0 + """ SELECT ano_mes, macro_tema_label, qtd, round((qtd - lag(qtd) OVER w) / lag(qtd) OVER w, 6) AS mom,
round(avg(qtd) OVER (PARTITION BY macro_tema_label ORDER BY ano_mes ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)
AS media_movel_3m FROM (SELECT ano_mes, macro_tema_label, count(*) AS qtd FROM ce GROUP BY 1, 2)
WINDOW w AS (PARTITION BY macro_tema_label ORDER BY ano_mes)""",
)
view(
    "ce_cruzamento_erro_leitura",
    _CE0 + """, e AS (SELECT DISTINCT instalacao_hash FROM frame WHERE _source_region = 'CE'
  AND _data_type <> 'reclamacao_total')
SELECT macro_tema_label, count(*) FILTER (instalacao_hash IN (SELECT instalacao_hash FROM e)) AS qtd_com_erro_leitura,
count(*) AS qtd_total, round(count(*) FILTER (instalacao_hash IN (SELECT instalacao_hash FROM e)) / count(*), 6) AS percentual
FROM ce GROUP BY 1""",
)
_CEK = """, pi AS (SELECT instalacao_hash, count(*) AS n FROM ce GROUP BY 1),
ld AS (SELECT macro_tema_label AS tema, count(*) AS n FROM ce GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
k AS (SELECT count(*) AS total_reclamacoes, avg((grupo_norm = 'GB')::INT) AS share_grupo_b,
  avg((causa_raiz_clean <> '')::INT) AS taxa_rotulo_causa_raiz, count(DISTINCT assunto_clean) AS assuntos_distintos,
  count(DISTINCT ano_mes) AS meses_cobertos, (SELECT count(*) FROM pi) AS unique_instalacoes,
  (SELECT count(*) FROM pi WHERE n >= 2) AS instalacoes_reincidentes, (SELECT tema FROM ld) AS tema_dominante,
  (SELECT n FROM ld) / count(*) AS share_tema_dominante FROM ce)"""
ce_query(
    "ce_kpis", theme_views.kpis,
    _CEK + """ SELECT * REPLACE (round(share_grupo_b, 6) AS share_grupo_b, round(taxa_rotulo_causa_raiz, 6)
AS taxa_rotulo_causa_raiz, round(share_tema_dominante, 6) AS share_tema_dominante) FROM k""",
)
ce_query(
    "ce_executive_table", theme_views.executive_table,
    _CEK + """ SELECT unnest(['Volume total', 'Instalações únicas', 'Instalações reincidentes (≥2)', '% Grupo B',
'Cobertura de causa-raiz', 'Tema dominante', 'Share do tema dominante', 'Assuntos distintos', 'Meses cobertos']) AS metrica,
unnest([replace(format('{:,}', total_reclamacoes), ',', '.'), replace(format('{:,}', unique_instalacoes), ',', '.'),
replace(format('{:,}', instalacoes_reincidentes), ',', '.'), format('{:.1f}%', share_grupo_b * 100),
format('{:.1f}%', taxa_rotulo_causa_raiz * 100), tema_dominante, format('{:.1f}%', share_tema_dominante * 100),
CAST(assuntos_distintos AS VARCHAR), CAST(meses_cobertos AS VARCHAR)]) AS valor FROM k""",
)
ce_query(
    "ce_subject_pareto", theme_views.pareto,
    """ SELECT assunto, qtd, round(p, 6) AS percentual, round(sum(p) OVER (ORDER BY qtd DESC, assunto
ROWS UNBOUNDED PRECEDING), 6) AS acumulado_pct FROM (SELECT assunto_clean AS assunto, count(*) AS qtd,
count(*) * 100 / (SELECT count(*) FROM ce) AS p FROM ce GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""",
)
ce_query(
    "ce_cause_drill", lambda ce: theme_views.cause_drill(ce, "refaturamento"),
    """ SELECT causa_raiz_clean AS causa_raiz, count(*) AS qtd, round(count(*) * 100 / (SELECT count(*) FROM ce
WHERE causa_raiz_clean <> '' AND macro_tema = 'refaturamento'), 6) AS percentual FROM ce WHERE causa_raiz_clean <> ''
AND macro_tema = 'refaturamento' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
)
ce_query(
    "ce_theme_heatmap", theme_views.heatmap,
    " SELECT ano_mes, " + ", ".join(f"count(*) FILTER (macro_tema = '{t}') AS {t}" for t, _, _ in th.THEMES)
    + " FROM ce GROUP BY 1",
)
ce_query(
    "ce_repeat_installations", theme_views.repeat_installations,
    """ SELECT instalacao_hash, count(*) AS qtd_reclamacoes, count(DISTINCT macro_tema) AS temas_distintos,
max(data_ingresso) AS ultimo_ingresso FROM ce GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
_LABELS = ", ".join(f"({lit(label)})" for _, label, _ in th.THEMES)
ce_query(
    "ce_group_radar", theme_views.group_radar,
    f""", g AS (SELECT grupo_norm AS grupo, macro_tema_label, count(*) AS q FROM ce GROUP BY 1, 2),
d AS (SELECT a.grupo, v.l AS macro_tema_label, coalesce(q, 0) AS qtd FROM (SELECT DISTINCT grupo FROM g) a,
  (VALUES {_LABELS}) v(l) LEFT JOIN g ON g.grupo = a.grupo AND g.macro_tema_label = v.l)
SELECT *, round(qtd * 100 / sum(qtd) OVER (PARTITION BY grupo), 6) AS percentual FROM d""",
)
ce_query(
    "ce_reincidence_buckets", theme_views.reincidence,
    f""", c AS (SELECT {BUCKET} AS bucket, count(*) AS k FROM (SELECT instalacao_hash, count(*) AS n FROM ce GROUP BY 1)
GROUP BY 1) SELECT v.b AS bucket, coalesce(k, 0) AS instalacoes FROM (VALUES ('1'), ('2'), ('3-4'), ('5-9'), ('10+')) v(b)
LEFT JOIN c ON c.bucket = v.b""",
)


# ---- further aggregates and second-level summaries ------------------------------------------------------------
def frame_query(name: str, fn, sql: str, totals: bool = False) -> None:
    add(name, lambda spark, sf: rounded(fn(b.scope(spark, sf, totals, parts_of(name)))), over_frame(sql))


frame_query(
    "coverage_window", views.coverage_window,
    """SELECT regiao, CAST(min(data_ingresso) AS DATE) AS inicio, CAST(max(data_ingresso) AS DATE) AS fim,
CAST(date_diff('day', min(data_ingresso), max(data_ingresso)) + 1 AS INTEGER) AS dias FROM train GROUP BY 1""",
)
frame_query(
    "monthly_ce_sp", views.monthly_ce_sp,
    """SELECT mes_ingresso, count(DISTINCT ordem) FILTER (regiao = 'CE') AS CE, count(DISTINCT ordem)
FILTER (regiao = 'SP') AS SP FROM train GROUP BY 1""",
)
frame_query(
    "coverage_report", views.coverage_report,
    """SELECT regiao, count(*) AS linhas, count(*) FILTER (causa_canonica = 'indefinido') AS indefinidos,
round(avg((causa_canonica = 'indefinido')::INT), 6) AS taxa_indefinido FROM frame GROUP BY 1""",
    True,
)
frame_query(
    "sp_overview_metrics",
    lambda f: views.sp_overview(f).withColumn("tipos_medidor", F.concat_ws(",", "tipos_medidor")),
    f"""SELECT {N} AS total_ordens, count(*) FILTER (procedencia_real = 'PROCEDENTE') AS procedentes,
count(*) FILTER (procedencia_real = 'IMPROCEDENTE') AS improcedentes,
array_to_string(list_sort(list(DISTINCT tipo_medidor_dominante)), ',') AS tipos_medidor FROM train WHERE regiao = 'SP'""",
)
frame_query(
    "sp_installations_by_meter_type", lambda f: views.installations_by_meter_type(f, "Econ"),
    f"""SELECT instalacao, {N} AS qtd_ordens, {modal("assunto")} AS assunto_top, {modal("causa_canonica")} AS causa_top,
{modal("tipo_medidor_dominante")} AS tipo_medidor FROM train WHERE regiao = 'SP' AND
contains(lower(tipo_medidor_dominante), 'econ') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)


def _details(frame):
    text = lambda c: F.concat_ws(";", F.transform(c, lambda e: F.concat_ws(":", e["valor"], e["n"].cast("string"))))
    return views.installation_details(frame).withColumns(
        {"assunto_top": text("assunto_top"), "causa_canonica_top": text("causa_canonica_top")}
    )


def _top5(column: str) -> str:
    return f"""(SELECT instalacao, string_agg(v || ':' || n, ';' ORDER BY rn) AS t FROM (SELECT instalacao,
trim({column}) AS v, {N} AS n, row_number() OVER (PARTITION BY instalacao ORDER BY {N} DESC, trim({column})) AS rn
FROM train WHERE regiao = 'SP' AND trim({column}) <> '' GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1)"""


frame_query(
    "sp_installation_details", _details,
    f"""SELECT x.*, coalesce(a.t, '') AS assunto_top, coalesce(c.t, '') AS causa_canonica_top FROM (SELECT instalacao,
{N} AS total_ordens, count(*) FILTER (procedencia_real = 'PROCEDENTE') AS procedentes,
count(*) FILTER (procedencia_real = 'IMPROCEDENTE') AS improcedentes, count(DISTINCT fat_reclamada_top) AS meses_fatura
FROM train WHERE regiao = 'SP' GROUP BY 1) x LEFT JOIN {_top5("assunto")} a USING (instalacao)
LEFT JOIN {_top5("causa_canonica")} c USING (instalacao)""",
)
frame_query(
    "sp_installation_invoices", views.installation_invoices,
    f"""SELECT instalacao, fat_reclamada_top, {N} AS qtd_ordens, round(avg(valor_fatura_reclamada_medio), 6) AS valor_medio,
max(valor_fatura_reclamada_max) AS valor_max, {modal("tipo_medidor_dominante")} AS tipo_medidor,
{modal("assunto")} AS assunto_top, {modal("causa_canonica")} AS causa_top FROM train WHERE regiao = 'SP' GROUP BY 1, 2""",
)
frame_query(
    "severity_buckets", lambda f: surfaces.severity_buckets(views.severity_heatmap(f), "SP"),
    f""", h AS ({_HEATMAP.replace("GROUP BY 1, 2", "GROUP BY ALL")}), d AS (SELECT v.k AS key, v.l AS label,
  CAST(coalesce(sum(qtd_erros), 0) AS BIGINT) AS value FROM (VALUES ('critical', 'Crítica'), ('high', 'Alta'),
  ('medium', 'Média'), ('low', 'Baixa')) v(k, l) LEFT JOIN h ON severidade = v.k AND regiao = 'SP' GROUP BY 1, 2)
SELECT *, round(value * 100 / sum(value) OVER (), 6) AS pct FROM d""",
)
frame_query(
    "cause_scatter", lambda f: surfaces.cause_scatter(views.root_cause_distribution(f)),
    f"""SELECT id, x, round(least(100, greatest(0, r * 100)), 6) AS y FROM (SELECT causa_canonica AS id, {N} AS x,
avg(flag_resolvido_com_refaturamento::INT) AS r FROM train GROUP BY 1 ORDER BY x DESC, id LIMIT 12) WHERE id <> 'indefinido'""",
)
frame_query(
    "subject_model_summary",
    lambda f: surfaces.subject_model_summary(
        views.top_subjects(f), views.classifier_coverage(f), views.category_breakdown(f), views.executive_summary(f)
    ),
    f""", t AS (SELECT assunto, {N} AS n FROM train GROUP BY 1),
cv AS (SELECT causa_canonica_confidence AS c, {N} AS n FROM train WHERE regiao = 'SP' GROUP BY 1)
SELECT assunto AS subject_name, n AS subject_total, (SELECT {N} FROM train WHERE regiao = 'SP') AS total_regiao,
round(n * 100 / (SELECT {N} FROM train WHERE regiao = 'SP'), 6) AS subject_share,
CAST((SELECT sum(n) FROM cv WHERE c IN ('high', 'low')) AS BIGINT) AS evaluated,
round((SELECT sum(n) FILTER (c IN ('high', 'low')) * 100 / sum(n) FROM cv), 6) AS evaluated_share,
CASE WHEN (SELECT count(*) FROM cv WHERE c = 'low') > 0 THEN 'high_low' ELSE 'high' END AS confidence_note,
(SELECT count(DISTINCT {category("causa_canonica")}) FROM train WHERE regiao = 'SP') AS categories_found
FROM t WHERE trim(assunto) <> '' ORDER BY n DESC, assunto LIMIT 1""",
)
frame_query(
    "monthly_evaluated_series", lambda f: surfaces.monthly_series(views.monthly_trend(f)),
    f"""SELECT mes_ingresso AS iso, list_extract({list(surfaces.MONTHS)}, month(mes_ingresso)) || '/' ||
strftime(mes_ingresso, '%y') AS label, {N} AS total FROM train WHERE regiao = 'SP' GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
)
frame_query(
    "weighted_invoice_mean", lambda f: surfaces.weighted_invoice(views.sp_invoice_by_meter(f)),
    f""", r AS (SELECT tipo_medidor_dominante, {N} AS w, count(DISTINCT instalacao) AS i,
avg(valor_fatura_reclamada_medio) AS v {_SPM} GROUP BY 1)
SELECT round(sum(w * v) / sum(w), 6) AS valor, CAST(sum(w) AS BIGINT) AS qtd_ordens, CAST(sum(i) AS BIGINT) AS qtd_instalacoes,
round(sum(w * v), 6) AS total_reclamado FROM r""",
)
frame_query(
    "category_tree_nodes",
    lambda f: sv.tree_nodes(sv.category_tree(f)).withColumn(
        "subcausas",
        F.concat_ws(";", F.transform("subcausas", lambda e: F.concat_ws(":", e["subcausa_id"], e["qtd"].cast("string")))),
    ),
    f"""{_scope(list(tax.SEVERITY_ORDER))}, ct AS (SELECT categoria, {N} AS cq FROM s GROUP BY 1),
h AS (SELECT * FROM ct ORDER BY 2 DESC, 1 LIMIT 8),
k AS (SELECT categoria, causa_canonica, {N} AS qtd, count(*) FILTER (procedente_real) AS pr,
  row_number() OVER (PARTITION BY categoria ORDER BY {N} DESC, causa_canonica) AS rn FROM s GROUP BY 1, 2)
SELECT categoria AS categoria_id, {TITLE.format(x="categoria")} AS categoria_label, any_value(cq) AS categoria_qtd,
round(any_value(cq) / (SELECT sum(cq) FROM ct) * 100, 2) AS categoria_pct, CAST(sum(pr) AS BIGINT) AS procedentes,
CAST(sum(qtd - pr) AS BIGINT) AS improcedentes, string_agg(causa_canonica || ':' || qtd, ';' ORDER BY qtd DESC, causa_canonica)
AS subcausas FROM k JOIN h USING (categoria) WHERE rn <= 6 GROUP BY 1""",
)
frame_query(
    "cause_ranking", lambda f: surfaces.cause_ranking(sv.causes(f, "high")),
    f"""{_scope(["high"])}, r AS (SELECT causa_canonica, count(*) FILTER (n > 1) AS k FROM (SELECT causa_canonica,
  instalacao_hash, {N} AS n FROM s GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT causa_canonica AS nome, {N} AS vol, round(avg(procedente_real::INT) * 100, 2) AS proc, any_value(k) AS reinc,
  min(categoria) AS cat FROM s JOIN r USING (causa_canonica) GROUP BY 1 ORDER BY vol DESC, nome LIMIT 14)
SELECT 'c' || lpad(CAST(row_number() OVER (ORDER BY vol DESC, nome) AS VARCHAR), 2, '0') AS id, nome AS label, vol,
CAST(round(proc / 100 * vol) AS BIGINT) AS procedentes, vol - CAST(round(proc / 100 * vol) AS BIGINT) AS improcedentes,
proc AS pct_procedentes, reinc, cat AS categoria FROM c""",
)
frame_query(
    "outcome_split", lambda f: surfaces.outcome_split(views.severity_heatmap(f), severities=("medium", "low")),
    f""", h AS (SELECT {severity("causa_canonica")} AS sev, {N} AS n, avg(flag_resolvido_com_refaturamento::INT) AS r
FROM train WHERE regiao = 'SP' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, round(sum(n * r), 6) AS procedentes, round(sum(n) - sum(n * r), 6) AS improcedentes,
round(sum(n * r) * 100 / sum(n), 6) AS pct_procedentes FROM h WHERE sev IN ('medium', 'low')""",
)
