"""Silver rules, quality, gold and documented metrics over the operation bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlake import bindings as b
from wattlake import operations as op
from wattlake import runtime
from wattlake.catalog.base import add
from wattlake.catalog.sqlparts import COMPLAINTS, in_list, lit, map_case
from wattlake.catalog.view_queries import rounded
from wattlake.functions import rules as ru
from wattlake.functions import themes as th
from wattlake.operators import dedup, upsert
from wattlake.plans import calendar as cal
from wattlake.plans import gold, metrics, quality, silver
from wattlake.sources.contracts import Column, Contract, threshold_report

REF = f"DATE '{op.REFERENCE}'"
STATE = "list_extract(['SP','RJ','CE','GO','SP'], {x} + 1)"

_NOTES = f"""
notes0 AS (
  SELECT l_orderkey * 10 + l_linenumber AS cod_nota, o_custkey AS cod_uc, cn.n_regionkey AS cod_distribuidora,
    c_nationkey AS cod_ut, s_nationkey AS cod_base, {STATE.format(x="cn.n_regionkey")} AS uf,
    CASE WHEN p_size <= 40 THEN p_size END AS cod_lote, l_suppkey AS cod_colaborador,
    {map_case("p_type", op.SERVICES.items(), "NULL")} AS tipo_servico, l_returnflag <> 'N' AS flag_impacto_faturamento,
    l_linestatus = 'O' AND l_tax > 0.06 AS area_classificada_risco, greatest(l_linenumber - 4, 0) AS historico_incidentes_12m,
    CASE WHEN p_size > 45 THEN 'SUBESTACAO' ELSE 'RESIDENCIAL' END AS tipo_instalacao,
    lpad(CAST(CAST(floor(l_quantity / 2) AS INTEGER) AS VARCHAR), 2, '0') || ':00' AS horario_agendado,
    l_discount >= 0.1 AS flag_risco_manual, CAST(o_orderdate AS DATE) AS data_criacao,
    CASE WHEN l_linenumber <> 7 THEN CAST(o_orderdate AS DATE) + 30 END AS data_prevista,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(l_shipdate AS DATE) END AS data_execucao, l_shipdate AS data_alteracao,
    CASE WHEN l_tax = 0 AND l_discount = 0 THEN 'CANCELADA' WHEN l_returnflag = 'R' THEN 'DEVOLVIDA'
      WHEN o_orderstatus = 'P' THEN 'ABERTA' WHEN l_linestatus = 'F' THEN 'FECHADA' ELSE 'EXECUTADA' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey),
notes1 AS (
  SELECT *, (area_classificada_risco OR historico_incidentes_12m >= 2 OR tipo_instalacao IN {in_list(ru.RISK_INSTALLATIONS)}
    OR horario_agendado < '06:00' OR horario_agendado > '18:00' OR flag_risco_manual) AS risk FROM notes0),
notes AS MATERIALIZED (
  SELECT * EXCLUDE (risk), CASE WHEN flag_impacto_faturamento AND tipo_servico IN {in_list(ru.CLASS_A_SERVICES)} THEN 'ACF_A'
    WHEN flag_impacto_faturamento AND tipo_servico IN {in_list(ru.CLASS_B_SERVICES)} THEN 'ACF_B'
    WHEN flag_impacto_faturamento THEN 'ACF_C' WHEN risk THEN 'ASF_RISCO' ELSE 'ASF_FORA_RISCO' END AS classificacao_acf_asf,
    NOT flag_impacto_faturamento AND risk AS flag_risco,
    CAST(CASE WHEN data_prevista IS NULL THEN 0 WHEN data_execucao > data_prevista THEN data_execucao - data_prevista
      WHEN data_execucao IS NULL AND {REF} > data_prevista THEN {REF} - data_prevista ELSE 0 END AS INTEGER) AS dias_atraso,
    CASE WHEN data_prevista IS NULL THEN 'SEM_PREVISAO' WHEN data_execucao <= data_prevista THEN 'NO_PRAZO'
      WHEN data_execucao > data_prevista THEN 'ATRASADO' WHEN {REF} <= data_prevista THEN 'PENDENTE_NO_PRAZO'
      ELSE 'PENDENTE_FORA_PRAZO' END AS status_atraso FROM notes1)"""

_DELIVERIES = f"""
deliveries0 AS (SELECT l_orderkey * 10 + l_linenumber AS cod_entrega, l_orderkey AS cod_fatura, o_custkey AS cod_uc,
    n_regionkey AS cod_distribuidora, {STATE.format(x="n_regionkey")} AS uf, c_nationkey AS cod_base,
    CAST(o_orderdate AS DATE) AS data_emissao, CAST(o_orderdate AS DATE) + 900 AS data_vencimento,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(l_shipdate AS DATE) END AS data_entrega, l_tax - 23.5 AS la, l_discount - 46.6 AS lo,
    (l_tax - 23.5) + (l_quantity - 25) / 20000 AS lb, o_orderstatus <> 'P' AS flag_entregue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
deliveries AS MATERIALIZED (SELECT *, 12742000 * asin(sqrt(pow(sin(radians(lb - la) / 2), 2))) AS distancia_metros,
    12742000 * asin(sqrt(pow(sin(radians(lb - la) / 2), 2))) <= 100 AS flag_dentro_coordenada,
    coalesce(data_vencimento - data_entrega >= 5, false) AS flag_antes_vencimento,
    CAST(data_entrega - data_emissao AS INTEGER) AS dias_para_entrega FROM deliveries0)"""

_PAYMENTS = f"""
payments AS MATERIALIZED (SELECT *, data_pagamento IS NULL AND {REF} - data_vencimento > 30 AS flag_inadimplente,
    CAST(CASE WHEN data_pagamento IS NOT NULL THEN greatest(data_pagamento - data_vencimento, 0) ELSE {REF} - data_vencimento END
      AS INTEGER) AS dias_atraso_pagamento
  FROM (SELECT l_orderkey * 10 + l_linenumber AS cod_pagamento, l_orderkey AS cod_fatura, o_custkey AS cod_uc,
    {STATE.format(x="n_regionkey")} AS uf, c_nationkey AS cod_base, l_extendedprice AS valor_fatura,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS valor_pago, CAST(l_shipdate AS DATE) AS data_vencimento,
    CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) + (l_linenumber * 10 - 30) END AS data_pagamento
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey))"""

_TARGETS = f"""
targets AS MATERIALIZED (SELECT *, valor_realizado / nullif(valor_meta, 0) * 100 AS pct_atingimento,
    CASE WHEN valor_realizado / valor_meta * 100 >= 100 THEN 'ATINGIDA' WHEN valor_realizado / valor_meta * 100 >= 90
      THEN 'EM_RISCO' WHEN valor_realizado / valor_meta * 100 >= 70 THEN 'CRITICA' ELSE 'NAO_ATINGIDA' END AS status_meta
  FROM (SELECT s_nationkey AS cod_base, {STATE.format(x="n_regionkey")} AS uf, strftime(l_shipdate, '%Y-%m') AS mes_referencia,
    'EFETIVIDADE' AS indicador, round(sum(l_quantity) * 0.75, 4) AS valor_meta,
    sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS valor_realizado
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL))"""


def _hol(days) -> str:
    return "(month(data) * 100 + day(data)) IN (" + ", ".join(str(m * 100 + d) for m, d in days) + ")"


_CAL = f"""
bounds AS (SELECT date_trunc('month', least(min(o_orderdate), (SELECT min(l_shipdate) FROM lineitem)))::DATE AS a,
  last_day(greatest(max(o_orderdate), (SELECT max(l_shipdate) FROM lineitem))::DATE) AS z FROM orders),
cal0 AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS data FROM bounds),
cal1 AS (SELECT data, uf, isodow(data) - 1 AS dow, {_hol(cal.NATIONAL_HOLIDAYS)} AS nat,
  CASE uf {" ".join(f"WHEN '{s}' THEN {_hol(d)}" for s, d in cal.STATE_HOLIDAYS.items())} END AS loc
  FROM cal0, (VALUES ('SP'), ('RJ'), ('CE'), ('GO')) v(uf)),
calendar AS MATERIALIZED (SELECT data, uf, CAST(dow AS INTEGER) AS dia_semana, CAST(day(data) AS INTEGER) AS dia_mes,
  CAST(month(data) AS INTEGER) AS mes, CAST(quarter(data) AS INTEGER) AS trimestre, CAST(year(data) AS INTEGER) AS ano,
  nat AS flag_feriado_nacional, loc AS flag_feriado_uf, strftime(data, '%Y-%m') AS ano_mes,
  dow < 5 AND NOT nat AND NOT loc AS flag_dia_util, md5(CAST(data AS VARCHAR) || '-' || uf) AS sk_tempo FROM cal1)"""


def sk(x: str) -> str:
    return f"md5(coalesce(CAST({x} AS VARCHAR), ''))"


def q(name, fn, *ctes_and_sql: str) -> None:
    *ctes, sql = ctes_and_sql
    add(name, lambda spark, sf: rounded(fn(spark, sf)), f"WITH {', '.join(ctes)} {sql}" if ctes else sql)


# ---- silver rules ---------------------------------------------------------------------------------------------
q(
    "service_orders_silver",
    lambda s, d: op.silver_notes(s, d).select(
        "cod_nota", "classificacao_acf_asf", "flag_risco", "dias_atraso", "status_atraso", "status", "tipo_servico"
    ),
    _NOTES,
    "SELECT cod_nota, classificacao_acf_asf, flag_risco, dias_atraso, status_atraso, status, tipo_servico FROM notes",
)
q(
    "service_class_counts",
    lambda s, d: op.silver_notes(s, d).groupBy("classificacao_acf_asf", "flag_risco").agg(F.count(F.lit(1)).alias("n")),
    _NOTES, "SELECT classificacao_acf_asf, flag_risco, count(*) AS n FROM notes GROUP BY 1, 2",
)
q(
    "deliveries_silver",
    lambda s, d: silver.deliveries(op.deliveries(s, d)).select(
        "cod_entrega", F.round("distancia_metros", 4).alias("distancia_metros"), "flag_dentro_coordenada",
        "flag_antes_vencimento", "dias_para_entrega",
    ),
    _DELIVERIES,
    "SELECT cod_entrega, round(distancia_metros, 4) AS distancia_metros, flag_dentro_coordenada, flag_antes_vencimento, "
    "dias_para_entrega FROM deliveries",
)
q(
    "payments_silver",
    lambda s, d: silver.payments(op.payments(s, d), op.REFERENCE).select(
        "cod_pagamento", "flag_inadimplente", "dias_atraso_pagamento"
    ),
    _PAYMENTS, "SELECT cod_pagamento, flag_inadimplente, dias_atraso_pagamento FROM payments",
)
q(
    "targets_silver", lambda s, d: silver.targets(op.targets(s, d)), _TARGETS,
    "SELECT * REPLACE (round(pct_atingimento, 6) AS pct_atingimento, round(valor_meta, 6) AS valor_meta, "
    "round(valor_realizado, 6) AS valor_realizado) FROM targets",
)

PAYMENT_CONTRACT = Contract(
    "pagamentos",
    (
        Column("cod_pagamento", "bigint", False), Column("cod_uc", "bigint", False),
        Column("valor_fatura", "decimal(12,2)", False), Column("valor_pago", "decimal(12,2)"),
        Column("data_vencimento", "date", False, format="dd/MM/yyyy"), Column("data_pagamento", "date", format="dd/MM/yyyy"),
    ),
    strategy="incremental", critical_columns=("cod_pagamento", "valor_pago"), min_rows=100, max_null_pct=0.2,
)


def _payment_texts(spark, sf):
    """Payments as they land: decimal comma with thousands dot, dd/MM/yyyy, all text."""
    money = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    return op.payments(spark, sf).select(
        F.col("cod_pagamento").cast("string").alias("cod_pagamento"), F.col("cod_uc").cast("string").alias("cod_uc"),
        money("valor_fatura").alias("valor_fatura"), money("valor_pago").alias("valor_pago"),
        day("data_vencimento").alias("data_vencimento"), day("data_pagamento").alias("data_pagamento"),
    )


q(
    "typed_cast_round_trip",
    lambda s, d: silver.apply_types(_payment_texts(s, d), PAYMENT_CONTRACT).withColumns(
        {c: F.col(c).cast("double") for c in ("valor_fatura", "valor_pago")}
    ),
    _PAYMENTS,
    "SELECT cod_pagamento, cod_uc, round(valor_fatura, 2) AS valor_fatura, round(valor_pago, 2) AS valor_pago, "
    "data_vencimento, data_pagamento FROM payments",
)
q(
    "contract_rejects",
    lambda s, d: silver.reject_reasons(
        _payment_texts(s, d).withColumn("valor_pago", F.when(F.col("valor_pago").startswith("1"), "n/d").otherwise(F.col("valor_pago"))),
        PAYMENT_CONTRACT,
    ).select(F.explode("_reasons").alias("motivo")).groupBy("motivo").agg(F.count(F.lit(1)).alias("linhas")),
    _PAYMENTS,
    "SELECT 'valor_pago: not decimal(12,2)' AS motivo, count(*) AS linhas FROM payments "
    "WHERE format('{:.2f}', valor_pago)[1] = '1'",
)
q(
    "contract_thresholds",
    lambda s, d: threshold_report(op.payments(s, d), PAYMENT_CONTRACT),
    _PAYMENTS,
    """, t AS (SELECT count(*) AS n, avg((cod_pagamento IS NULL)::INT) AS a, avg((valor_pago IS NULL)::INT) AS v FROM payments)
SELECT 'min_rows' AS rule, n::DOUBLE AS measured, 100::DOUBLE AS bound, n >= 100 AS ok FROM t UNION ALL
SELECT 'null_share:cod_pagamento', a, 0.2, a <= 0.2 FROM t UNION ALL
SELECT 'null_share:valor_pago', round(v, 6), 0.2, v <= 0.2 FROM t""",
)


def _event_keys(spark, sf):
    e = b.table(spark, sf, "events")
    return e.select("user_id", "event_type", "ts", "event_id", "value")


q(
    "latest_wins_dedup",
    lambda s, d: dedup.latest_wins(_event_keys(s, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]),
    "SELECT * EXCLUDE (rn) FROM (SELECT user_id, event_type, ts, event_id, round(value, 6) AS value, row_number() OVER "
    "(PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
q(
    "oldest_wins_dedup",
    lambda s, d: dedup.latest_wins(_event_keys(s, d), ["user_id"], [F.col("ts"), F.col("event_id")], newest=False),
    "SELECT * EXCLUDE (rn) FROM (SELECT user_id, event_type, ts, event_id, round(value, 6) AS value, row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)


def _complaint_silver(spark, sf):
    raw = b.complaints(spark, sf).withColumns(
        {
            "_sheet_name": F.col("linha").cast("string"),
            "_source_hash": F.sha2(F.concat_ws("||", "ordem", "linha", "assunto", "causa_raiz", "devolutiva"), 256),
        }
    ).drop("texto_completo", "flag_resolvido_com_refaturamento", "has_causa_raiz_label")
    out = silver.complaints(raw)
    joined = {c: F.concat_ws("|", c) for c in ("ceps_extraidos", "datas_extraidas", "instalacoes_mencionadas")}
    return out.withColumns(joined).select(
        "ordem", "_source_region", "_sheet_name", "assunto", "status", "causa_raiz", "has_causa_raiz_label",
        "flag_resolvido_com_refaturamento", F.md5("texto_completo").alias("texto_md5"), *joined,
    )


def _ent(pattern: str, group: int) -> str:
    return (
        f"array_to_string(list_sort(list_distinct(regexp_extract_all(texto_completo, {lit(pattern)}, {group}))), '|')"
    )


from wattlake.functions import text as tx  # noqa: E402

q(
    "complaints_silver", _complaint_silver, COMPLAINTS,
    f""", r AS (SELECT *, row_number() OVER (PARTITION BY ordem, _source_region ORDER BY CAST(linha AS VARCHAR) DESC,
  sha256(concat_ws('||', ordem, linha, assunto, causa_raiz, devolutiva)) DESC) AS rn FROM complaints)
SELECT ordem, _source_region, CAST(linha AS VARCHAR) AS _sheet_name, nullif(upper(trim(assunto)), '') AS assunto, status,
  upper(causa_raiz) AS causa_raiz, has_causa_raiz_label, flag_resolvido_com_refaturamento, md5(texto_completo) AS texto_md5,
  {_ent(tx.CEP, 0)} AS ceps_extraidos, {_ent(tx.DAY_TEXT, 0)} AS datas_extraidas, {_ent(tx.INSTALLATION, 1)}
  AS instalacoes_mencionadas FROM r WHERE rn = 1""",
)

# ---- quality --------------------------------------------------------------------------------------------------
_CHECKS = (
    quality.Expectation("row_count", options={"greater_than": 100}, critical=True),
    quality.Expectation("not_null", "data_prevista"),
    quality.Expectation("in_set", "status_atraso", {"values": ["NO_PRAZO", "ATRASADO"]}),
    quality.Expectation("between", "dias_atraso", {"min": 0, "max": 1000}),
    quality.Expectation("unique", "cod_uc"),
)
_CHECK_SQL = """SELECT 'notas' AS suite, 'row_count' AS expectation, true AS critical, 0::BIGINT AS failures, true AS success
UNION ALL SELECT 'notas', 'not_null:data_prevista', false, count(*) FILTER (data_prevista IS NULL),
  count(*) FILTER (data_prevista IS NULL) = 0 FROM notes
UNION ALL SELECT 'notas', 'in_set:status_atraso', false, count(*) FILTER (status_atraso NOT IN ('NO_PRAZO', 'ATRASADO')),
  count(*) FILTER (status_atraso NOT IN ('NO_PRAZO', 'ATRASADO')) = 0 FROM notes
UNION ALL SELECT 'notas', 'between:dias_atraso', false, count(*) FILTER (dias_atraso > 1000),
  count(*) FILTER (dias_atraso > 1000) = 0 FROM notes
UNION ALL SELECT 'notas', 'unique:cod_uc', false, count(cod_uc) - count(DISTINCT cod_uc), count(cod_uc) = count(DISTINCT cod_uc)
  FROM notes"""
q("expectations", lambda s, d: quality.evaluate(op.silver_notes(s, d), "notas", _CHECKS), _NOTES, _CHECK_SQL)
q(
    "suite_silver_notes",
    lambda s, d: quality.evaluate(
        op.silver_notes(s, d), "silver_notas_operacionais", quality.SUITES["silver_notas_operacionais"]
    ),
    "SELECT 'silver_notas_operacionais' AS suite, e AS expectation, true AS critical, CAST(0 * n AS BIGINT) AS failures, "
    "true AS success FROM (SELECT unnest(['not_null:cod_nota', 'not_null:classificacao_acf_asf', "
    "'in_set:classificacao_acf_asf', 'in_set:status_atraso']) AS e), (SELECT count(*) AS n FROM lineitem)",
)
q(
    "orphan_check",
    lambda s, d: quality.orphans(b.table(s, d, "orders"), b.table(s, d, "documents"), "o_orderkey", "doc_id"),
    "SELECT o_orderkey AS chave, count(*) AS linhas FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents) GROUP BY 1",
)
q(
    "orphan_count",
    lambda s, d: quality.orphan_count(b.table(s, d, "lineitem"), b.table(s, d, "documents"), "l_orderkey", "doc_id"),
    "SELECT count(*) AS orfaos FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)",
)


def _winners(spark, sf):
    return dedup.latest_wins(op.notes(spark, sf), ["cod_uc", "cod_base"], [F.col("data_alteracao"), F.col("cod_nota")])


_RECON = f""", w AS (SELECT count(*) AS t FROM (SELECT DISTINCT cod_uc, cod_base FROM notes)), n AS (SELECT count(*) AS s FROM notes),
r AS (SELECT s, t, s - t AS d, abs(s - t) / s AS p FROM n, w)
SELECT 'bronze_to_silver' AS layer_pair, 'notas' AS table_name, s AS source_count, t AS target_count, d AS delta_count,
  round(p * 100, 2) AS delta_pct, CASE WHEN p <= 0.05 THEN 'OK' WHEN p <= 0.1 THEN 'WARNING' ELSE 'FAIL' END AS status,
  5.0 AS threshold_pct FROM r"""
q(
    "reconciliation", lambda s, d: quality.reconcile(op.notes(s, d), _winners(s, d), "bronze_to_silver", "notas"),
    _NOTES, _RECON,
)
q(
    "reconciliation_keys",
    lambda s, d: quality.reconcile_keys(op.notes(s, d), _winners(s, d), ["cod_base"]),
    _NOTES,
    "SELECT cod_base, count(*) AS source_rows, count(DISTINCT cod_uc) AS target_rows FROM notes GROUP BY 1 "
    "HAVING count(*) <> count(DISTINCT cod_uc)",
)
q(
    "quality_alerts",
    lambda s, d: quality.alerts(
        quality.evaluate(op.silver_notes(s, d), "notas", _CHECKS),
        quality.reconcile(op.notes(s, d), _winners(s, d), "bronze_to_silver", "notas"),
    ).drop("details"),
    _NOTES,
    f", c AS ({_CHECK_SQL}) "
    "SELECT 'HIGH' AS severity, suite AS table_name, expectation FROM c WHERE NOT success UNION ALL "
    "SELECT CASE WHEN p > 0.1 THEN 'HIGH' ELSE 'MEDIUM' END, 'notas', 'reconciliation' FROM (SELECT 1 - "
    "(SELECT count(*) FROM (SELECT DISTINCT cod_uc, cod_base FROM notes)) / (SELECT count(*) FROM notes) AS p) WHERE p > 0.05",
)
q(
    "targets_without_base",
    lambda s, d: quality.orphans(
        b.table(s, d, "nation"), op.targets(s, d), "n_nationkey", "cod_base"
    ),
    "SELECT n_nationkey AS chave, count(*) AS linhas FROM nation WHERE n_nationkey NOT IN "
    "(SELECT s_nationkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey) GROUP BY 1",
)
add("frame_fingerprint", lambda s, d: quality.fingerprint(op.notes(s, d)))

# ---- gold -----------------------------------------------------------------------------------------------------
q("dim_time", lambda s, d: op.calendar(s, d), _CAL, "SELECT * FROM calendar")
q(
    "business_days_to_deliver",
    lambda s, d: silver.business_days_between(
        op.deliveries(s, d).filter("data_entrega >= data_emissao").select("cod_entrega", "data_emissao", "data_entrega"),
        "data_emissao", "data_entrega",
        cal.with_running_business_days(op.calendar(s, d)).filter("uf = 'SP'"), "dias_uteis",
    ).groupBy("dias_uteis").agg(F.count(F.lit(1)).alias("n")),
    _DELIVERIES, _CAL,
    """, u AS (SELECT data, sum(flag_dia_util::INT) OVER (ORDER BY data) AS k FROM calendar WHERE uf = 'SP')
SELECT CAST(b.k - a.k AS BIGINT) AS dias_uteis, count(*) AS n FROM deliveries JOIN u a ON a.data = data_emissao
JOIN u b ON b.data = data_entrega WHERE data_entrega >= data_emissao GROUP BY 1""",
)
q(
    "dim_distributor", lambda s, d: gold.dim_distributor(op.masters(s, d)["distribuidora"]),
    f"SELECT {sk('r_regionkey')} AS sk_distribuidora, r_regionkey AS cod_distribuidora, upper(trim(r_name)) AS nome_distribuidora, "
    f"{STATE.format(x='r_regionkey')} AS uf, CASE WHEN {STATE.format(x='r_regionkey')} IN ('SP','RJ') THEN 'SUDESTE' "
    f"WHEN {STATE.format(x='r_regionkey')} = 'CE' THEN 'NORDESTE' ELSE 'CENTRO-OESTE' END AS regiao FROM region",
)
for _dim, _key, _cols in (
    ("ut", "cod_ut", "n_nationkey AS cod_ut, n_regionkey AS cod_distribuidora, n_name AS nome_ut FROM nation"),
    ("base", "cod_base", "n_nationkey AS cod_base, n_regionkey AS cod_co, 'BASE ' || n_name AS nome_base FROM nation"),
    ("uc", "cod_uc", "c_custkey AS cod_uc, c_nationkey AS cod_base, c_mktsegment AS classe_consumo FROM customer"),
    ("colaborador", "cod_colaborador",
     "s_suppkey AS cod_colaborador, s_name AS nome_colaborador, s_nationkey AS equipe FROM supplier"),
):
    q(
        f"dim_{_dim}",
        lambda s, d, _dim=_dim, _key=_key: gold.dimension(op.masters(s, d)[_dim], _key, f"sk_{_dim}"),
        f"SELECT {sk(_cols.split(' AS ')[0])} AS sk_{_dim}, {_cols}",
    )
q(
    "dim_lot", lambda s, d: gold.dim_lot(op.silver_notes(s, d)), _NOTES,
    f"SELECT DISTINCT {sk('cod_lote')} AS sk_lote, cod_lote, cod_base, tipo_servico FROM notes WHERE cod_lote IS NOT NULL",
)
q(
    "dim_risk", lambda s, d: gold.dim_risk(op.silver_notes(s, d)), _NOTES,
    "SELECT DISTINCT md5(classificacao_acf_asf || '-' || CAST(flag_risco AS VARCHAR)) AS sk_risco, classificacao_acf_asf, "
    "flag_risco, CASE WHEN flag_risco THEN 'RISCO' ELSE 'PADRAO' END AS descricao FROM notes",
)
q(
    "dim_cause", lambda s, d: gold.dim_cause(b.complaints(s, d)), COMPLAINTS,
    f", c AS (SELECT DISTINCT coalesce(causa_raiz, 'NAO_CLASSIFICADA') AS causa_raiz FROM complaints) SELECT {sk('causa_raiz')} "
    "AS sk_causa_raiz, causa_raiz, causa_raiz <> 'NAO_CLASSIFICADA' AS flag_label_humano FROM c",
)
q(
    "dim_region", lambda s, d: gold.dim_region(b.complaints(s, d)), COMPLAINTS,
    f", c AS (SELECT DISTINCT _source_region AS regiao FROM complaints) SELECT {sk('regiao')} AS sk_regiao, regiao, CASE regiao "
    "WHEN 'CE' THEN 'Ceara' WHEN 'SP' THEN 'Sao Paulo' ELSE 'Nao informado' END AS nome_regiao FROM c",
)


def _dims(spark, sf):
    """Dimensions of the service orders. Those that are worked out of the facts are written: as small tables they are broadcast by their size."""
    m = op.masters(spark, sf)
    version = runtime.dataset_version(spark, [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "customer", "supplier", "nation", "part")])
    return {
        "tempo": runtime.materialise(spark, lambda: op.calendar(spark, sf), "dim_tempo", version),
        "distribuidora": gold.dim_distributor(m["distribuidora"]),
        **{k: gold.dimension(m[k], f"cod_{k}", f"sk_{k}") for k in ("ut", "base", "uc", "colaborador")},
        "risco": runtime.materialise(spark, lambda: gold.dim_risk(op.silver_notes(spark, sf)), "dim_risco", version),
    }


def _fact(spark, sf):
    return gold.fact_notes(op.silver_notes(spark, sf), _dims(spark, sf))


_FACT = f"""
fact AS MATERIALIZED (SELECT md5(CAST(data_criacao AS VARCHAR) || '-' || uf) AS sk_tempo, {sk("cod_distribuidora")} AS sk_distribuidora,
  {sk("cod_ut")} AS sk_ut, {sk("cod_base")} AS sk_base, {sk("cod_uc")} AS sk_uc, {sk("cod_colaborador")} AS sk_colaborador,
  CASE WHEN cod_lote IS NOT NULL THEN {sk("cod_lote")} END AS sk_lote,
  md5(classificacao_acf_asf || '-' || CAST(flag_risco AS VARCHAR)) AS sk_risco, cod_nota, dias_atraso,
  status_atraso = 'NO_PRAZO' AS flag_no_prazo, status IN ('EXECUTADA', 'FECHADA') AS flag_executada,
  status_atraso = 'ATRASADO' AS flag_atrasada, status = 'DEVOLVIDA' AS flag_devolvida, status = 'CANCELADA' AS flag_cancelada,
  tipo_servico, status AS status_nota, status_atraso, classificacao_acf_asf FROM notes)"""
q("fact_service_orders", _fact, _NOTES, _FACT, "SELECT * FROM fact")
_EFF = """count(*) AS total_notas, sum(flag_executada::BIGINT)::BIGINT AS notas_executadas,
sum(flag_no_prazo::BIGINT)::BIGINT AS notas_no_prazo, sum(flag_devolvida::BIGINT)::BIGINT AS notas_devolvidas,
round(sum(flag_executada::INT) * 100.0 / count(*), 2) AS efetividade_bruta_pct,
round(sum(flag_no_prazo::INT) * 100.0 / count(*), 2) AS efetividade_liquida_pct,
round(sum(flag_devolvida::INT) * 100.0 / count(*), 2) AS taxa_devolucao_pct FROM fact"""
q(
    "fact_effectiveness", lambda s, d: gold.fact_effectiveness(_fact(s, d)), _NOTES, _FACT,
    f"SELECT sk_tempo, sk_base, sk_distribuidora, {_EFF} GROUP BY 1, 2, 3",
)
q(
    "effectiveness_by_worker", lambda s, d: gold.effectiveness_by_worker(_fact(s, d)), _NOTES, _FACT,
    "SELECT sk_colaborador, count(*) AS total_notas, sum(flag_no_prazo::BIGINT)::BIGINT AS no_prazo FROM fact GROUP BY 1",
)
q(
    "operational_overview",
    lambda s, d: (lambda dims: gold.operational_overview(_fact(s, d), dims["tempo"], dims["distribuidora"], dims["ut"], dims["base"]))(
        _dims(s, d)
    ),
    _NOTES,
    """SELECT strftime(data_criacao, '%Y-%m') AS ano_mes, upper(r_name) AS nome_distribuidora, u.n_name AS nome_ut,
'BASE ' || k.n_name AS nome_base, count(*) AS total_notas, count(*) FILTER (status IN ('EXECUTADA', 'FECHADA')) AS executadas,
count(*) FILTER (status_atraso = 'NO_PRAZO') AS no_prazo, count(*) FILTER (status_atraso = 'ATRASADO') AS atrasadas,
round(count(*) FILTER (status_atraso = 'NO_PRAZO') * 100.0 / count(*), 2) AS efetividade_pct, round(avg(dias_atraso), 1) AS atraso_medio
FROM notes JOIN region ON cod_distribuidora = r_regionkey JOIN nation u ON cod_ut = u.n_nationkey
JOIN nation k ON cod_base = k.n_nationkey GROUP BY 1, 2, 3, 4""",
)


def _delivery_fact(spark, sf):
    dims = _dims(spark, sf)
    return gold.fact_deliveries(silver.deliveries(op.deliveries(spark, sf)), dims["tempo"], dims["uc"], dims["base"])


q(
    "fact_deliveries", lambda s, d: _delivery_fact(s, d).withColumn("distancia_metros", F.round("distancia_metros", 4)), _DELIVERIES,
    f"""SELECT md5(CAST(data_emissao AS VARCHAR) || '-' || uf) AS sk_tempo, {sk("cod_uc")} AS sk_uc, {sk("cod_base")} AS sk_base,
cod_entrega, cod_fatura, flag_entregue, dias_para_entrega, flag_antes_vencimento, flag_dentro_coordenada,
round(distancia_metros, 4) AS distancia_metros FROM deliveries""",
)
q(
    "fact_delivery_coordinates",
    lambda s, d: gold.fact_delivery_coordinates(_delivery_fact(s, d)).withColumn("distancia_media", F.round("distancia_media", 4)),
    _DELIVERIES,
    f"""SELECT md5(CAST(data_emissao AS VARCHAR) || '-' || uf) AS sk_tempo, {sk("cod_base")} AS sk_base, count(*) AS tentativas_entrega,
sum(flag_dentro_coordenada::BIGINT)::BIGINT AS entregas_dentro_coordenada,
round(sum(flag_dentro_coordenada::INT) * 100.0 / count(*), 2) AS taxa_coordenada_pct, round(avg(distancia_metros), 4)
AS distancia_media FROM deliveries GROUP BY 1, 2""",
)


def _payment_fact(spark, sf):
    dims = _dims(spark, sf)
    return gold.fact_payments(silver.payments(op.payments(spark, sf), op.REFERENCE).drop("cod_base"), dims["tempo"], dims["uc"], dims["base"])


_PAYFACT = f"""SELECT md5(CAST(data_vencimento AS VARCHAR) || '-' || uf) AS sk_tempo, {sk("cod_uc")} AS sk_uc, {sk("cod_base")} AS sk_base,
cod_pagamento, cod_fatura, round(valor_fatura, 6) AS valor_fatura, round(valor_pago, 6) AS valor_pago, flag_inadimplente,
dias_atraso_pagamento FROM payments"""
q("fact_payments", _payment_fact, _PAYMENTS, _PAYFACT)
q(
    "saved_unpaid_90_days", lambda s, d: _payment_fact(s, d).filter("flag_inadimplente AND dias_atraso_pagamento >= 90"),
    _PAYMENTS, _PAYFACT + " WHERE flag_inadimplente AND dias_atraso_pagamento >= 90",
)
q(
    "saved_late_notes", lambda s, d: _fact(s, d).filter("flag_atrasada").select("cod_nota", "dias_atraso"), _NOTES,
    "SELECT cod_nota, dias_atraso FROM notes WHERE status_atraso = 'ATRASADO'",
)
q(
    "saved_deliveries_outside",
    lambda s, d: _delivery_fact(s, d).filter("NOT flag_dentro_coordenada").select("cod_entrega", "cod_fatura"), _DELIVERIES,
    "SELECT cod_entrega, cod_fatura FROM deliveries WHERE NOT flag_dentro_coordenada",
)
q(
    "fact_targets",
    lambda s, d: (lambda dims: gold.fact_targets(silver.targets(op.targets(s, d)), dims["tempo"], dims["base"]))(_dims(s, d)),
    _TARGETS,
    f"""SELECT md5(mes_referencia || '-01-' || uf) AS sk_tempo, {sk("cod_base")} AS sk_base, indicador, mes_referencia,
round(valor_meta, 6) AS valor_meta, round(valor_realizado, 6) AS valor_realizado, round(pct_atingimento, 6) AS pct_atingimento,
status_meta, round(valor_meta - valor_realizado, 6) AS gap_absoluto FROM targets""",
)


def _error_fact(spark, sf):
    c = b.complaints(spark, sf)
    return gold.fact_reading_errors(c, gold.dim_region(c), gold.dim_cause(c))


_ERR = """
err AS (SELECT *, CAST(dt_ingresso AS DATE) AS data_ingresso, _source_region AS regiao FROM complaints
  WHERE _data_type <> 'reclamacao_total')"""
q(
    "fact_reading_errors", _error_fact, COMPLAINTS, _ERR,
    f"""SELECT {sk("regiao")} AS sk_regiao, {sk("coalesce(causa_raiz, 'NAO_CLASSIFICADA')")} AS sk_causa_raiz, ordem, instalacao,
assunto, data_ingresso, status, causa_raiz, regiao, flag_resolvido_com_refaturamento,
flag_resolvido_com_refaturamento::INT AS qtd_refaturamento, 1 AS qtd_erros FROM err""",
)
q(
    "reading_error_hotspots", lambda s, d: gold.hotspots(_error_fact(s, d)), COMPLAINTS, _ERR,
    "SELECT regiao, coalesce(causa_raiz, 'NAO_CLASSIFICADA') AS classe_erro, data_ingresso AS data, count(*) AS qtd_erros "
    "FROM err GROUP BY 1, 2, 3",
)
q(
    "reading_error_patterns", lambda s, d: gold.patterns(_error_fact(s, d)), COMPLAINTS, _ERR,
    "SELECT coalesce(causa_raiz, 'NAO_CLASSIFICADA') AS topic_name, data_ingresso AS data, count(*) AS quantidade, "
    "round(count(*) * 100.0 / (SELECT count(*) FROM err), 2) AS percentual FROM err GROUP BY 1, 2",
)


def _classified(spark, sf):
    c = b.complaints(spark, sf).filter("_source_region = 'CE'")
    rows = c.filter(~F.coalesce(F.upper("assunto").rlike("OUV|OUVIDORIA|JURID|3º NIVEL|3 NIVEL|GOV"), F.lit(False)))
    themed = rows.withColumns(th.themed_rules(F.col("assunto"), F.col("devolutiva")))
    return gold.classified(themed.select(
        "ordem", "linha", F.col("dt_ingresso").alias("data_ingresso"), "macrotema", "causa_raiz_inferida", "is_root_cause",
        "ind_refaturamento", F.col("_source_region").alias("regiao"),
    ))


_CLS = """
cl0 AS (SELECT *, lower(coalesce(assunto, '') || ' ' || coalesce(devolutiva, '')) AS t FROM complaints
  WHERE _source_region = 'CE' AND NOT coalesce(regexp_matches(upper(assunto), 'OUV|OUVIDORIA|JURID|3º NIVEL|3 NIVEL|GOV'), false)),
cl1 AS (SELECT *, contains(t, 'refatur') OR contains(t, 'cobrança') OR contains(t, 'cobranca') AS bil,
  contains(t, 'erro') AND (contains(t, 'leitura') OR contains(t, 'digita')) AS ty,
  contains(t, 'estim') OR contains(t, 'media') OR contains(t, 'média') AS av, contains(t, 'corretivo') AS co,
  contains(t, 'gd') OR contains(t, 'geracao') OR contains(t, 'geração') OR contains(t, 'microgeracao') AS ge,
  contains(t, 'religa') OR contains(t, 'corte') OR contains(t, 'multa') AS re,
  contains(t, 'consumo') AND (contains(t, 'alto') OR contains(t, 'elevado') OR contains(t, 'variacao')) AS cs FROM cl0),
cls1 AS MATERIALIZED (SELECT ordem, linha, dt_ingresso AS data_ingresso, _source_region AS regiao,
  CASE WHEN bil AND NOT ty AND av THEN 'Faturamento por Média/Estim.' WHEN bil THEN 'Refaturamento & Cobrança'
    WHEN ge THEN 'Geração Distribuída (GD)' WHEN re THEN 'Religação & Multas' WHEN cs THEN 'Variação de Consumo'
    ELSE 'Outros' END AS macrotema,
  CASE WHEN bil AND ty THEN 'digitacao' WHEN bil AND av THEN 'leitura_estimada_media' WHEN bil AND co
    THEN 'refaturamento_corretivo' WHEN bil THEN 'indefinido' WHEN ge THEN 'compensacao_gd' WHEN re THEN 'indefinido'
    WHEN cs THEN 'consumo_elevado_revisao' ELSE 'indefinido' END AS causa_raiz_inferida,
  bil AND (ty OR av OR co) AS is_root_cause,
  CASE WHEN bil AND (ty OR (NOT av AND co)) THEN 1.0 ELSE 0.0 END AS ind_refaturamento FROM cl1)"""
q(
    "classified_complaints", _classified, COMPLAINTS, _CLS,
    "SELECT *, CASE WHEN is_root_cause AND ind_refaturamento = 1 THEN 'high' WHEN is_root_cause THEN 'medium' ELSE 'low' END "
    "AS criticidade_operacional FROM cls1",
)
q(
    "monthly_themes", lambda s, d: gold.monthly_themes(_classified(s, d)), COMPLAINTS, _CLS,
    "SELECT CAST(date_trunc('month', data_ingresso) AS DATE) AS mes, regiao, macrotema, count(*) AS total_reclamacoes, "
    "sum(ind_refaturamento)::DOUBLE AS total_refaturamentos, round(sum(ind_refaturamento) / count(*), 6) AS pct_refaturamento "
    "FROM cls1 GROUP BY 1, 2, 3",
)
q(
    "cause_pareto", lambda s, d: gold.cause_pareto(_classified(s, d)), COMPLAINTS, _CLS,
    "SELECT regiao, macrotema, causa_raiz_inferida, count(*) AS qtd_ocorrencias, sum(ind_refaturamento)::DOUBLE AS qtd_refaturamento, "
    "round(sum(ind_refaturamento) / count(*), 6) AS pct_refaturamento FROM cls1 WHERE is_root_cause GROUP BY 1, 2, 3",
)

# ---- upserts and history --------------------------------------------------------------------------------------
_ORD = "o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority"


def _orders(spark, sf):
    return b.table(spark, sf, "orders")


q(
    "incremental_upsert",
    lambda s, d: upsert.merge(
        _orders(s, d).filter("o_orderdate < '1999-01-01'").withColumn("o_orderstatus", F.lit("X")),
        _orders(s, d).filter("o_orderdate >= '1998-06-01'"), ["o_orderkey"],
    ),
    f"SELECT {_ORD} FROM orders WHERE o_orderdate >= '1998-06-01' UNION ALL SELECT o_orderkey, o_custkey, 'X', "
    "round(o_totalprice, 6), o_orderdate, o_orderpriority FROM orders WHERE o_orderdate < '1998-06-01'",
)
q(
    "changed_since_load",
    lambda s, d: upsert.changed_since(
        _orders(s, d), _orders(s, d).filter("o_orderstatus = 'F'").withColumn("l", F.col("o_orderdate") - F.expr("INTERVAL 1 YEAR")),
        "o_orderdate", "l",
    ),
    f"SELECT {_ORD} FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 1 YEAR FROM orders WHERE o_orderstatus = 'F')",
)
q(
    "insert_only_months",
    lambda s, d: upsert.insert_only(
        op.targets(s, d).filter("mes_referencia < '1999-01'"), op.targets(s, d), "mes_referencia"
    ).drop("indicador"),
    _TARGETS,
    "SELECT cod_base, uf, mes_referencia, round(valor_meta, 6) AS valor_meta, round(valor_realizado, 6) AS valor_realizado "
    "FROM targets WHERE mes_referencia >= '1999-01'",
)
q(
    "customer_status_history",
    lambda s, d: upsert.history(
        _orders(s, d).groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderstatus").alias("o_orderstatus")),
        ["o_custkey"], "o_orderdate", ["o_orderstatus"],
    ),
    """WITH v AS (SELECT o_custkey, o_orderdate, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1, 2),
c AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS p FROM v)
SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to,
lead(o_orderdate) OVER w IS NULL AS is_current FROM c WHERE p IS NULL OR p <> o_orderstatus
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""",
)

# ---- documented metrics ---------------------------------------------------------------------------------------
q(
    "delivery_metrics", lambda s, d: metrics.delivery_metrics(silver.deliveries(op.deliveries(s, d)), "cod_distribuidora"), _DELIVERIES,
    """SELECT cod_distribuidora, count(*) AS emitidas, round(count(*) FILTER (flag_entregue) * 100.0 / count(*), 2) AS taxa_entrega_pct,
round(avg(dias_para_entrega), 4) AS prazo_medio_dias, round(count(*) FILTER (flag_antes_vencimento) * 100.0 /
count(*) FILTER (flag_entregue), 2) AS taxa_antes_vencimento_pct, round(count(*) FILTER (flag_dentro_coordenada) * 100.0 / count(*), 2)
AS taxa_coordenada_pct FROM deliveries GROUP BY 1""",
)
q(
    "effectiveness_metrics", lambda s, d: metrics.effectiveness(op.silver_notes(s, d), "cod_base"), _NOTES,
    """SELECT cod_base, count(*) AS atribuidas, round(count(*) FILTER (status IN ('EXECUTADA','FECHADA')) * 100.0 / count(*), 2)
AS efetividade_bruta_pct, round(count(*) FILTER (status IN ('EXECUTADA','FECHADA') AND status_atraso = 'NO_PRAZO') * 100.0 / count(*), 2)
AS efetividade_liquida_pct, round(count(*) FILTER (status = 'DEVOLVIDA') * 100.0 / count(*), 2) AS taxa_devolucao_pct,
round(count(*) FILTER (status_atraso IN ('ATRASADO','PENDENTE_FORA_PRAZO')) * 100.0 / count(*), 2) AS taxa_atraso_pct,
round(avg(dias_atraso) FILTER (dias_atraso > 0), 4) AS atraso_medio_dias FROM notes GROUP BY 1""",
)
q(
    "worker_productivity", lambda s, d: metrics.worker_productivity(op.silver_notes(s, d)), _NOTES,
    """SELECT cod_colaborador, CAST(sum(n) AS BIGINT) AS executadas, count(*) AS dias_ativos, round(avg(n), 6) AS produtividade_media
FROM (SELECT cod_colaborador, data_execucao, count(*) AS n FROM notes WHERE status IN ('EXECUTADA','FECHADA')
AND data_execucao IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
)
q(
    "rework_rate", lambda s, d: metrics.rework(op.silver_notes(s, d)), _NOTES,
    """SELECT count(*) FILTER (n > 1) AS com_retrabalho, count(*) AS total, round(count(*) FILTER (n > 1) * 100.0 / count(*), 2)
AS taxa_retrabalho_pct FROM (SELECT cod_uc, count(*) AS n FROM notes WHERE status IN ('EXECUTADA','FECHADA') GROUP BY 1)""",
)
q(
    "delay_bands", lambda s, d: metrics.delay_bands(op.silver_notes(s, d)), _NOTES,
    """SELECT CASE WHEN dias_atraso <= 0 THEN 'Sem atraso' WHEN dias_atraso <= 3 THEN '1-3 dias' WHEN dias_atraso <= 7 THEN '4-7 dias'
WHEN dias_atraso <= 15 THEN '8-15 dias' WHEN dias_atraso <= 30 THEN '16-30 dias' ELSE '30+ dias' END AS faixa, count(*) AS qtd_notas
FROM notes GROUP BY 1""",
)
q(
    "open_aging", lambda s, d: metrics.open_aging(op.silver_notes(s, d), op.REFERENCE), _NOTES,
    f"""SELECT CASE WHEN {REF} - data_prevista <= 0 THEN 'No prazo' WHEN {REF} - data_prevista <= 7 THEN '1-7 dias vencida'
WHEN {REF} - data_prevista <= 15 THEN '8-15 dias vencida' WHEN {REF} - data_prevista <= 30 THEN '16-30 dias vencida'
ELSE '30+ dias vencida' END AS faixa_aging, count(*) AS qtd_notas FROM notes WHERE status NOT IN ('EXECUTADA','FECHADA','CANCELADA')
GROUP BY 1""",
)
q(
    "default_rate", lambda s, d: metrics.default_rate(op.payments(s, d), op.REFERENCE), _PAYMENTS,
    f"""SELECT count(*) AS ucs, CAST(sum(x) AS BIGINT) AS ucs_inadimplentes, round(sum(x) * 100.0 / count(*), 2) AS taxa_inadimplencia_pct,
round(sum(v), 2) AS valor_inadimplente_total FROM (SELECT cod_uc, max((data_pagamento IS NULL AND data_vencimento < {REF})::INT) AS x,
sum(valor_fatura) FILTER (data_pagamento IS NULL AND data_vencimento < {REF}) AS v FROM payments GROUP BY 1)""",
)
q(
    "debt_aging", lambda s, d: metrics.debt_aging(op.payments(s, d), op.REFERENCE), _PAYMENTS,
    f"""SELECT CASE WHEN k <= 30 THEN '1-30 dias' WHEN k <= 60 THEN '31-60 dias' WHEN k <= 90 THEN '61-90 dias' ELSE '90+ dias' END AS faixa,
count(*) AS faturas, round(sum(valor_fatura), 2) AS valor FROM (SELECT valor_fatura, {REF} - data_vencimento AS k FROM payments
WHERE data_pagamento IS NULL) WHERE k > 0 GROUP BY 1""",
)
q(
    "debt_profiles", lambda s, d: metrics.debt_profiles(op.payments(s, d), op.REFERENCE), _PAYMENTS,
    f"""SELECT CASE WHEN m >= 6 THEN 'CRONICO' WHEN m >= 3 THEN 'RECORRENTE' WHEN m >= 1 THEN 'EVENTUAL' ELSE 'ADIMPLENTE' END
AS perfil_inadimplencia, count(*) AS ucs FROM (SELECT cod_uc, count(DISTINCT date_trunc('month', data_vencimento)) FILTER (
(data_pagamento IS NULL OR data_pagamento > data_vencimento) AND data_vencimento > {REF} - INTERVAL 12 MONTH
AND data_vencimento <= {REF}) AS m FROM payments GROUP BY 1) GROUP BY 1""",
)
q(
    "target_projection", lambda s, d: metrics.target_projection(op.targets(s, d), op.calendar(s, d), "1998-06-10"), _TARGETS, _CAL,
    """, m AS (SELECT ano_mes, uf, count(*) FILTER (data <= DATE '1998-06-10') AS decorridos, count(*) FILTER (data > DATE '1998-06-10')
  AS restantes FROM calendar WHERE flag_dia_util GROUP BY 1, 2),
p AS (SELECT *, (valor_realizado + valor_realizado / nullif(decorridos, 0) * restantes) / valor_meta * 100 AS pp
  FROM targets JOIN m ON m.ano_mes = mes_referencia AND m.uf = targets.uf)
SELECT cod_base, mes_referencia, decorridos, restantes, round(valor_meta - valor_realizado, 6) AS gap_absoluto,
round((valor_meta - valor_realizado) * 100.0 / valor_meta, 2) AS gap_pct, round(pp, 6) AS pct_projecao,
CASE WHEN pp >= 100 THEN 'NO_CAMINHO' WHEN pp >= 95 THEN 'ATENCAO' WHEN pp >= 85 THEN 'RISCO' ELSE 'CRITICO' END AS status_risco_meta FROM p""",
)
_READS = """
reads AS (SELECT o_custkey AS cod_uc, l_returnflag <> 'R' AS flag_lido, o_orderpriority AS motivo_nao_leitura,
  CAST(l_shipdate AS DATE) AS data_referencia FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
q(
    "unread_reasons", lambda s, d: metrics.unread_reasons(op.reads(s, d)), _READS,
    "SELECT motivo_nao_leitura, count(*) AS ocorrencias, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM reads "
    "WHERE NOT flag_lido GROUP BY 1",
)
q(
    "unread_rate", lambda s, d: metrics.unread_rate(op.reads(s, d), "cod_uc"), _READS,
    "SELECT cod_uc, count(*) AS tentativas, round(count(*) FILTER (NOT flag_lido) * 100.0 / count(*), 2) AS taxa_nao_lidos_pct "
    "FROM reads GROUP BY 1",
)
q(
    "repeat_unread", lambda s, d: metrics.repeat_unread(op.reads(s, d), op.REFERENCE), _READS,
    f"SELECT cod_uc, count(*) AS meses_nao_lido FROM reads WHERE NOT flag_lido AND data_referencia >= {REF} - INTERVAL 6 MONTH "
    "GROUP BY 1 HAVING count(*) >= 3",
)
_LEVELS = ["cod_distribuidora", "cod_ut", "cod_co", "cod_base", "cod_lote", "cod_colaborador"]
_PERIODS = {"ano": "year(dia)", "trimestre": "date_trunc('quarter', dia)::DATE", "mes": "date_trunc('month', dia)::DATE",
            "semana": "date_trunc('week', dia)::DATE", "dia": "dia"}
_CELLS = f""", hn AS (SELECT cod_distribuidora, cod_ut, cod_base % 5 AS cod_co, cod_base, cod_lote, cod_colaborador, cod_uc, status_atraso, dias_atraso, dia,
  {", ".join(f"{x} AS {n}" for n, x in _PERIODS.items() if n != "dia")} FROM (SELECT *, CAST(data_criacao AS DATE) AS dia FROM notes))"""


def _cells_sql(periods) -> str:
    return f"""SELECT {", ".join(_LEVELS)}, {", ".join(periods)}, {" + ".join(f"grouping({c})" for c in _LEVELS)} AS nivel, {" + ".join(f"grouping({c})" for c in periods)} AS periodo,
count(*) AS total, count(*) FILTER (status_atraso = 'ATRASADO') AS atrasadas, CAST(sum(dias_atraso) AS BIGINT) AS dias_atraso, count(DISTINCT cod_uc) AS unidades
FROM hn GROUP BY ROLLUP ({", ".join(_LEVELS)}), ROLLUP ({", ".join(periods)})"""


def _cells(spark, sf, *periods):
    return metrics.rollup(op.silver_notes(spark, sf).withColumn("cod_co", F.pmod("cod_base", F.lit(5))), _LEVELS, "data_criacao", periods)


q("hierarchy_rollup", lambda s, d: _cells(s, d, "ano"), _NOTES, _CELLS + " " + _cells_sql(["ano"]))
q(
    "hierarchy_calendar_totals",
    lambda s, d: _cells(s, d, *metrics.PERIODS).groupBy("nivel", "periodo").agg(
        F.count(F.lit(1)).alias("celulas"), F.sum("total").alias("total"), F.sum("atrasadas").alias("atrasadas"), F.sum("dias_atraso").alias("dias_atraso"),
        F.sum("unidades").alias("unidades"), F.max("unidades").alias("maior"),
    ),
    _NOTES,
    _CELLS + f", ce AS ({_cells_sql(_PERIODS)}) SELECT nivel, periodo, count(*) AS celulas, CAST(sum(total) AS BIGINT) AS total, CAST(sum(atrasadas) AS BIGINT) AS atrasadas, "
    "CAST(sum(dias_atraso) AS BIGINT) AS dias_atraso, CAST(sum(unidades) AS BIGINT) AS unidades, max(unidades) AS maior FROM ce GROUP BY 1, 2",
)


def _incidents(spark, sf):
    """JN23: installations with at least two incidents in the last twelve months, counted before the join."""
    n = op.notes(spark, sf)
    ref = F.lit(op.REFERENCE).cast("date")
    recent = n.filter((F.col("status") == "DEVOLVIDA") & (F.col("data_criacao") >= F.add_months(ref, -12)) & (F.col("data_criacao") <= ref))
    hot = recent.groupBy("cod_uc").agg(F.count(F.lit(1)).alias("incidentes")).filter("incidentes >= 2")
    return n.filter(F.col("data_criacao") > ref).join(hot, "cod_uc").groupBy("cod_uc", "incidentes").agg(F.count(F.lit(1)).alias("notas"))


q(
    "recent_incidents", _incidents, _NOTES,
    f""", h AS (SELECT cod_uc, count(*) AS incidentes FROM notes WHERE status = 'DEVOLVIDA' AND data_criacao >= {REF} - INTERVAL 12 MONTH
  AND data_criacao <= {REF} GROUP BY 1 HAVING count(*) >= 2)
SELECT cod_uc, incidentes, count(*) AS notas FROM notes JOIN h USING (cod_uc) WHERE data_criacao > {REF} GROUP BY 1, 2""",
)


def _risk_areas(spark, sf):
    """One triangle per region key over the coordinate range of the deliveries; the last one is inactive."""
    k = F.col("r_regionkey") * 0.02
    corner = lambda dx, dy: F.struct((F.lit(-23.5) + k + dx).alias("x"), (F.lit(-46.6) + k + dy).alias("y"))
    return b.table(spark, sf, "region").select(
        F.array(corner(-0.0051, -0.0049), corner(0.0253, -0.0047), corner(0.0049, 0.0301)).alias("ring"), (F.col("r_regionkey") < 4).alias("ativa")
    )


def _in_risk_areas(spark, sf):
    from wattlake.operators.areas import in_areas

    points = op.deliveries(spark, sf).select("cod_entrega", F.col("lat_entrega").alias("x"), F.col("lon_entrega").alias("y"))
    return in_areas(points, _risk_areas(spark, sf), "x", "y", 0.01).groupBy(F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )


_SIDE = "(px - {bx}) * ({ay} - {by}) - ({ax} - {bx}) * (py - {by})"
q(
    "deliveries_in_risk_areas", _in_risk_areas, _DELIVERIES,
    ", r AS (SELECT -23.5 + r_regionkey * 0.02 AS x0, -46.6 + r_regionkey * 0.02 AS y0 FROM region WHERE r_regionkey < 4), "
    "t AS (SELECT x0 - 0.0051 AS ax, y0 - 0.0049 AS ay, x0 + 0.0253 AS bx, y0 - 0.0047 AS by1, x0 + 0.0049 AS cx, y0 + 0.0301 AS cy FROM r), "
    "p AS (SELECT cod_entrega, la AS px, lo AS py FROM deliveries), "
    "h AS (SELECT px, py FROM p WHERE EXISTS (SELECT 1 FROM t WHERE "
    + " AND ".join(
        _SIDE.format(ax=a, ay=ay, bx=bx, by=by) + " > 0"
        for a, ay, bx, by in (("ax", "ay", "bx", "by1"), ("bx", "by1", "cx", "cy"), ("cx", "cy", "ax", "ay"))
    )
    + ")) SELECT round(px, 2) AS x, round(py, 2) AS y, count(*) AS n FROM h GROUP BY 1, 2",
)
