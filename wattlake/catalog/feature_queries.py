"""Feature sets, hotspots, drift and models."""

from __future__ import annotations

import datetime as dt
import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake import bindings as b
from wattlake import operations as op
from wattlake import runtime
from wattlake.catalog.base import add
from wattlake.catalog.operation_queries import _NOTES, _PAYMENTS, _TARGETS, q
from wattlake.catalog.sqlparts import COMPLAINTS, canonical_label, classifier_ctes
from wattlake.functions import taxonomy as tax
from wattlake.operators import pages
from wattlake.plans import features as ft
from wattlake.plans import models as ml
from wattlake.plans import quality
from wattlake.plans import textmodels as tm

OBS = "1999-06-30"
_O = f"DATE '{OBS}'"

_DELAY = [
    "cod_nota", "dias_ate_vencimento", "dia_semana_criacao", "dia_semana_previsto", "flag_fim_de_mes", "qtd_notas_uc_90d",
    "taxa_atraso_uc_90d", "media_dias_ate_vencimento_uc", "max_dias_ate_vencimento_uc", "qtd_devolucoes_uc_90d",
    "taxa_atraso_base_7d", "volume_notas_base_7d", "efetividade_base_7d", "taxa_atraso_base_30d", "colaboradores_ativos_30d",
    "taxa_atraso_colaborador_30d", "produtividade_colaborador_dia", "carga_colaboradores_base", "target_flag_atraso",
    "target_dias_atraso",
]
q(
    "delay_features", lambda s, d: ft.delay_features(op.notes(s, d), OBS).select(*_DELAY), _NOTES,
    f""", f AS (SELECT *, coalesce(data_prevista - data_criacao, 0)::DOUBLE AS dv FROM notes WHERE data_criacao <= {_O} AND status <> 'CANCELADA'),
u AS (SELECT cod_uc, count(*) AS n, avg((status = 'DEVOLVIDA')::INT) AS t, avg(dv) AS m, max(dv) AS x, count(*) FILTER (status = 'DEVOLVIDA') AS k
  FROM f WHERE data_criacao >= {_O} - 90 GROUP BY 1),
b7 AS (SELECT cod_base, avg((status = 'DEVOLVIDA')::INT) AS t, count(*) AS n, avg((status IN ('EXECUTADA','FECHADA'))::INT) AS e
  FROM f WHERE data_criacao >= {_O} - 7 GROUP BY 1),
b30 AS (SELECT cod_base, avg((status = 'DEVOLVIDA')::INT) AS t, count(DISTINCT cod_colaborador) AS n FROM f WHERE data_criacao >= {_O} - 30 GROUP BY 1),
w AS (SELECT cod_colaborador, avg((status = 'DEVOLVIDA')::INT) AS t, count(*) / 30.0 AS p FROM f WHERE data_criacao >= {_O} - 30 GROUP BY 1)
SELECT cod_nota, dv AS dias_ate_vencimento, (isodow(data_criacao) - 1)::INT AS dia_semana_criacao,
  coalesce(isodow(data_prevista) - 1, 0)::INT AS dia_semana_previsto, coalesce((day(data_prevista) >= 25)::INT, 0) AS flag_fim_de_mes,
  coalesce(u.n, 0)::DOUBLE AS qtd_notas_uc_90d, round(coalesce(u.t, 0), 6) AS taxa_atraso_uc_90d,
  round(coalesce(u.m, 0), 6) AS media_dias_ate_vencimento_uc, coalesce(u.x, 0)::DOUBLE AS max_dias_ate_vencimento_uc,
  coalesce(u.k, 0)::DOUBLE AS qtd_devolucoes_uc_90d, round(coalesce(b7.t, 0), 6) AS taxa_atraso_base_7d,
  coalesce(b7.n, 0)::DOUBLE AS volume_notas_base_7d, round(coalesce(b7.e, 0), 6) AS efetividade_base_7d,
  round(coalesce(b30.t, 0), 6) AS taxa_atraso_base_30d, coalesce(b30.n, 0)::DOUBLE AS colaboradores_ativos_30d,
  round(coalesce(w.t, 0), 6) AS taxa_atraso_colaborador_30d, round(coalesce(w.p, 0), 6) AS produtividade_colaborador_dia,
  round(coalesce(b7.n, 0) / coalesce(nullif(b30.n, 0), 1), 6) AS carga_colaboradores_base,
  (status = 'DEVOLVIDA')::INT AS target_flag_atraso,
  coalesce(greatest(coalesce(data_execucao, {_O}) - data_prevista, 0), 0)::DOUBLE AS target_dias_atraso
FROM f LEFT JOIN u USING (cod_uc) LEFT JOIN b7 USING (cod_base) LEFT JOIN b30 USING (cod_base) LEFT JOIN w USING (cod_colaborador)""",
)

_DEF = [
    "cod_pagamento", "dias_atraso_pagamento", "flag_inadimplente", "mes_referencia", "trimestre_referencia",
    *[f"{p}_uc_{m}m" for m in (3, 6, 12) for p in ("qtd_faturas", "taxa_inadimplencia", "media_dias_atraso")],
    "taxa_inadimplencia_base", "valor_medio_base",
]
_PAYF = f"""
pf AS MATERIALIZED (SELECT *, greatest(coalesce(data_pagamento, {_O}) - data_vencimento, 0)::DOUBLE AS da,
  (data_pagamento IS NULL OR data_pagamento > data_vencimento)::INT AS fl FROM payments WHERE data_vencimento <= {_O})"""


def _hist(m: int) -> str:
    return f"""(SELECT cod_uc, count(*) AS n, avg(fl) AS t, avg(da) AS a FROM pf WHERE data_vencimento >= {_O} - {30 * m} GROUP BY 1) h{m}"""


q(
    "default_features",
    lambda s, d: ft.default_features(op.payments(s, d), OBS, op.masters(s, d)["uc"]).select(*_DEF), _PAYMENTS, _PAYF,
    f""", r AS (SELECT cod_base, avg(fl) AS t, avg(valor_fatura) AS v FROM pf GROUP BY 1)
SELECT cod_pagamento, da AS dias_atraso_pagamento, fl AS flag_inadimplente, month(data_vencimento)::INT AS mes_referencia,
quarter(data_vencimento)::INT AS trimestre_referencia, """
    + ", ".join(
        f"coalesce(h{m}.n, 0)::DOUBLE AS qtd_faturas_uc_{m}m, round(coalesce(h{m}.t, 0), 6) AS taxa_inadimplencia_uc_{m}m, "
        f"round(coalesce(h{m}.a, 0), 6) AS media_dias_atraso_uc_{m}m"
        for m in (3, 6, 12)
    )
    + f""", round(r.t, 6) AS taxa_inadimplencia_base, round(r.v, 6) AS valor_medio_base FROM pf LEFT JOIN {_hist(3)} USING (cod_uc)
LEFT JOIN {_hist(6)} USING (cod_uc) LEFT JOIN {_hist(12)} USING (cod_uc) JOIN r USING (cod_base)""",
)
q(
    "unpaid_runs",
    lambda s, d: ft.run_lengths(
        # Line keys repeat in the given tables: value and payment date make the order total up to equal rows.
        op.payments(s, d), "cod_uc", [F.col(c) for c in ("data_vencimento", "cod_pagamento", "valor_fatura", "data_pagamento")],
        F.col("data_pagamento").isNull() | (F.col("data_pagamento") > F.col("data_vencimento")), F.trunc("data_vencimento", "month"),
    ).select("cod_pagamento", "cod_uc", "run_length"),
    _PAYMENTS,
    """, p AS (SELECT *, (data_pagamento IS NULL OR data_pagamento > data_vencimento)::INT AS fl, row_number() OVER (PARTITION BY cod_uc
  ORDER BY data_vencimento, cod_pagamento, valor_fatura, data_pagamento NULLS FIRST) AS k FROM payments),
g AS (SELECT *, sum(1 - fl) OVER (PARTITION BY cod_uc ORDER BY k) AS isl FROM p)
SELECT cod_pagamento, cod_uc, CASE WHEN fl = 0 THEN 0 ELSE CAST(sum(fl) OVER (PARTITION BY cod_uc, isl ORDER BY k) AS BIGINT) END AS run_length
FROM g""",
)
q(
    "target_features",
    lambda s, d: ft.target_features(op.targets(s, d), OBS).select(
        "cod_base", "mes_referencia", "pct_atingimento", "lag_1_pct", "lag_3_media_pct", "gap_meta", "tendencia_mensal", "target_flag_risco"
    ),
    _TARGETS,
    f""", t AS (SELECT cod_base, CAST(mes_referencia || '-01' AS DATE) AS mes_referencia, valor_meta - valor_realizado AS g,
  least(200, greatest(0, valor_realizado * 100 / valor_meta)) AS p FROM targets WHERE mes_referencia <= strftime({_O}, '%Y-%m'))
SELECT cod_base, mes_referencia, round(p, 6) AS pct_atingimento, round(coalesce(lag(p) OVER w, 0), 6) AS lag_1_pct,
round(avg(p) OVER (PARTITION BY cod_base ORDER BY mes_referencia ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS lag_3_media_pct,
round(g, 6) AS gap_meta, round(coalesce(p - lag(p) OVER w, 0), 6) AS tendencia_mensal, (p < 90)::INT AS target_flag_risco
FROM t WINDOW w AS (PARTITION BY cod_base ORDER BY mes_referencia)""",
)
q(
    "anomaly_features",
    lambda s, d: ft.anomaly_features(op.notes(s, d), OBS, op.payments(s, d)).drop("_observation_date"), _NOTES, _PAYMENTS,
    f""", n AS (SELECT cod_base AS entidade_id, count(*)::DOUBLE AS a, avg((status = 'DEVOLVIDA')::INT) AS b, avg((status = 'CANCELADA')::INT) AS c
  FROM notes WHERE data_criacao <= {_O} GROUP BY 1),
p AS (SELECT cod_base AS entidade_id, avg((data_pagamento IS NULL OR data_pagamento > data_vencimento)::INT) AS e FROM payments
  WHERE data_vencimento <= {_O} GROUP BY 1), j AS (SELECT n.*, p.e FROM n LEFT JOIN p USING (entidade_id))
SELECT entidade_id, a AS total_notas, round(b, 6) AS taxa_devolucao, round(c, 6) AS taxa_cancelamento, round(e, 6) AS taxa_inadimplencia,
round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS total_notas_zscore, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6)
AS taxa_devolucao_zscore, round((c - avg(c) OVER ()) / stddev_pop(c) OVER (), 6) AS taxa_cancelamento_zscore,
round((e - avg(e) OVER ()) / stddev_pop(e) OVER (), 6) AS taxa_inadimplencia_zscore FROM j""",
)
# The distance of each row of z from the mean of all, less the quantile that leaves a tenth above it.
UNUSUAL = """ f AS (SELECT *, round(sqrt(pow((qtd_erros - avg(qtd_erros) OVER ()) / stddev_pop(qtd_erros) OVER (), 2) + pow((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 2)
  + pow((zs - avg(zs) OVER ()) / stddev_pop(zs) OVER (), 2)), 9) AS far FROM z),
u AS (SELECT *, round(far - (SELECT quantile_cont(far, 0.9) FROM f), 9) AS score FROM f)"""
q(
    "daily_hotspots",
    lambda s, d: ft.daily_hotspots(
        b.table(s, d, "events").withColumn("classe", F.get_json_object("props", "$.k")), "ts", "event_type", "classe"),
    """WITH c AS (SELECT CAST(ts AS DATE) AS data, event_type AS regiao, json_extract_string(props, '$.k') AS classe_erro,
count(*) AS qtd_erros FROM events GROUP BY 1, 2, 3),
r AS (SELECT *, avg(qtd_erros) OVER w AS m, coalesce(stddev_samp(qtd_erros) OVER w, 0) AS sd FROM c
  WINDOW w AS (PARTITION BY regiao, classe_erro ORDER BY data ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (qtd_erros - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS zs FROM r),""" + UNUSUAL + """
SELECT data, regiao, classe_erro, qtd_erros, round(m, 6) AS rolling_mean_7d, round(sd, 6) AS rolling_std_7d, round(zs, 6) AS zscore,
round(score, 6) AS anomaly_score, score > 0 OR abs(zs) >= 3 AS is_anomaly FROM u""",
)


def _halves(spark, sf):
    e = b.table(spark, sf, "events").withColumn("hora", F.hour("ts").cast("double"))
    return e.filter("ts < '2024-01-16'"), e.filter("ts >= '2024-01-16'").withColumn("value", F.col("value") * 1.2)


def _psi_sql(column: str, ref: str, cur: str) -> str:
    return f"""SELECT '{column}' AS feature_name, coalesce(sum((c - r) * ln(c / r)), 0) AS s FROM (
SELECT i, greatest(count(*) FILTER (src = 0) / (SELECT count(*) FROM ev WHERE src = 0), 1e-6) AS r,
greatest(count(*) FILTER (src = 1) / (SELECT count(*) FROM ev WHERE src = 1), 1e-6) AS c FROM (
  SELECT range AS i FROM range(1, (SELECT len(e) FROM ed_{column}))) b LEFT JOIN (SELECT src, least(len(list_filter(e, lambda x: x <= {column})),
  len(e) - 1) AS bin FROM ev, ed_{column} WHERE {column} BETWEEN e[1] AND e[-1]) h ON h.bin = b.i GROUP BY i)"""


q(
    "psi_drift", lambda s, d: ft.drift(*_halves(s, d), ["value", "hora"]),
    """
ev AS MATERIALIZED (SELECT CASE WHEN ts < '2024-01-16' THEN 0 ELSE 1 END AS src, CASE WHEN ts < '2024-01-16' THEN value ELSE value * 1.2 END AS value,
  hour(ts)::DOUBLE AS hora FROM events)""",
    *[
        f"""ed_{c} AS MATERIALIZED (SELECT list_sort(list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
FROM ev WHERE src = 0)"""
        for c in ("value", "hora")
    ],
    f"""SELECT feature_name, round(s, 6) AS drift_score, CASE WHEN s < 0.1 THEN 'STABLE' WHEN s < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END AS status
FROM ({_psi_sql("value", "", "")} UNION ALL {_psi_sql("hora", "", "")})""",
)
q(
    "score_explanations",
    lambda s, d: ft.explanations(
        b.table(s, d, "lineitem").groupBy("l_orderkey").agg(
            F.round(F.sum("l_quantity"), 2).alias("quantidade"), F.round(-F.sum("l_discount") * 1000, 2).alias("desconto"),
            F.count(F.lit(1)).alias("linhas"), F.round(F.max("l_tax") * 100, 2).alias("imposto")),
        ["quantidade", "desconto", "linhas", "imposto"],
    ).select(
        "l_orderkey", F.concat_ws(";", F.transform(ft.parse_explanations(F.col("explanations")),
            lambda e: F.concat_ws(":", e["feature_name"], e["direction"]))).alias("explicacao")),
    """WITH a AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS q, round(-sum(l_discount) * 1000, 2) AS d, count(*)::DOUBLE AS n,
round(max(l_tax) * 100, 2) AS t FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, unnest([{'i': 0, 'n': 'quantidade', 'v': q}, {'i': 1, 'n': 'desconto', 'v': d}, {'i': 2, 'n': 'linhas', 'v': n},
  {'i': 3, 'n': 'imposto', 'v': t}]) AS e FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY -abs(e.v), e.i) AS rn FROM u)
SELECT l_orderkey, string_agg(e.n || ':' || CASE WHEN e.v >= 0 THEN 'AUMENTA_RISCO' ELSE 'DIMINUI_RISCO' END, ';' ORDER BY rn) AS explicacao
FROM r WHERE rn <= 3 GROUP BY 1""",
)


def _scores(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("entity_id"),
        ((F.col("l_extendedprice") % 1000) / 1000).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


_SC = """
sc AS MATERIALIZED (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS entity_id, (l_extendedprice % 1000) / 1000 AS s,
  (l_returnflag = 'R')::INT AS y FROM lineitem)"""
q(
    "classification_metrics", lambda s, d: ml.binary_metrics(_scores(s, d), "y"), _SC,
    """, r AS (SELECT y, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) AS rk FROM sc),
a AS (SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r),
m AS (SELECT count(*) AS n, sum(y)::DOUBLE AS pos, count(*) FILTER (y = 1 AND s >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND s >= 0.5)::DOUBLE
  AS fp, avg(((s >= 0.5)::INT = y)::INT) AS accuracy, avg((s - y) * (s - y)) AS brier FROM sc)
SELECT n, pos, tp, fp, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round(auc, 6) AS auc_roc, round(tp / pos, 6) AS recall,
round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + pos - tp), 6) AS f1 FROM m, a""",
)
q(
    "recall_at_top_share", lambda s, d: ml.recall_at_share(_scores(s, d), "y"), _SC,
    """SELECT round(sum(y) / (SELECT sum(y) FROM sc), 6) AS recall_at_share FROM (SELECT y FROM sc ORDER BY s DESC, entity_id
LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM sc))""",
)
q(
    "score_validation", lambda s, d: quality.validate_scores(_scores(s, d)), _SC,
    "SELECT count(*) FILTER (s IS NULL) AS nulos, count(*) FILTER (s NOT BETWEEN 0 AND 1) AS fora_do_intervalo, "
    "count(*) FILTER (s IS NULL OR s NOT BETWEEN 0 AND 1) = 0 AS valido FROM sc",
)
q(
    "score_min_max",
    lambda s, d: ml.min_max(b.table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"),
    "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - "
    "min(c_acctbal) OVER ()), 6) AS score FROM customer",
)


def _score_list(spark, sf):
    """Scores with their date and place, written in the order of the list."""
    rows = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cod_base")), "l_suppkey")
    scores = rows.groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("entity_id"), "cod_base", F.col("l_shipdate").cast("date").alias("data_scoring")).agg(
        F.max((F.col("l_extendedprice") % 1000) / 1000).alias("score"))
    version = runtime.dataset_version(spark, [f"{sf}/lineitem.parquet", f"{sf}/supplier.parquet"])
    return runtime.materialise(spark, lambda: pages.sorted_layout(scores, "score", "entity_id", "cod_base", "data_scoring"), "score_list", version)


def _walk(df, score, key, size, where, most):
    found = list(pages.pages(df, score, key, size, where, most))
    return functools.reduce(DataFrame.unionByName, found) if found else df.limit(0).withColumn("pagina", F.lit(0))


_SL = """
sl AS MATERIALIZED (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS entity_id, s_nationkey AS cod_base, CAST(l_shipdate AS DATE) AS data_scoring,
  max((l_extendedprice % 1000) / 1000) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
q(
    "score_page",
    lambda s, d: _walk(_score_list(s, d), "score", "entity_id", 20, pages.conditions(
        equal={"cod_base": 3, "data_scoring": None}, at_least={"score": 0.6, "data_scoring": dt.date(1994, 1, 1)}, at_most={"data_scoring": dt.date(1996, 12, 31)}), 6), _SL,
    "SELECT score, entity_id, cod_base, data_scoring, CAST((rn - 1) // 20 + 1 AS INTEGER) AS pagina FROM (SELECT *, row_number() OVER (ORDER BY score DESC, entity_id) AS rn FROM sl "
    "WHERE cod_base = 3 AND score >= 0.6 AND data_scoring BETWEEN DATE '1994-01-01' AND DATE '1996-12-31') WHERE rn <= 120",
)


def _pattern_list(spark, sf):
    """Event patterns by day: how many, and their share of the day."""
    counts = b.table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("data"), F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("padrao")).agg(
        F.count(F.lit(1)).alias("quantidade"))
    days = counts.groupBy("data").agg(F.sum("quantidade").alias("_n"))
    ready = counts.join(days, "data").select(
        F.concat_ws("|", F.col("data").cast("string"), "padrao").alias("chave"), "data", "quantidade", (F.col("quantidade") * 100.0 / F.col("_n")).alias("percentual"))
    version = runtime.dataset_version(spark, [f"{sf}/events.parquet"])
    return runtime.materialise(spark, lambda: pages.sorted_layout(ready, "quantidade", "chave", "data", "percentual"), "pattern_list", version)


q(
    "pattern_page",
    lambda s, d: _walk(_pattern_list(s, d), "quantidade", "chave", 50, pages.conditions(
        at_least={"data": dt.date(2024, 1, 5)}, at_most={"data": dt.date(2024, 1, 20)}), 8),
    """WITH c AS (SELECT CAST(ts AS DATE) AS data, event_type || '/' || json_extract_string(props, '$.k') AS padrao, count(*) AS quantidade FROM events GROUP BY 1, 2),
p AS (SELECT data || '|' || padrao AS chave, data, quantidade, quantidade * 100.0 / sum(quantidade) OVER (PARTITION BY data) AS percentual FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY quantidade DESC, chave) AS rn FROM p WHERE data BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
SELECT quantidade, chave, data, round(percentual, 6) AS percentual, CAST((rn - 1) // 50 + 1 AS INTEGER) AS pagina FROM r WHERE rn <= 400""",
)


def _hotspot_list(spark, sf):
    found = ft.daily_hotspots(b.table(spark, sf, "events").withColumn("classe", F.get_json_object("props", "$.k")), "ts", "event_type", "classe")
    ready = found.withColumn("chave", F.concat_ws("|", F.col("data").cast("string"), "regiao", "classe_erro")).withColumn("anomaly_score", F.round("anomaly_score", 6))
    version = runtime.dataset_version(spark, [f"{sf}/events.parquet"])
    return runtime.materialise(
        spark, lambda: pages.sorted_layout(ready, "anomaly_score", "chave", "data", "regiao", "classe_erro", "qtd_erros", "is_anomaly"), "hotspot_list", version)


q(
    "hotspot_page",
    lambda s, d: _walk(_hotspot_list(s, d), "anomaly_score", "chave", 25, pages.conditions(
        equal={"regiao": "click"}, at_least={"data": dt.date(2024, 1, 3)}, at_most={"data": dt.date(2024, 1, 25)}), 5),
    """WITH c AS (SELECT CAST(ts AS DATE) AS data, event_type AS regiao, json_extract_string(props, '$.k') AS classe_erro,
count(*) AS qtd_erros FROM events GROUP BY 1, 2, 3),
r AS (SELECT *, avg(qtd_erros) OVER w AS m, coalesce(stddev_samp(qtd_erros) OVER w, 0) AS sd FROM c
  WINDOW w AS (PARTITION BY regiao, classe_erro ORDER BY data ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (qtd_erros - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS zs FROM r),""" + UNUSUAL + """,
h AS (SELECT round(score, 6) AS anomaly_score, data || '|' || regiao || '|' || classe_erro AS chave, data, regiao, classe_erro, qtd_erros, score > 0 OR abs(zs) >= 3 AS is_anomaly FROM u
  WHERE regiao = 'click' AND data BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'),
n AS (SELECT *, row_number() OVER (ORDER BY anomaly_score DESC, chave) AS rn FROM h)
SELECT anomaly_score, chave, data, regiao, classe_erro, qtd_erros, is_anomaly, CAST((rn - 1) // 25 + 1 AS INTEGER) AS pagina FROM n WHERE rn <= 125""",
)
_NUM = ["dias_ate_vencimento", "qtd_notas_uc_90d", "taxa_atraso_uc_90d", "historico_incidentes_12m", "carga_colaboradores_base"]


def _delay_model(spark, sf):
    rows = ft.delay_features(op.notes(spark, sf), OBS)
    train, test = ml.temporal_split(rows, "data_criacao", "1998-06-30")
    model = ml.train_delay(train, _NUM, ["tipo_servico"], "target_flag_atraso")
    return ml.binary_metrics(ml.probability(model, test), "target_flag_atraso")


def _default_model(spark, sf):
    rows = ft.default_features(op.payments(spark, sf), OBS)
    train, test = ml.temporal_split(rows, "data_vencimento", "1998-06-30")
    numeric = ["valor_fatura", "qtd_faturas_uc_12m", "taxa_inadimplencia_uc_12m", "media_dias_atraso_uc_12m"]
    return ml.binary_metrics(ml.probability(ml.train_default(train, numeric, [], "flag_inadimplente"), test), "flag_inadimplente")


def _target_model(spark, sf):
    rows = ft.target_features(op.targets(spark, sf), OBS)
    train, test = ml.temporal_split(rows, "mes_referencia", "1998-06-01")
    model = ml.train_targets(train, ["lag_1_pct", "lag_3_media_pct", "tendencia_mensal"])
    return ml.project_targets(model, test).select("cod_base", "mes_referencia", "projecao_pct", "status_projecao", "score")


add("delay_model_metrics", _delay_model)
add("default_model_metrics", _default_model)
add("target_projection_scores", _target_model)
add(
    "entity_anomaly_scores",
    lambda s, d: ml.anomaly_scores(
        ft.anomaly_features(op.notes(s, d), OBS, op.payments(s, d), _keep(s)), ["total_notas_zscore", "taxa_devolucao_zscore", "taxa_inadimplencia_zscore"]
    ),
)
add("topic_taxonomy", lambda s, d: ml.topic_model(runtime.spread(b.table(s, d, "documents")), "doc_id", "text", 8, _keep(s))[1])


def _weak_labels(spark, sf):
    """ML14: canonical human label, else the class of the answer text."""
    rows = b.complaints(spark, sf).withColumn("_label", tax.canonical_label(F.col("causa_raiz")))
    scored = tax.classify(rows.withColumn("_t", F.when(F.col("_label").isNull(), F.col("devolutiva")).otherwise("")), "_t")
    return scored.groupBy(F.coalesce("_label", "classe").alias("rotulo")).agg(F.count(F.lit(1)).alias("n"))


q(
    "weak_labels", _weak_labels, COMPLAINTS, "src AS (SELECT devolutiva AS txt FROM complaints)", classifier_ctes("src"),
    f"SELECT coalesce({canonical_label('causa_raiz')}, classe) AS rotulo, count(*) AS n FROM complaints JOIN cls ON txt = devolutiva GROUP BY 1",
)


def _text_classifier(spark, sf):
    """ML15: text classifier trained on the documents, as a confusion table."""
    counts = _keep(spark)(ml.text_counts(b.table(spark, sf, "documents").select("text", "lang"), "text", "lang"))
    return ml.train_text(counts, "lang").transform(counts).groupBy("lang", "prediction").agg(F.count(F.lit(1)).alias("n"))


add("text_classifier_confusion", _text_classifier)
add(
    "temporal_cross_validation",
    lambda s, d: ml.cross_validate(
        ft.default_features(op.payments(s, d), OBS), "data_vencimento", "flag_inadimplente", ["valor_fatura", "qtd_faturas_uc_12m"], 2
    ),
)


# ---- text vectors, time folds, topics -------------------------------------------------------------------------
def _keep(spark):
    """Writes a frame once to the shared folder and reads it back; learned tables are read in many rounds."""
    return lambda df: runtime.materialise(spark, lambda: df, "text_model", uuid.uuid4().hex[:8])


def _labelled(spark, sf):
    """Complaint lines with their weak label, their text and the day they came in, written once per dataset version."""
    version = runtime.dataset_version(spark, [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "customer", "nation", "region", "part")])
    rows = lambda: tm.weak_labels(b.complaints(spark, sf).select("ordem", "linha", "dt_ingresso", "causa_raiz", "devolutiva"), "causa_raiz", "devolutiva")
    return runtime.materialise(spark, rows, "weak_labelled", version)


def _folded_vectors(spark, sf):
    folded = tm.expanding_folds(_labelled(spark, sf), "dt_ingresso")
    return _keep(spark)(tm.text_embeddings(folded, "devolutiva", ["ordem", "linha", "fold", "rotulo"], _keep(spark)))


q(
    "weak_label_folds", lambda s, d: tm.fold_sizes(tm.expanding_folds(_labelled(s, d), "dt_ingresso"), "rotulo"),
    COMPLAINTS, "src AS (SELECT devolutiva AS txt FROM complaints)", classifier_ctes("src"),
    f"""o AS MATERIALIZED (SELECT dt_ingresso, coalesce({canonical_label('causa_raiz')}, classe) AS rotulo, row_number() OVER (ORDER BY dt_ingresso) - 1 AS r, count(*) OVER () AS n
  FROM complaints JOIN cls ON txt = devolutiva)""",
    "s AS (SELECT max(n) AS n, least(3, greatest(2, max(n) // 3)) AS k FROM o)",
    "c AS (SELECT dt_ingresso AS cut FROM o, s, range(3) g(i) WHERE i < k AND r = s.n - k * (s.n // (k + 1)) + i * (s.n // (k + 1)))",
    "f AS MATERIALIZED (SELECT rotulo, (SELECT count(*) FROM c WHERE cut <= dt_ingresso) AS fold FROM o)",
    """SELECT fold, count(*) AS teste, count(DISTINCT rotulo) AS classes, (SELECT count(*) FROM f g WHERE g.fold < f.fold) AS treino
FROM f WHERE fold > 0 GROUP BY fold""",
)
add("text_classifier_folds", lambda s, d: tm.fold_scores(_folded_vectors(s, d), "rotulo"))
add("text_embeddings", lambda s, d: tm.text_embeddings(b.table(s, d, "documents").select("doc_id", "text"), "text", ["doc_id"], _keep(s)))
add("topics_with_examples", lambda s, d: tm.topics(b.table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", _keep(s))[1])


def _label_exemplars(spark, sf):
    rows = b.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.sequence(F.lit(0), F.size("embedding") - 1).alias("_ids"), F.col("embedding").cast("array<double>").alias("_weights"))
    return tm.exemplars(rows, "label", "vec_id", tm.centres(rows, "label"), 3)


q(
    "label_exemplars", _label_exemplars,
    "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS i FROM embeddings)",
    "m AS (SELECT label, i, avg(w) AS c FROM e GROUP BY 1, 2)",
    "d AS (SELECT label, vec_id, sqrt(sum((w - c) * (w - c))) AS distancia FROM e JOIN m USING (label, i) GROUP BY 1, 2)",
    """SELECT label, vec_id, round(distancia, 6) AS distancia, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label
ORDER BY distancia, vec_id) AS rank FROM d) WHERE rank <= 3""",
)
