"""Scans, landing, filters and streaming jobs over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattlake import bindings as b
from wattlake import runtime
from wattlake.catalog.base import add
from wattlake.catalog.feature_queries import UNUSUAL
from wattlake.catalog.operation_queries import q
from wattlake.catalog.sqlparts import COMPLAINTS, over_frame
from wattlake.catalog.view_queries import rounded
from wattlake.plans import features as ft
from wattlake.plans import frame as fr
from wattlake.plans import retrieval as rt
from wattlake.plans.registry import parts_of

from wattlake.sources import scans, sinks
from wattlake.sources.contracts import Column as Field
from wattlake.sources.contracts import Contract
from wattlake.sources.versioned import VersionedTable
from wattlake.streaming import jobs


def scratch(spark, name: str) -> str:
    """New folder of the shared area for one streaming run."""
    return f"{runtime.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


# ---- scans and landing ----------------------------------------------------------------------------------------
def _text_orders(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("data_alteracao"))


def _audit(spark, sf):
    """Audit rows per order status: the newest successful one carries the watermark."""
    o = b.table(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("m"), F.max("o_orderkey").alias("k")).select(
        F.lit("notas").alias("source_name"), F.when(F.col("o_orderstatus") == "P", "FAILURE").otherwise("SUCCESS").alias("status"),
        (F.col("m") + F.expr("INTERVAL 3 YEARS")).alias("watermark_value"), F.col("k").alias("executed_at"),
    )


q(
    "incremental_scan",
    lambda s, d: scans.newer_than(_text_orders(s, d), "data_alteracao", "dd/MM/yyyy HH:mm:ss", scans.last_watermark(_audit(s, d), "notas")),
    """WITH a AS (SELECT o_orderstatus, min(o_orderdate) + INTERVAL 3 YEAR AS w, max(o_orderkey) AS k FROM orders GROUP BY 1),
l AS (SELECT w FROM a WHERE o_orderstatus <> 'P' ORDER BY k DESC LIMIT 1)
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS data_alteracao FROM orders, l WHERE o_orderdate > w""",
)
q(
    "new_watermark", lambda s, d: scans.new_watermark(_text_orders(s, d), "data_alteracao", "dd/MM/yyyy HH:mm:ss"),
    "SELECT max(o_orderdate) AS watermark FROM orders",
)


_FILES = {"SP": "BASE N1 2026.csv", "CE": "reclamacoes CE.csv", "OUTRA": "reclamacoes outras.csv"}
_SHEETS = {"base_n1_sp": "Base N1", "erro_leitura": "Erro de Leitura", "reclamacao_total": "Total"}


def _sheets(spark, sf, written: bool = False):
    """Every (region, type) part of the complaints as a sheet under the original headers; none of the nine columns is left out.

    ``written``: the complaints are joined and written once, a folder for each part, and a sheet reads its own; else every sheet joins them for itself.
    """
    c = b.complaints(spark, sf)
    if written:
        version = runtime.dataset_version(spark, [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "customer", "nation", "region", "part", "documents")])
        rows = c.select("_source_region", "_data_type", *scans.COMPLAINT_HEADERS.values())
        c = runtime.materialise(spark, lambda: rows, "complaint_sheets", version, ["_source_region", "_data_type"])
    raw = c.select(
        *[F.col(column).cast("string").alias(header) for header, column in scans.COMPLAINT_HEADERS.items()], "_source_region", "_data_type"
    )
    pick = lambda region, kind: raw.filter((F.col("_source_region") == region) & (F.col("_data_type") == kind)).drop("_source_region", "_data_type")
    return [(pick(region, kind), file, sheet) for region, file in _FILES.items() for kind, sheet in _SHEETS.items()]


_LANDED = """, s AS (SELECT * EXCLUDE (_source_region, _data_type),
  CASE _source_region WHEN 'SP' THEN 'BASE N1 2026.csv' WHEN 'CE' THEN 'reclamacoes CE.csv' ELSE 'reclamacoes outras.csv' END AS f,
  CASE _data_type WHEN 'base_n1_sp' THEN 'Base N1' WHEN 'erro_leitura' THEN 'Erro de Leitura' ELSE 'Total' END AS h FROM complaints),
l AS (SELECT *, f AS _source_file, h AS _sheet_name, CASE WHEN f LIKE 'BASE N1%' THEN 'SP' ELSE 'CE' END AS _source_region,
  CASE WHEN f LIKE 'BASE N1%' OR h = 'Base N1' THEN 'base_n1_sp' WHEN h = 'Erro de Leitura' THEN 'erro_leitura' ELSE 'reclamacao_total' END AS _data_type FROM s)
"""
q(
    "landed_complaints",
    lambda s, d: scans.land_complaints(_sheets(s, d, written=True)).select("ordem", "_source_file", "_sheet_name", "_source_region", "_data_type", "_source_hash"),
    COMPLAINTS,
    _LANDED + """SELECT ordem, _source_file, _sheet_name, _source_region, _data_type, sha256(concat_ws('||', f, h, coalesce(grupo, ''), ordem, coalesce(assunto, ''),
  instalacao, strftime(dt_ingresso, '%Y-%m-%d %H:%M:%S'), observacao_ordem, status, devolutiva, coalesce(causa_raiz, ''))) AS _source_hash FROM l""",
)
q(
    "landed_summary", lambda s, d: scans.land_summary(scans.land_complaints(_sheets(s, d))), COMPLAINTS,
    _LANDED + "SELECT _source_file, _source_region, _sheet_name, _data_type, count(*) AS linhas FROM l GROUP BY ALL",
)
add(
    "template_questions",
    lambda s, d: scans.template_questions(
        b.table(s, d, "part").select(F.col("p_brand").alias("entidade")),
        [("Quantas reclamacoes de {entidade} em {regiao}?", "analise_dados"), ("O que significa {entidade} na regional {regiao}?", "glossario")],
        ["CE", "SP"], 60,
    ),
)
add("seeded_sample", lambda s, d: scans.sample(b.table(s, d, "orders"), "o_orderkey", 100))
q(
    "corpus_metadata",
    lambda s, d: b.table(s, d, "documents").select(
        "doc_id", *[v.alias(k) for k, v in rt.path_metadata(F.concat(F.lit("docs/"), F.when(F.col("lang") == "en", "api").when(F.col("lang") == "fr", "sprints").otherwise("x"),
            F.lit("/Sprint-"), F.substring("source", 4, 3), F.lit(".md"))).items()]),
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'api' WHEN 'fr' THEN 'sprint' ELSE 'misc' END AS doc_type, 'sprint-' || lpad(substr(source, 4, 3), 2, '0') "
    "AS sprint_id FROM documents",
)

# ---- written and read back ------------------------------------------------------------------------------------
_ORDERS = Contract(
    "notas", (Field("cod_nota", "bigint", False, "NOTA"), Field("cod_uc", "bigint", False, "UC"), Field("status", source_name="STATUS"),
              Field("data_criacao", "date", False, "CRIACAO", "dd/MM/yyyy")), strategy="incremental")


def _bronze(spark, sf):
    """Orders as a delimited file under their source headers, scanned by the contract and appended in two loads with their technical columns."""
    root = scratch(spark, "bronze")
    o = b.table(spark, sf, "orders")
    o.select(
        F.col("o_orderkey").alias("NOTA"), F.col("o_custkey").alias("UC"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("STATUS"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("CRIACAO"),
    ).write.option("header", True).option("delimiter", _ORDERS.delimiter).csv(f"{root}/in")
    landed = scans.technical_columns(_ORDERS.check_columns(scans.scan_delimited(spark, _ORDERS, f"{root}/in")), "carga")
    for status in ("status = 'F'", "status IS NULL OR status <> 'F'"):
        sinks.append_bronze(landed.filter(status), f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("cod_nota", "cod_uc", "status", "data_criacao", "_run_id", "_source_hash")


q(
    "bronze_append", _bronze,
    """WITH t AS (SELECT o_orderkey::VARCHAR AS cod_nota, o_custkey::VARCHAR AS cod_uc, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
strftime(o_orderdate, '%d/%m/%Y') AS data_criacao FROM orders)
SELECT *, 'carga' AS _run_id, sha256(cod_nota || '||' || cod_uc || '||' || coalesce(status, '') || '||' || data_criacao) AS _source_hash FROM t""",
)


def _months(spark, sf):
    """Monthly values written twice: the second load holds 1997 only, so it replaces those months and leaves the others."""
    path = scratch(spark, "months")
    o = b.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("mes_referencia"), "o_orderkey", "o_orderstatus")
    sinks.overwrite_months(o, path)
    sinks.overwrite_months(o.filter("mes_referencia LIKE '1997-%' AND o_orderstatus = 'O'"), path)
    return spark.read.parquet(path).groupBy("_partition_date").agg(F.count(F.lit(1)).alias("linhas"), F.sum("o_orderkey").alias("soma"))


q(
    "month_overwrite", _months,
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS _partition_date, count(*) AS linhas, CAST(sum(o_orderkey) AS BIGINT) AS soma FROM orders
WHERE year(o_orderdate) <> 1997 OR o_orderstatus = 'O' OR NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderstatus = 'O' AND year(n.o_orderdate) = 1997
  AND month(n.o_orderdate) = month(orders.o_orderdate)) GROUP BY 1""",
)


def _snapshots(spark, sf):
    """One observation date a year of the orders so far; the last one is saved again with doubled values. History, one date and the list of dates."""
    root, set_ = scratch(spark, "features"), "pedidos"
    o = b.table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("dia"))
    for date, factor in (("1996-01-01", 1), ("1998-01-01", 1), ("1998-01-01", 2)):
        seen = o.filter(F.col("dia") < F.lit(date).cast("date")).groupBy("o_custkey").agg((F.count(F.lit(1)) * factor).alias("pedidos"))
        ft.save_snapshot(seen.withColumn("_observation_date", F.lit(date).cast("date")), root, set_)
    history = ft.load_history(spark, root, set_).groupBy("_observation_date").agg(F.count(F.lit(1)).alias("linhas"), F.sum("pedidos").alias("pedidos"))
    latest = ft.load_snapshot(spark, root, set_, "1998-01-01").agg(F.max("pedidos").alias("m")).select("m").scalar()
    return history.join(ft.available_dates(spark, root, set_), "_observation_date").withColumn("maior_ultima", latest)


_SEEN = "SELECT DATE '{d}' AS _observation_date, o_custkey, count(*) * {f} AS p FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '{d}' GROUP BY 2"
q(
    "feature_history", _snapshots,
    f"WITH h AS ({_SEEN.format(d='1996-01-01', f=1)} UNION ALL {_SEEN.format(d='1998-01-01', f=2)}) "
    "SELECT _observation_date, count(*) AS linhas, CAST(sum(p) AS BIGINT) AS pedidos, (SELECT max(p) FROM h WHERE _observation_date = DATE '1998-01-01') "
    "AS maior_ultima FROM h GROUP BY 1",
)


def _exported(spark, sf):
    """Filtered notes exported in the three formats and read back."""
    root = scratch(spark, "export")
    notes = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("data_criacao"))
    rows = sinks.domain_rows(notes, "notas", "1997-01-01", "1997-12-31", o_orderstatus="F")
    out = None
    for fmt in ("csv", "json", "parquet"):
        sinks.export(rows, f"{root}/{fmt}", fmt)
        reader = spark.read.schema(rows.schema).format(fmt)
        back = (reader.option("header", True) if fmt == "csv" else reader).load(f"{root}/{fmt}")
        part = back.groupBy("o_orderstatus").agg(
            F.lit(fmt).alias("formato"), F.count(F.lit(1)).alias("linhas"), F.sum("o_orderkey").alias("soma"), F.max("data_criacao").alias("ultima"))
        out = part if out is None else out.unionByName(part)
    return out


q(
    "domain_export", _exported,
    """SELECT o_orderstatus, formato, count(*) AS linhas, CAST(sum(o_orderkey) AS BIGINT) AS soma, max(CAST(o_orderdate AS DATE)) AS ultima
FROM orders, (VALUES ('csv'), ('json'), ('parquet')) v(formato) WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 GROUP BY 1, 2""",
)


def _telemetry_lines(spark, sf):
    """Events as JSON lines, every seventh of them cut short; what cannot be parsed is skipped."""
    path = scratch(spark, "telemetry")
    e = b.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    line = F.to_json(F.struct(*e.columns))
    short = F.substring(line, F.lit(1), F.length(line) - 3)
    e.select(F.when(F.col("event_id") % 7 == 0, short).otherwise(line).alias("value")).write.text(path)
    read = scans.read_json_lines(spark, path, "event_id long, event_type string, user_id long")
    return read.groupBy("event_type").agg(F.count("event_id").alias("linhas"), F.sum("user_id").alias("soma"))


q(
    "telemetry_lines", _telemetry_lines,
    "SELECT event_type, count(*) AS linhas, CAST(sum(user_id) AS BIGINT) AS soma FROM events WHERE event_id % 7 <> 0 GROUP BY 1",
)

def _status_report(spark, sf):
    """Orders and large orders by status as a report, read back."""
    path = scratch(spark, "report")
    report = b.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("o_totalprice") > 100000).alias("altas"))
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


q(
    "status_report", _status_report,
    "SELECT o_orderstatus, count(*) AS linhas, count(*) FILTER (o_totalprice > 100000) AS altas FROM orders GROUP BY 1",
)

# ---- filters --------------------------------------------------------------------------------------------------
_CNT = "SELECT regiao, tipo_origem, count(*) AS n, count(DISTINCT ordem) AS ordens FROM {src} WHERE {w} GROUP BY 1, 2"


def _counted(df):
    return df.groupBy("regiao", "tipo_origem").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ordem").alias("ordens"))


def f(name, fn, where, src="frame"):
    add(name, lambda s, d: _counted(fn(b.frame(s, d, parts_of(name)))), over_frame(_CNT.format(src=src, w=where)))


f(
    "filter_data_plane",
    lambda x: fr.apply_filters(x, {"assunto": ["ERRO DE LEITURA", "CORTE INDEVIDO"], "status": "ABERTA", "start_date": "1996-01-01", "end_date": "1998-12-31"}),
    "assunto IN ('ERRO DE LEITURA', 'CORTE INDEVIDO') AND status = 'ABERTA' AND data_ingresso BETWEEN '1996-01-01' AND '1998-12-31'",
)
f(
    "filter_dashboard",
    lambda x: fr.dashboard_filters(x, regions=("CE",), causes=("digitacao", "compensacao_gd"), start="1997-01-01", only_rebilled=True),
    "regiao = 'CE' AND causa_canonica IN ('digitacao', 'compensacao_gd') AND data_ingresso >= '1997-01-01' AND flag_resolvido_com_refaturamento",
)
f(
    "preset_last_30_days", lambda x: fr.preset(x, "last_30_days"),
    "CAST(data_ingresso AS DATE) >= (SELECT max(data_ingresso)::DATE - 30 FROM frame_all)", "frame_all",
)
q(
    "filter_options",
    lambda s, d: fr.filter_options(b.frame(s, d, parts_of("filter_options"))).select(
        *[F.concat_ws(",", c).alias(c) for c in ("regioes", "causas", "topicos")], "min_data", "max_data"),
    over_frame("""SELECT array_to_string(list_sort(list(DISTINCT regiao)), ',') AS regioes, array_to_string(list_sort(list(DISTINCT causa_canonica)), ',')
AS causas, array_to_string(list_sort(list(DISTINCT topic_name)), ',') AS topicos, min(data_ingresso)::DATE AS min_data, max(data_ingresso)::DATE AS max_data
FROM frame_all"""),
)
q(
    "outcome_by_status",
    lambda s, d: fr.outcome_from_status(
        b.complaints(s, d).withColumns({
            "status": F.when(F.col("status") == "ENCERRADA", "Improcedente").when(F.col("status") == "ABERTA", "procedente").otherwise("x"),
            "flag_resolvido_com_refaturamento": F.col("flag_resolvido_com_refaturamento") == "true"})
    ).groupBy("procedencia_real", "flag_resolvido_com_refaturamento").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {COMPLAINTS} SELECT CASE WHEN status = 'ENCERRADA' THEN 'IMPROCEDENTE' WHEN status = 'ABERTA' OR flag_resolvido_com_refaturamento THEN 'PROCEDENTE' "
    "ELSE 'IMPROCEDENTE' END AS procedencia_real, CASE WHEN status = 'ENCERRADA' THEN false WHEN status = 'ABERTA' THEN true ELSE "
    "flag_resolvido_com_refaturamento END AS flag_resolvido_com_refaturamento, count(*) AS n FROM complaints GROUP BY 1, 2",
)
add(
    "native_group_by",
    lambda s, d: rounded(
        s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantidade"), F.avg("l_discount").alias("desconto"))),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantidade, round(avg(l_discount), 6) AS desconto FROM lineitem GROUP BY 1, 2",
)


def _cards(spark, sf):
    from wattlake.plans.cards import view_cards

    return view_cards(b.scope(spark, sf, include_total=True, parts=parts_of("data_cards")))


add("data_cards", _cards)

# ---- streaming ------------------------------------------------------------------------------------------------
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)


def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _append(stream, spark, name):
    folder = scratch(spark, name)
    _finish(jobs.append_bronze(stream, f"{folder}/data", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/data")


q(
    "stream_incremental", lambda s, d: _append(event_stream(s, d), s, "stream_incremental").drop("props"),
    "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM events",
)
def _drop_repeats(spark, sf):
    folder = scratch(spark, "stream_repeats")
    once = jobs.drop_repeats(_slices(spark, sf, folder, 4), "ts", "60 days", ["event_id"])
    _finish(jobs.append_bronze(once, f"{folder}/data", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


q("stream_drop_repeats", _drop_repeats, "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")


def _telemetry_stream(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return event_stream(spark, sf).select("ts", (k % 2 == 0).alias("cache_hit"), F.col("value").alias("latency_total_ms"))


q(
    "stream_telemetry_kpis",
    lambda s, d: _append(jobs.telemetry_kpis(_telemetry_stream(s, d)), s, "stream_kpis").select("start", "turns", "hit_rate", "p50", "p95"),
    """SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS turns, round(avg((CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0)::INT), 6)
AS hit_rate, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 10 MINUTE, any_value(ts)) + INTERVAL 10 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 30 MINUTE FROM events)""",
)
q(
    "stream_daily_counts",
    lambda s, d: _append(
        jobs.daily_counts(event_stream(s, d).withColumn("classe", F.get_json_object("props", "$.k")), "ts", "event_type", "classe"), s, "stream_daily"),
    """SELECT CAST(ts AS DATE) AS data, event_type AS regiao, json_extract_string(props, '$.k') AS classe_erro, count(*) AS qtd_erros FROM events
GROUP BY 1, 2, 3 HAVING CAST(any_value(ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
)


def _slices(spark, sf, folder: str, count: int):
    """The events as a stream of ``count`` slices that arrive one after the other; keys and times repeat from slice to slice."""
    events = b.table(spark, sf, "events")
    for i in range(count):
        part = events.filter(F.pmod("event_id", F.lit(count)) == i)
        if i:  # what came before comes again with the next slice
            part = part.unionByName(events.filter((F.pmod("event_id", F.lit(count)) == i - 1) & (F.pmod("event_id", F.lit(7)) == 0)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/entrada")
    return jobs.read_files(spark, f"{folder}/entrada", EVENTS, per_trigger=1)


def _stream_upsert(spark, sf):
    folder = scratch(spark, "stream_upsert")
    stream = _slices(spark, sf, folder, 4).select("user_id", "ts", "event_type", "value", F.pmod("user_id", F.lit(16)).alias("bucket"))
    _finish(jobs.upsert(stream, f"{folder}/tabela", f"{folder}/checkpoint", ["user_id"], "ts", "bucket"))
    table = VersionedTable(spark, f"{folder}/tabela", stream.schema, "bucket")
    version, last, _ = table.manifest()
    return table.read().select("user_id", "ts", "event_type", "value", F.lit(version).alias("versao"), F.lit(last).alias("lote"))


q(
    "stream_upsert", _stream_upsert,
    "SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, round(arg_max(value, ts), 6) AS value, 4 AS versao, 3 AS lote FROM events GROUP BY 1",
)


def _stream_late(spark, sf):
    folder = scratch(spark, "stream_late")
    paths = [f"{folder}/{x}" for x in ("on_time", "late", "marks", "checkpoint")]
    _finish(jobs.split_late(_slices(spark, sf, folder, 4), "ts", "10 days", *paths))
    kinds = [spark.read.parquet(p).select(F.lit(k).alias("atrasado"), "event_type", F.col("_batch").cast("int").alias("lote")) for k, p in ((False, paths[0]), (True, paths[1]))]
    return kinds[0].unionByName(kinds[1]).groupBy("atrasado", "lote", "event_type").agg(F.count(F.lit(1)).alias("n"))


q(
    "stream_late_split", _stream_late,
    """WITH s AS (SELECT *, CAST(event_id % 4 AS INTEGER) AS lote FROM events UNION ALL SELECT *, CAST(event_id % 4 + 1 AS INTEGER) FROM events WHERE event_id % 7 = 0 AND event_id % 4 < 3),
m AS (SELECT lote, max(ts) AS mx FROM s GROUP BY 1), p AS (SELECT lote, max(mx) OVER (ORDER BY lote ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antes FROM m)
SELECT coalesce(ts < antes - INTERVAL 10 DAY, false) AS atrasado, lote, event_type, count(*) AS n FROM s JOIN p USING (lote) GROUP BY 1, 2, 3""",
)


def _stream_hotspots(spark, sf):
    folder = scratch(spark, "stream_hotspots")
    counts = jobs.daily_counts(event_stream(spark, sf).withColumn("classe", F.lit("todas")), "ts", "event_type", "classe")
    _finish(jobs.hotspot_alerts(counts, f"{folder}/history", f"{folder}/alerts", f"{folder}/checkpoint", 1.5))
    return ft.score_daily_counts(spark.read.parquet(f"{folder}/history").drop("_batch"), 1.5)


q(
    "stream_hotspot_scores", _stream_hotspots,
    """WITH c AS (SELECT CAST(ts AS DATE) AS data, event_type AS regiao, 'todas' AS classe_erro, count(*) AS qtd_erros FROM events GROUP BY 1, 2
HAVING CAST(any_value(ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)),
r AS (SELECT *, avg(qtd_erros) OVER w AS m, coalesce(stddev_samp(qtd_erros) OVER w, 0) AS sd FROM c
  WINDOW w AS (PARTITION BY regiao ORDER BY data ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (qtd_erros - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS zs FROM r),""" + UNUSUAL + """
SELECT data, regiao, classe_erro, qtd_erros, round(m, 6) AS rolling_mean_7d, round(sd, 6) AS rolling_std_7d, round(zs, 6) AS zscore,
round(score, 6) AS anomaly_score, score > 0 OR abs(zs) >= 1.5 AS is_anomaly FROM u""",
)


def _stream_runs(spark, sf):
    folder = scratch(spark, "stream_runs")
    stream = event_stream(spark, sf).select(
        F.col("user_id").alias("cod_uc"), F.col("event_id").alias("cod_pagamento"), F.col("ts").alias("data_vencimento"),
        (F.col("event_type") == "error").alias("flag_inadimplente"),
    )
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _finish(jobs.append_bronze(jobs.unpaid_runs(stream), f"{folder}/data", f"{folder}/checkpoint"))
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/data")


q(
    "stream_unpaid_runs", _stream_runs,
    """WITH g AS (SELECT user_id, event_id, ts, (event_type = 'error')::INT AS fl, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)
AS isl FROM events) SELECT user_id AS cod_uc, event_id AS cod_pagamento, CASE WHEN fl = 0 THEN 0 ELSE CAST(sum(fl) OVER (PARTITION BY user_id, isl
ORDER BY ts, event_id) AS BIGINT) END AS meses_consecutivos FROM g""",
)
