"""Named aggregation views over the wide frame.

Every view is a function DataFrame -> DataFrame with a fixed output schema; it stays lazy until the caller collects.
Counts are distinct orders. Top-n views break ties by key. Totals enter as scalar subqueries.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattlake.functions import rules as ru
from wattlake.functions import taxonomy as tax
from wattlake.functions import text as tx
from wattlake.functions import themes as th
from wattlake.operators.grouping import (
    blank_to_null,
    distinct_orders,
    mean_flag,
    modal,
    ordinal,
    scalar_of,
    share_within,
    sum_flag,
    top_by,
    top_per_group,
    with_share,
)
from wattlake.plans.frame import TRAINING_TYPES

REBILL = "flag_resolvido_com_refaturamento"


def _orders_total(df: DataFrame) -> Column:
    return scalar_of(df, F.countDistinct("ordem"))


def kpis(frame: DataFrame) -> DataFrame:
    """Rows, in-scope rows, regions, topics, rates and repeat installations."""
    repeat = (
        frame.filter("instalacao_hash <> ''")
        .groupBy("instalacao_hash")
        .agg(distinct_orders("n"))
        .filter("n > 1")
    )
    named = F.when(F.col("topic_name") != "sem_topico", F.col("topic_name"))
    return frame.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.count_if(F.col("tipo_origem").isin(*TRAINING_TYPES)).alias("total_erros"),
        F.size(F.collect_set("regiao")).cast("long").alias("regioes"),
        F.size(F.collect_set(named)).cast("long").alias("topicos"),
        F.coalesce(F.avg(F.col(REBILL).cast("double")), F.lit(0.0)).alias("taxa_refaturamento"),
        F.coalesce(F.avg(F.col("has_causa_raiz_label").cast("double")), F.lit(0.0)).alias("taxa_rotulo_origem"),
    ).withColumn("instalacoes_reincidentes", scalar_of(repeat, F.count(F.lit(1))))


def by_region(frame: DataFrame) -> DataFrame:
    """A03."""
    return (
        frame.groupBy("regiao")
        .agg(
            distinct_orders(),
            mean_flag(REBILL, "taxa_refaturamento"),
            sum_flag(REBILL, "ordens_refaturadas"),
            sum_flag("has_causa_raiz_label", "causas_rotuladas"),
        )
        .orderBy(F.desc("qtd_ordens"), "regiao")
    )


def top_subjects(frame: DataFrame, limit: int = 12) -> DataFrame:
    """The NULL subject is a group of its own."""
    counts = top_by(frame.groupBy("assunto").agg(distinct_orders()), limit, "qtd_ordens", "assunto")
    return with_share(counts, "qtd_ordens", _orders_total(frame))


def top_causes(frame: DataFrame, limit: int = 12) -> DataFrame:
    """A05."""
    known = frame.filter("causa_canonica IS NOT NULL")
    counts = top_by(known.groupBy("causa_canonica").agg(distinct_orders()), limit, "qtd_ordens", "causa_canonica")
    return with_share(counts, "qtd_ordens", _orders_total(known))


def rebill_summary(frame: DataFrame) -> DataFrame:
    """A06."""
    return frame.agg(
        distinct_orders("total"), sum_flag(REBILL, "refaturadas"), mean_flag(REBILL, "taxa_refaturamento")
    )


def by_group(frame: DataFrame, limit: int = 6) -> DataFrame:
    """A07."""
    named = frame.withColumn("grupo", F.coalesce("grupo", F.lit("(nao informado)")))
    counts = top_by(named.groupBy("grupo").agg(distinct_orders()), limit, "qtd_ordens", "grupo")
    return with_share(counts, "qtd_ordens", _orders_total(frame))


def monthly_volume(frame: DataFrame) -> DataFrame:
    """A08."""
    dated = frame.filter("mes_ingresso IS NOT NULL")
    return dated.groupBy("mes_ingresso", "regiao").agg(distinct_orders("qtd_erros")).orderBy("mes_ingresso", "regiao")


def root_cause_distribution(frame: DataFrame, limit: int = 12) -> DataFrame:
    """The share is taken over the kept rows."""
    counts = frame.groupBy("causa_canonica").agg(distinct_orders("qtd_erros"), mean_flag(REBILL, "taxa_refaturamento"))
    return share_within(top_by(counts, limit, "qtd_erros", "causa_canonica"), [], "qtd_erros")


def region_cause_matrix(frame: DataFrame, regions: tuple[str, ...] = ("CE", "SP")) -> DataFrame:
    """A10: cause by region matrix; the region list is fixed so the schema is."""
    pairs = frame.groupBy("causa_canonica", "regiao").agg(distinct_orders("n"))
    return (
        pairs.groupBy("causa_canonica").pivot("regiao", list(regions)).agg(F.sum("n")).na.fill(0).orderBy("causa_canonica")
    )


def topic_distribution(frame: DataFrame, limit: int = 12) -> DataFrame:
    """A11."""
    counts = frame.groupBy("topic_name", "topic_keywords").agg(
        distinct_orders("qtd_erros"), mean_flag(REBILL, "taxa_refaturamento")
    )
    return top_by(counts, limit, "qtd_erros", "topic_name")


def rebill_by_cause(frame: DataFrame, limit: int = 10) -> DataFrame:
    """A12."""
    counts = frame.groupBy("causa_canonica").agg(distinct_orders("qtd_erros"), mean_flag(REBILL, "taxa_refaturamento"))
    return (
        counts.filter("qtd_erros > 0")
        .orderBy(F.desc("taxa_refaturamento"), F.desc("qtd_erros"), "causa_canonica")
        .limit(limit)
    )


def cause_radar(frame: DataFrame, top_n: int = 10) -> DataFrame:
    """Profile of every region over the globally leading causes, missing pairs as zero."""
    counts = frame.groupBy("regiao", "causa_canonica").agg(distinct_orders("qtd_erros"))
    leading = top_by(
        counts.groupBy("causa_canonica").agg(F.sum("qtd_erros").alias("n")), top_n, "n", "causa_canonica"
    )
    # At most top_n names, so the array is bounded; every region explodes it into its dense grid.
    names = scalar_of(leading, F.collect_list("causa_canonica"))
    grid = counts.select("regiao").distinct().select("regiao", F.explode(names).alias("causa_canonica"))
    dense = grid.join(counts, ["regiao", "causa_canonica"], "left").na.fill(0, ["qtd_erros"])
    return share_within(dense, ["regiao"], "qtd_erros").orderBy("regiao", "causa_canonica")


def category_breakdown(frame: DataFrame) -> DataFrame:
    """A14."""
    counts = (
        frame.withColumn("categoria", tax.category_of(F.col("causa_canonica")))
        .groupBy("categoria", "regiao")
        .agg(distinct_orders("qtd_erros"))
    )
    return share_within(counts, ["regiao"], "qtd_erros").orderBy("regiao", F.desc("qtd_erros"), "categoria")


def severity_heatmap(frame: DataFrame) -> DataFrame:
    """A15."""
    return (
        frame.withColumn("severidade", tax.severity_of(F.col("causa_canonica")))
        .groupBy("regiao", "severidade")
        .agg(distinct_orders("qtd_erros"), mean_flag(REBILL, "taxa_refaturamento"))
        .orderBy("regiao", ordinal("severidade", tax.SEVERITY_ORDER))
    )


def executive_summary(frame: DataFrame) -> DataFrame:
    """A16/UDF04: one row per region."""
    rated = frame.withColumns(
        {
            "peso": tax.severity_weight_of(F.col("causa_canonica")),
            "critico": (tax.severity_of(F.col("causa_canonica")) == "critical").cast("double"),
        }
    )
    base = rated.groupBy("regiao").agg(
        distinct_orders("volume_total"),
        mean_flag(REBILL, "taxa_refaturamento"),
        mean_flag("has_causa_raiz_label", "cobertura_rotulo"),
        F.round(F.avg("peso"), 2).alias("severidade_media"),
        F.avg("critico").alias("share_critico"),
    )
    repeat = (
        frame.filter("instalacao_hash <> ''")
        .groupBy("regiao", "instalacao_hash")
        .agg(distinct_orders("n"))
        .groupBy("regiao")
        .agg(F.count_if(F.col("n") > 1).alias("instalacoes_reincidentes"))
    )
    leader = (
        frame.groupBy("regiao", "causa_canonica")
        .agg(distinct_orders("n"))
        .groupBy("regiao")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), "causa_canonica")).alias("lead"))
    )
    return (
        base.join(repeat, "regiao", "left")
        .join(leader, "regiao", "left")
        .select(
            "regiao", "volume_total", "taxa_refaturamento", "cobertura_rotulo",
            F.coalesce("instalacoes_reincidentes", F.lit(0)).alias("instalacoes_reincidentes"),
            F.coalesce("lead.causa_canonica", F.lit("n/d")).alias("causa_dominante"),
            (-F.col("lead.neg") / F.greatest("volume_total", F.lit(1))).alias("share_causa_dominante"),
            "severidade_media", "share_critico",
        )
        .orderBy("regiao")
    )


def with_trend(monthly: DataFrame, group: list[str], order: str, count: str, first: float | None) -> DataFrame:
    """WIN06/WIN07: change against the previous row and the mean of up to three rows, over monthly counts."""
    w = W.partitionBy(*group).orderBy(order)
    change = F.try_divide(F.col(count) - F.lag(count).over(w), F.lag(count).over(w))
    return monthly.withColumns(
        {
            "mom": F.coalesce(change, F.lit(first)) if first is not None else change,
            "media_movel_3m": F.avg(count).over(w.rowsBetween(-2, 0)),
        }
    )


def monthly_trend(frame: DataFrame) -> DataFrame:
    """The first month of a region has change 0."""
    return with_trend(monthly_volume(frame), ["regiao"], "mes_ingresso", "qtd_erros", 0.0).orderBy("regiao", "mes_ingresso")


def reincidence_matrix(frame: DataFrame) -> DataFrame:
    """A18."""
    per_installation = (
        frame.filter("instalacao_hash <> ''").groupBy("regiao", "instalacao_hash").agg(distinct_orders("n"))
    )
    return (
        per_installation.groupBy("regiao", ru.reincidence_bucket(F.col("n")).alias("faixa"))
        .agg(F.count(F.lit(1)).alias("qtd_instalacoes"))
        .orderBy("regiao", ordinal("faixa", ("1", "2", "3-4", "5-9", "10+")))
    )


def classifier_coverage(frame: DataFrame) -> DataFrame:
    """A19."""
    conf = F.col("causa_canonica_confidence")
    work = frame.withColumn(
        "causa_canonica_confidence", F.when(conf.isin("high", "low", "indefinido"), conf).otherwise("indefinido")
    )
    grouped = work.groupBy("regiao", "causa_canonica_confidence").agg(distinct_orders())
    totals = work.groupBy("regiao").agg(
        F.countDistinct("ordem").alias("_total"),
        F.countDistinct(F.when(F.col("causa_canonica") == "indefinido", F.col("ordem"))).alias("indefinidos"),
    )
    return (
        grouped.join(totals, "regiao")
        .select(
            "regiao", "causa_canonica_confidence", "qtd_ordens",
            (F.col("qtd_ordens") / F.greatest("_total", F.lit(1))).alias("percentual"),
            "indefinidos",
            (F.col("indefinidos") / F.greatest("_total", F.lit(1))).alias("indefinido_pct"),
        )
        .orderBy("regiao", "causa_canonica_confidence")
    )


# Words left out of the token audit.
TOKEN_STOPWORDS = ("a", "as", "com", "da", "de", "do", "e", "em", "na", "no", "o", "os", "para", "por")


def undefined_tokens(frame: DataFrame, limit: int = 20) -> DataFrame:
    """Frequent words of topic keywords and subjects of rows without a cause."""
    texts = (
        frame.filter("causa_canonica = 'indefinido'")
        .groupBy("topic_keywords", "assunto")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("n", F.explode(F.array(F.coalesce("topic_keywords", F.lit("")), F.coalesce("assunto", F.lit("")))).alias("t"))
    )
    words = F.regexp_extract_all(tx.fold(F.col("t")), F.lit(r"\b[a-z0-9_]{3,}\b"), F.lit(0))
    counts = (
        texts.select("n", F.explode(words).alias("token"))
        .filter(~F.col("token").isin(*TOKEN_STOPWORDS))
        .groupBy("token")
        .agg(F.sum("n").alias("qtd_ocorrencias"))
    )
    return top_by(counts, limit, "qtd_ocorrencias", "token")


def taxonomy_reference(frame: DataFrame) -> DataFrame:
    """The taxonomy with the order volume of the frame per class."""
    volume = frame.groupBy(F.col("causa_canonica").alias("classe")).agg(distinct_orders("qtd_ordens"))
    return tax.taxonomy_frame(frame.sparkSession).join(volume, "classe", "left").na.fill(0, ["qtd_ordens"])


def _with_installation(frame: DataFrame) -> DataFrame:
    key = F.trim(F.coalesce("instalacao", F.lit("")))
    return frame.withColumn("instalacao", key).filter((key != "") & (F.lower(key) != "nan"))


def top_installations(frame: DataFrame, limit: int = 20) -> DataFrame:
    """The modal columns are computed for the leading installations only."""
    rows = _with_installation(frame)
    leading = top_by(rows.groupBy("instalacao").agg(distinct_orders()), limit, "qtd_ordens", "instalacao")
    detail = (
        rows.join(leading.select("instalacao"), "instalacao", "left_semi")
        .groupBy("instalacao")
        .agg(
            modal("assunto", "assunto_top"),
            modal("causa_canonica", "causa_top"),
            mean_flag(REBILL, "taxa_refaturamento"),
            modal("tipo_medidor_dominante"),
            F.max("instalacao_multi_tipo").alias("instalacao_multi_tipo"),
        )
    )
    return leading.join(detail, "instalacao").orderBy(F.desc("qtd_ordens"), "instalacao")


def top_installations_by_region(frame: DataFrame, limit_per_region: int = 5) -> DataFrame:
    """A31."""
    rows = _with_installation(frame)
    leading = top_per_group(
        rows.groupBy("regiao", "instalacao").agg(distinct_orders()),
        ["regiao"], [F.desc("qtd_ordens"), F.asc("instalacao")], limit_per_region,
    ).drop("rank")
    detail = (
        rows.join(leading.select("regiao", "instalacao"), ["regiao", "instalacao"], "left_semi")
        .groupBy("regiao", "instalacao")
        .agg(modal("assunto", "assunto_top"), modal("tipo_medidor_dominante"))
    )
    return leading.join(detail, ["regiao", "instalacao"])


def _typing_rows(frame: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce("texto_completo", F.lit("")))
    return frame.filter(F.lower("causa_canonica").contains("digit") | text.contains("digit"))


def top_installations_typing(frame: DataFrame, limit: int = 20) -> DataFrame:
    """A32."""
    return top_by(
        _with_installation(_typing_rows(frame))
        .groupBy("regiao", "instalacao")
        .agg(distinct_orders(), modal("assunto", "assunto_top"), modal("tipo_medidor_dominante")),
        limit, "qtd_ordens", "regiao", "instalacao",
    )


def _sp_meters(frame: DataFrame) -> DataFrame:
    return (
        frame.filter("regiao = 'SP'")
        .withColumn("tipo_medidor_dominante", blank_to_null("tipo_medidor_dominante"))
        .filter("tipo_medidor_dominante IS NOT NULL")
    )


def sp_meter_types(frame: DataFrame, limit: int = 12) -> DataFrame:
    """A33."""
    rows = _sp_meters(frame)
    counts = top_by(
        rows.groupBy("tipo_medidor_dominante").agg(
            distinct_orders(), F.countDistinct("instalacao").alias("qtd_instalacoes")
        ),
        limit, "qtd_ordens", "tipo_medidor_dominante",
    )
    return with_share(counts, "qtd_ordens", _orders_total(rows)).withColumn("regiao", F.lit("SP"))


def sp_meter_types_typing(frame: DataFrame, limit: int = 10) -> DataFrame:
    """A34."""
    return sp_meter_types(_typing_rows(frame), limit)


def sp_causes_by_meter_type(frame: DataFrame, top_types: int = 6, top_causes_per_type: int = 5) -> DataFrame:
    """A35/JN15: leading causes inside the leading meter types."""
    rows = _sp_meters(frame).withColumn("causa_canonica", blank_to_null("causa_canonica")).filter("causa_canonica IS NOT NULL")
    types = top_by(
        rows.groupBy("tipo_medidor_dominante").agg(distinct_orders("qtd_total_tipo")),
        top_types, "qtd_total_tipo", "tipo_medidor_dominante",
    )
    counts = rows.groupBy("tipo_medidor_dominante", "causa_canonica").agg(distinct_orders())
    ranked = top_per_group(
        counts.join(types, "tipo_medidor_dominante"),
        ["tipo_medidor_dominante"], [F.desc("qtd_ordens"), F.asc("causa_canonica")], top_causes_per_type,
    )
    return ranked.select(
        F.lit("SP").alias("regiao"), "tipo_medidor_dominante", "causa_canonica", "qtd_ordens", "qtd_total_tipo",
        (F.col("qtd_ordens") / F.greatest("qtd_total_tipo", F.lit(1))).alias("percentual_no_tipo"), "rank",
    )


def _invoice_stats(*, due: bool = True) -> list[Column]:
    stats = [
        F.avg("valor_fatura_reclamada_medio").alias("valor_fatura_reclamada_medio"),
        F.max("valor_fatura_reclamada_max").alias("valor_fatura_reclamada_max"),
        F.avg("dias_emissao_ate_reclamacao_medio").alias("dias_emissao_ate_reclamacao_medio"),
    ]
    if due:
        stats.append(F.avg("dias_vencimento_ate_reclamacao_medio").alias("dias_vencimento_ate_reclamacao_medio"))
    return stats


def sp_high_invoices(frame: DataFrame, limit: int = 10) -> DataFrame:
    """Leading (installation, invoice month) pairs by value, profiled after the cut."""
    rows = _with_installation(frame.filter("regiao = 'SP' AND valor_fatura_reclamada_max IS NOT NULL"))
    rows = rows.withColumn("fat_reclamada_top", blank_to_null("fat_reclamada_top")).filter("fat_reclamada_top IS NOT NULL")
    keys = ["instalacao", "fat_reclamada_top"]
    leading = top_by(rows.groupBy(*keys).agg(F.max("valor_fatura_reclamada_max").alias("v")), limit, "v", *keys)
    return (
        rows.join(leading.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(
            *_invoice_stats(), modal("tipo_medidor_dominante"), modal("assunto", "assunto_top"),
            modal("causa_canonica", "causa_top"), distinct_orders(),
        )
        .withColumn("regiao", F.lit("SP"))
        .orderBy(F.desc("valor_fatura_reclamada_max"), *keys)
    )


def sp_invoice_by_meter(frame: DataFrame, limit: int = 12) -> DataFrame:
    """A37."""
    return (
        _sp_meters(frame)
        .groupBy("tipo_medidor_dominante")
        .agg(
            distinct_orders(), F.countDistinct("instalacao").alias("qtd_instalacoes"), *_invoice_stats(),
            modal("assunto", "assunto_top"), modal("causa_canonica", "causa_top"),
        )
        .orderBy(F.desc("qtd_ordens"), F.desc("valor_fatura_reclamada_max"), "tipo_medidor_dominante")
        .limit(limit)
        .withColumn("regiao", F.lit("SP"))
    )


def sp_invoice_by_meter_typing(frame: DataFrame, limit: int = 12) -> DataFrame:
    """A38."""
    return sp_invoice_by_meter(_typing_rows(frame), limit).drop("causa_top")


def sp_problem_meters(frame: DataFrame, limit: int = 12) -> DataFrame:
    """A39."""
    return (
        _sp_meters(frame)
        .groupBy("tipo_medidor_dominante")
        .agg(
            modal("assunto", "assunto_top"), modal("causa_canonica", "causa_top"), distinct_orders(),
            F.countDistinct("instalacao").alias("qtd_instalacoes"), *_invoice_stats(due=False),
        )
        .orderBy(F.desc("qtd_ordens"), F.desc("qtd_instalacoes"), "tipo_medidor_dominante")
        .limit(limit)
        .withColumn("regiao", F.lit("SP"))
    )


def ce_subject_causes(frame: DataFrame, top_subjects_n: int = 6, top_causes_n: int = 4) -> DataFrame:
    """Leading causes inside the leading subjects of the CE totals."""
    rows = (
        frame.filter("regiao = 'CE' AND tipo_origem = 'reclamacao_total'")
        .withColumns({"assunto": blank_to_null("assunto"), "causa_canonica": blank_to_null("causa_canonica")})
        .filter("assunto IS NOT NULL AND causa_canonica IS NOT NULL")
    )
    leading = top_by(rows.groupBy("assunto").agg(distinct_orders("qtd_assunto")), top_subjects_n, "qtd_assunto", "assunto")
    # The window is over at most top_subjects_n rows.
    leading = leading.withColumn("rank_assunto", F.row_number().over(W.orderBy(F.desc("qtd_assunto"), "assunto")))
    counts = rows.groupBy("assunto", "causa_canonica").agg(distinct_orders()).join(leading, "assunto")
    ranked = top_per_group(
        counts, ["assunto"], [F.desc("qtd_ordens"), F.asc("causa_canonica")], top_causes_n, "rank_causa"
    )
    return ranked.select(
        F.lit("CE").alias("regiao"), "assunto", "causa_canonica", "qtd_ordens", "qtd_assunto",
        (F.col("qtd_ordens") / F.greatest("qtd_assunto", F.lit(1))).alias("percentual_no_assunto"),
        "rank_assunto", "rank_causa",
    )


def taxonomy_reasons(frame: DataFrame, limit: int = 20) -> DataFrame:
    """A41."""
    rows = (
        frame.filter(F.col("regiao").isin("CE", "SP"))
        .withColumns({"assunto": blank_to_null("assunto"), "causa_canonica": blank_to_null("causa_canonica")})
        .filter("assunto IS NOT NULL AND causa_canonica IS NOT NULL")
    )
    counts = top_by(
        rows.groupBy("regiao", "assunto", "causa_canonica").agg(distinct_orders()),
        limit, "qtd_ordens", "regiao", "assunto", "causa_canonica",
    )
    return with_share(counts, "qtd_ordens", _orders_total(rows)).withColumn(
        "motivo_taxonomia", F.concat_ws(" | ", "assunto", "causa_canonica")
    )


def _monthly_top(rows: DataFrame, key: str, top_per_month: int, max_months: int) -> DataFrame:
    counts = rows.groupBy("mes_ingresso", key).agg(distinct_orders())
    kept = top_per_group(counts, ["mes_ingresso"], [F.desc("qtd_ordens"), F.asc(key)], top_per_month)
    # The months are few; the last ones are named by a bounded array.
    months = counts.select("mes_ingresso").distinct().orderBy(F.desc("mes_ingresso")).limit(max_months)
    first = scalar_of(months, F.min("mes_ingresso"))
    return kept.filter(F.col("mes_ingresso") >= first).orderBy("mes_ingresso", "rank")


def monthly_subjects(frame: DataFrame, top_per_month: int = 3, max_months: int = 18) -> DataFrame:
    """A42/WIN15."""
    rows = frame.filter("mes_ingresso IS NOT NULL AND assunto IS NOT NULL")
    return _monthly_top(rows, "assunto", top_per_month, max_months)


def monthly_causes(frame: DataFrame, top_per_month: int = 3, max_months: int = 18) -> DataFrame:
    """Labelled rows with a cause only."""
    rows = frame.filter(
        "mes_ingresso IS NOT NULL AND causa_canonica IS NOT NULL AND has_causa_raiz_label "
        "AND NOT contains(lower(causa_canonica), 'sem_causa')"
    )
    return _monthly_top(rows, "causa_canonica", top_per_month, max_months)


def sp_cause_notes(frame: DataFrame, sample_size: int = 3) -> DataFrame:
    """Leading SP cause with a few distinct note snippets (first ones in text order)."""
    sp = frame.filter("regiao = 'SP'")
    counts = sp.groupBy("causa_canonica").agg(distinct_orders())
    leader = counts.orderBy(F.col("causa_canonica") == "indefinido", F.desc("qtd_ordens"), "causa_canonica").limit(1)
    rows = sp.join(leader, "causa_canonica")
    notes = (
        rows.select(F.trim("texto_completo").alias("t")).filter("t <> ''").groupBy("t").agg(F.lit(1).alias("one"))
        .orderBy("t").limit(sample_size)
    )
    snippets = scalar_of(notes, F.concat_ws(" | ", F.array_sort(F.collect_list(F.substring("t", 1, 180)))))
    return rows.groupBy("causa_canonica", "qtd_ordens").agg(modal("assunto", "assunto_top")).select(
        F.lit("SP").alias("regiao"),
        F.col("causa_canonica").alias("causa_lider"),
        "qtd_ordens",
        (F.col("qtd_ordens") / F.greatest(_orders_total(sp), F.lit(1))).alias("percentual"),
        "assunto_top",
        F.coalesce(snippets, F.lit("")).alias("observacoes_exemplo"),
    )


def sp_leading_subject(frame: DataFrame) -> DataFrame:
    """A45."""
    sp = frame.filter("regiao = 'SP'")
    leader = top_by(
        sp.filter("assunto IS NOT NULL").groupBy("assunto").agg(distinct_orders()), 1, "qtd_ordens", "assunto"
    )
    return (
        sp.join(leader, "assunto")
        .groupBy("assunto", "qtd_ordens")
        .agg(
            modal("fat_reclamada_top"),
            F.avg("dias_emissao_ate_reclamacao_medio").alias("dias_emissao_ate_reclamacao_medio"),
            modal("tipo_medidor_dominante"),
            F.avg("valor_fatura_reclamada_medio").alias("valor_fatura_reclamada_medio"),
            mean_flag("perfil_fatura_disponivel", "cobertura_fatura_pct"),
            mean_flag("perfil_medidor_disponivel", "cobertura_medidor_pct"),
        )
        .withColumns(
            {
                "regiao": F.lit("SP"),
                "percentual": F.col("qtd_ordens") / F.greatest(_orders_total(sp), F.lit(1)),
            }
        )
        .withColumnRenamed("assunto", "assunto_lider")
    )


def seasonality(frame: DataFrame) -> DataFrame:
    """A46/SRT05: peak month and its ratio to the monthly mean per region."""
    peak = F.min(F.struct((-F.col("qtd_erros")).alias("neg"), "mes_ingresso"))
    return (
        monthly_volume(frame)
        .groupBy("regiao")
        .agg(peak.alias("p"), F.avg("qtd_erros").alias("media_mensal"))
        .select(
            "regiao",
            F.date_format("p.mes_ingresso", "yyyy-MM").alias("mes_pico"),
            (-F.col("p.neg")).alias("qtd_pico"),
            "media_mensal",
            F.coalesce(F.try_divide(-F.col("p.neg"), F.col("media_mensal")), F.lit(0.0)).alias("indice_sazonal_pico"),
        )
        .orderBy("regiao")
    )


def reincidence_by_subject(frame: DataFrame, limit: int = 12) -> DataFrame:
    """A47."""
    rows = _with_installation(frame).withColumn("assunto", blank_to_null("assunto")).filter("assunto IS NOT NULL")
    pairs = rows.groupBy("assunto", "instalacao").agg(distinct_orders("n"))
    installations = pairs.groupBy("assunto").agg(
        F.count(F.lit(1)).alias("qtd_instalacoes"), F.count_if(F.col("n") >= 2).alias("qtd_instalacoes_reincidentes")
    )
    return (
        rows.groupBy("assunto")
        .agg(distinct_orders())
        .join(installations, "assunto")
        .withColumn(
            "taxa_reincidencia", F.col("qtd_instalacoes_reincidentes") / F.greatest("qtd_instalacoes", F.lit(1))
        )
        .orderBy(F.desc("taxa_reincidencia"), F.desc("qtd_instalacoes_reincidentes"), "assunto")
        .limit(limit)
    )


def playbook(frame: DataFrame) -> DataFrame:
    """Action of the first pattern found in the leading subject and cause."""
    subject = top_by(
        frame.filter("assunto IS NOT NULL").groupBy("assunto").agg(distinct_orders("n")), 1, "n", "assunto"
    ).select(F.lit(1).alias("k"), "assunto")
    cause = top_by(
        frame.filter("causa_canonica IS NOT NULL").groupBy("causa_canonica").agg(distinct_orders("n")), 1, "n", "causa_canonica"
    ).select(F.lit(1).alias("k"), "causa_canonica")
    text = F.lower(F.concat_ws(" ", "assunto", "causa_canonica"))
    action, priority = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for pattern, act, pri in th.PLAYBOOK:
        action, priority = action.when(text.contains(pattern), act), priority.when(text.contains(pattern), pri)
    return subject.join(cause, "k").select(
        F.concat_ws(" / ", "assunto", "causa_canonica").alias("dificuldade_principal"),
        action.otherwise(th.PLAYBOOK_DEFAULT[0]).alias("medida_recomendada"),
        priority.otherwise(th.PLAYBOOK_DEFAULT[1]).alias("prioridade"),
    )


def governance_health(frame: DataFrame, reference: date | str | None = None) -> DataFrame:
    """Volume, coverages and freshness with status, one row per measure."""
    today = F.lit(str(reference)).cast("date") if reference else F.current_date()
    filled = lambda c: F.avg((F.trim(F.coalesce(c, F.lit(""))) != "").cast("double"))
    base = frame.agg(
        F.count(F.lit(1)).alias("n"),
        F.size(F.collect_set("regiao")).alias("regions"),
        filled("causa_canonica").alias("causa"),
        filled("topic_name").alias("topico"),
        F.max("dt_ingresso").cast("date").alias("last"),
    ).withColumn("days", F.datediff(today, "last"))
    grade = lambda v, ok, warn: F.when(v >= ok, "ok").when(v >= warn, "warn").otherwise("crit")
    percent = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
    rows = F.array(
        F.struct(
            F.lit("Volume carregado").alias("label"),
            F.translate(F.format_number("n", 0), ",", ".").alias("value"),
            F.concat(F.col("regions").cast("string"), F.lit(" regiões")).alias("sub"),
            F.when(F.col("n") > 0, "ok").otherwise("crit").alias("status"),
        ),
        F.struct(
            F.lit("Cobertura taxonomia").alias("label"), percent("causa").alias("value"),
            F.lit("causa_canonica não-vazia").alias("sub"), grade(F.col("causa"), 0.85, 0.6).alias("status"),
        ),
        F.struct(
            F.lit("Cobertura tópicos ML").alias("label"), percent("topico").alias("value"),
            F.lit("topic_name não-vazio").alias("sub"), grade(F.col("topico"), 0.8, 0.5).alias("status"),
        ),
        F.struct(
            F.lit("Frescor do dataset").alias("label"),
            F.coalesce(F.col("last").cast("string"), F.lit("—")).alias("value"),
            F.concat(F.lit("há "), F.col("days").cast("string"), F.lit(" dias")).alias("sub"),
            F.when(F.col("days") <= 7, "ok").when(F.col("days") <= 30, "warn").when(F.col("days") > 30, "crit")
            .otherwise("ok").alias("status"),
        ),
    )
    return base.select(F.inline(rows))


def coverage_window(frame: DataFrame) -> DataFrame:
    """First day, last day and days covered by region."""
    return frame.groupBy("regiao").agg(
        F.min("data_ingresso").cast("date").alias("inicio"),
        F.max("data_ingresso").cast("date").alias("fim"),
        (F.datediff(F.max("data_ingresso"), F.min("data_ingresso")) + 1).alias("dias"),
    )


def monthly_ce_sp(frame: DataFrame) -> DataFrame:
    """Months with CE and SP side by side."""
    return (
        monthly_volume(frame).groupBy("mes_ingresso").pivot("regiao", ["CE", "SP"]).agg(F.sum("qtd_erros"))
        .na.fill(0).orderBy("mes_ingresso")
    )


def coverage_report(frame: DataFrame) -> DataFrame:
    """Rows and undefined ratio per region."""
    return frame.groupBy("regiao").agg(
        F.count(F.lit(1)).alias("linhas"),
        F.count_if(F.col("causa_canonica") == "indefinido").alias("indefinidos"),
        F.avg((F.col("causa_canonica") == "indefinido").cast("double")).alias("taxa_indefinido"),
    )


def sp_overview(frame: DataFrame) -> DataFrame:
    """A63."""
    return frame.filter("regiao = 'SP'").agg(
        distinct_orders("total_ordens"),
        F.count_if(F.col("procedencia_real") == "PROCEDENTE").alias("procedentes"),
        F.count_if(F.col("procedencia_real") == "IMPROCEDENTE").alias("improcedentes"),
        F.array_sort(F.collect_set(blank_to_null("tipo_medidor_dominante"))).alias("tipos_medidor"),
    )


def installations_by_meter_type(frame: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """A64."""
    rows = frame.filter(
        (F.col("regiao") == "SP") & F.lower(F.coalesce("tipo_medidor_dominante", F.lit(""))).contains(needle.strip().lower())
    )
    return top_by(
        rows.groupBy("instalacao").agg(
            distinct_orders(), modal("assunto", "assunto_top"), modal("causa_canonica", "causa_top"),
            modal("tipo_medidor_dominante", "tipo_medidor"),
        ),
        limit, "qtd_ordens", "instalacao",
    )


def _top_pairs(rows: DataFrame, column: str, limit: int = 5) -> DataFrame:
    counts = (
        rows.withColumn(column, blank_to_null(column)).filter(F.col(column).isNotNull())
        .groupBy("instalacao", column).agg(distinct_orders("n"))
    )
    kept = top_per_group(counts, ["instalacao"], [F.desc("n"), F.asc(column)], limit)
    return kept.groupBy("instalacao").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("valor"), "n"))).alias(f"{column}_top")
    )


def installation_details(frame: DataFrame) -> DataFrame:
    """A62 for every SP installation at once: totals, outcome counts and the five leading subjects and causes."""
    rows = _with_installation(frame.filter("regiao = 'SP'"))
    base = rows.groupBy("instalacao").agg(
        distinct_orders("total_ordens"),
        F.count_if(F.col("procedencia_real") == "PROCEDENTE").alias("procedentes"),
        F.count_if(F.col("procedencia_real") == "IMPROCEDENTE").alias("improcedentes"),
        F.countDistinct(blank_to_null("fat_reclamada_top")).alias("meses_fatura"),
    )
    return base.join(_top_pairs(rows, "assunto"), "instalacao", "left").join(
        _top_pairs(rows, "causa_canonica"), "instalacao", "left"
    )


def installation_invoices(frame: DataFrame, installation: str | None = None) -> DataFrame:
    """Invoice table per installation and month; a point lookup with ``installation``."""
    rows = _with_installation(frame.filter("regiao = 'SP'"))
    if installation is not None:
        rows = rows.filter(F.col("instalacao") == installation)
    rows = rows.withColumn("fat_reclamada_top", blank_to_null("fat_reclamada_top")).filter("fat_reclamada_top IS NOT NULL")
    return rows.groupBy("instalacao", "fat_reclamada_top").agg(
        distinct_orders(),
        F.avg("valor_fatura_reclamada_medio").alias("valor_medio"),
        F.max("valor_fatura_reclamada_max").alias("valor_max"),
        modal("tipo_medidor_dominante", "tipo_medidor"),
        modal("assunto", "assunto_top"),
        modal("causa_canonica", "causa_top"),
    )
