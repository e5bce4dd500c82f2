"""Gold star schema: dimensions, facts and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions import rules as ru


def dimension(master: DataFrame, key: str, surrogate: str) -> DataFrame:
    """Master rows with the md5 surrogate of their key."""
    return master.select(ru.surrogate_key(F.col(key)).alias(surrogate), *master.columns)


def dim_distributor(master: DataFrame) -> DataFrame:
    """G04."""
    return dimension(master, "cod_distribuidora", "sk_distribuidora").withColumn("regiao", ru.uf_region(F.col("uf")))


def dim_lot(notes: DataFrame) -> DataFrame:
    """G06/SET03."""
    lots = notes.filter("cod_lote IS NOT NULL").select("cod_lote", "cod_base", "tipo_servico").distinct()
    return dimension(lots, "cod_lote", "sk_lote")


def dim_risk(notes: DataFrame) -> DataFrame:
    """G07."""
    pairs = notes.select("classificacao_acf_asf", "flag_risco").distinct()
    return pairs.select(
        ru.surrogate_key(F.col("classificacao_acf_asf"), F.coalesce("flag_risco", F.lit(False))).alias("sk_risco"),
        "*", F.when(F.col("flag_risco"), "RISCO").otherwise("PADRAO").alias("descricao"),
    )


def dim_cause(complaints: DataFrame) -> DataFrame:
    """G18."""
    cause = F.coalesce(F.nullif("causa_raiz", F.lit("")), F.lit("NAO_CLASSIFICADA")).alias("causa_raiz")
    return complaints.select(cause).distinct().select(
        ru.surrogate_key(F.col("causa_raiz")).alias("sk_causa_raiz"), "causa_raiz",
        (F.col("causa_raiz") != "NAO_CLASSIFICADA").alias("flag_label_humano"),
    )


def dim_region(complaints: DataFrame) -> DataFrame:
    """G19."""
    return complaints.select(F.col("_source_region").alias("regiao")).distinct().select(
        ru.surrogate_key(F.col("regiao")).alias("sk_regiao"), "regiao",
        F.when(F.col("regiao") == "CE", "Ceara").when(F.col("regiao") == "SP", "Sao Paulo").otherwise("Nao informado")
        .alias("nome_regiao"),
    )


def fact_unread(spark) -> DataFrame:
    """Empty table with the declared columns."""
    return spark.createDataFrame(
        [], "cod_tentativa string, motivo_nao_leitura string, flag_lido boolean, flag_releitura boolean"
    )


def _lookup(fact: DataFrame, dim: DataFrame, key: str | list[str], surrogate: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return fact.join(dim.select(*keys, surrogate), keys, "left")


def fact_notes(notes: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """G11/JN02/JN03: star lookups and five flags.

    Small dimensions are broadcast by Catalyst when their measured size allows; the customer-sized ones shuffle, so they come first, while the
    notes carry no other surrogate. The
    calendar joins on (day, state), which keeps one row per note. Lots may repeat per base and service, so the lookup
    uses their key alone, once.
    """
    f = notes.withColumn("data", F.col("data_criacao"))
    for name, key in (
        ("uc", "cod_uc"), ("colaborador", "cod_colaborador"), ("distribuidora", "cod_distribuidora"), ("ut", "cod_ut"), ("base", "cod_base"),
    ):
        f = _lookup(f, dims[name], key, f"sk_{name}")
    f = _lookup(f, dims["tempo"], ["data", "uf"], "sk_tempo")
    f = f.withColumn("sk_lote", F.when(F.col("cod_lote").isNotNull(), ru.surrogate_key(F.col("cod_lote"))))
    f = _lookup(f, dims["risco"], ["classificacao_acf_asf", "flag_risco"], "sk_risco")
    late, status = F.col("status_atraso"), F.col("status")
    return f.select(
        "sk_tempo", "sk_distribuidora", "sk_ut", "sk_base", "sk_uc", "sk_colaborador", "sk_lote", "sk_risco", "cod_nota",
        "dias_atraso",
        F.coalesce(late == "NO_PRAZO", F.lit(False)).alias("flag_no_prazo"),
        F.coalesce(status.isin("EXECUTADA", "FECHADA"), F.lit(False)).alias("flag_executada"),
        F.coalesce(late == "ATRASADO", F.lit(False)).alias("flag_atrasada"),
        F.coalesce(status == "DEVOLVIDA", F.lit(False)).alias("flag_devolvida"),
        F.coalesce(status == "CANCELADA", F.lit(False)).alias("flag_cancelada"),
        "tipo_servico", F.col("status").alias("status_nota"), "status_atraso", "classificacao_acf_asf",
    )


def _pct(flag: str, alias: str):
    return F.round(F.sum(F.col(flag).cast("int")) * 100.0 / F.count(F.lit(1)), 2).alias(alias)


def _n(flag: str, alias: str):
    return F.sum(F.col(flag).cast("long")).alias(alias)


def fact_effectiveness(fact: DataFrame, keys: tuple[str, ...] = ("sk_tempo", "sk_base", "sk_distribuidora")) -> DataFrame:
    """G12."""
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_notas"), _n("flag_executada", "notas_executadas"), _n("flag_no_prazo", "notas_no_prazo"),
        _n("flag_devolvida", "notas_devolvidas"), _pct("flag_executada", "efetividade_bruta_pct"),
        _pct("flag_no_prazo", "efetividade_liquida_pct"), _pct("flag_devolvida", "taxa_devolucao_pct"),
    )


def fact_deliveries(deliveries: DataFrame, tempo: DataFrame, ucs: DataFrame, bases: DataFrame) -> DataFrame:
    """G13/JN04: snowflake lookup delivery -> consumer unit -> base."""
    f = deliveries.withColumn("data", F.col("data_emissao"))
    f = _lookup(f, tempo, ["data", "uf"], "sk_tempo").join(ucs.select("cod_uc", "sk_uc", "cod_base"), "cod_uc", "left")
    f = _lookup(f, bases, "cod_base", "sk_base")
    return f.select(
        "sk_tempo", "sk_uc", "sk_base", "cod_entrega", "cod_fatura", "flag_entregue", "dias_para_entrega",
        "flag_antes_vencimento", "flag_dentro_coordenada", "distancia_metros",
    )


def fact_delivery_coordinates(fact: DataFrame, keys: tuple[str, ...] = ("sk_tempo", "sk_base")) -> DataFrame:
    """G14."""
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tentativas_entrega"), _n("flag_dentro_coordenada", "entregas_dentro_coordenada"),
        _pct("flag_dentro_coordenada", "taxa_coordenada_pct"), F.avg("distancia_metros").alias("distancia_media"),
    )


def fact_payments(payments: DataFrame, tempo: DataFrame, ucs: DataFrame, bases: DataFrame) -> DataFrame:
    """G17."""
    f = payments.withColumn("data", F.col("data_vencimento"))
    f = _lookup(f, tempo, ["data", "uf"], "sk_tempo").join(ucs.select("cod_uc", "sk_uc", "cod_base"), "cod_uc", "left")
    f = _lookup(f, bases, "cod_base", "sk_base")
    return f.select(
        "sk_tempo", "sk_uc", "sk_base", "cod_pagamento", "cod_fatura", "valor_fatura", "valor_pago", "flag_inadimplente",
        "dias_atraso_pagamento",
    )


def fact_targets(targets: DataFrame, tempo: DataFrame, bases: DataFrame) -> DataFrame:
    """G15/JN05: calendar joined on the first day of the month text; merge key is (base, month, indicator)."""
    f = targets.withColumn("data", F.to_date(F.concat("mes_referencia", F.lit("-01"))))
    f = _lookup(_lookup(f, tempo, ["data", "uf"], "sk_tempo"), bases, "cod_base", "sk_base")
    return f.select(
        "sk_tempo", "sk_base", "indicador", "mes_referencia", "valor_meta", "valor_realizado", "pct_atingimento",
        "status_meta", (F.col("valor_meta") - F.col("valor_realizado")).alias("gap_absoluto"),
    )


def fact_reading_errors(complaints: DataFrame, regions: DataFrame, causes: DataFrame) -> DataFrame:
    """G20."""
    rows = complaints.filter(F.col("_data_type").isin("erro_leitura", "base_n1_sp")).withColumns(
        {
            "regiao": F.col("_source_region"),
            "_cause": F.coalesce(F.nullif("causa_raiz", F.lit("")), F.lit("NAO_CLASSIFICADA")),
            "data_ingresso": F.col("dt_ingresso").cast("date"),
        }
    )
    rows = _lookup(rows, regions, "regiao", "sk_regiao")
    rows = rows.join(causes.select(F.col("causa_raiz").alias("_cause"), "sk_causa_raiz"), "_cause", "left")
    rebill = F.lower(F.col("flag_resolvido_com_refaturamento").cast("string")) == "true"
    return rows.select(
        "sk_regiao", "sk_causa_raiz", "ordem", "instalacao", "assunto", "data_ingresso", "status", "causa_raiz", "regiao",
        rebill.alias("flag_resolvido_com_refaturamento"), rebill.cast("int").alias("qtd_refaturamento"),
        F.lit(1).alias("qtd_erros"),
    )


def hotspots(fact: DataFrame) -> DataFrame:
    """G21."""
    return fact.groupBy(
        "regiao", F.coalesce("causa_raiz", F.lit("NAO_CLASSIFICADA")).alias("classe_erro"), F.col("data_ingresso").alias("data")
    ).agg(F.count(F.lit(1)).alias("qtd_erros"))


def patterns(fact: DataFrame) -> DataFrame:
    """G22/JN08/WIN16: daily counts with their share of the grand total."""
    counts = fact.groupBy(
        F.coalesce("causa_raiz", F.lit("NAO_CLASSIFICADA")).alias("topic_name"), F.col("data_ingresso").alias("data")
    ).agg(F.count(F.lit(1)).alias("quantidade"))
    total = fact.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return counts.withColumn("percentual", F.round(F.col("quantidade") * 100.0 / F.nullif(total, F.lit(0)), 2))


def intelligence(fact: DataFrame, spots: DataFrame) -> DataFrame:
    """JN07: fact rows with the scores of their hotspot."""
    keyed = fact.withColumns(
        {"classe_erro": F.coalesce("causa_raiz", F.lit("NAO_CLASSIFICADA")), "data": F.col("data_ingresso")}
    )
    return keyed.join(spots.select("regiao", "classe_erro", "data", "anomaly_score", "is_anomaly"), ["regiao", "classe_erro", "data"], "left")


def classified(complaints: DataFrame) -> DataFrame:
    """G23."""
    return complaints.withColumn(
        "criticidade_operacional", ru.criticality(F.col("is_root_cause"), F.col("ind_refaturamento"))
    )


def monthly_themes(fact: DataFrame) -> DataFrame:
    """G24."""
    return fact.groupBy(F.trunc("data_ingresso", "month").alias("mes"), "regiao", "macrotema").agg(
        F.count("ordem").alias("total_reclamacoes"), F.sum("ind_refaturamento").alias("total_refaturamentos"),
        (F.sum("ind_refaturamento") / F.nullif(F.count("ordem"), F.lit(0))).alias("pct_refaturamento"),
    )


def cause_pareto(fact: DataFrame) -> DataFrame:
    """G25."""
    return (
        fact.filter("is_root_cause").groupBy("regiao", "macrotema", "causa_raiz_inferida")
        .agg(
            F.count("ordem").alias("qtd_ocorrencias"), F.sum("ind_refaturamento").alias("qtd_refaturamento"),
            (F.sum("ind_refaturamento") / F.nullif(F.count("ordem"), F.lit(0))).alias("pct_refaturamento"),
        )
        .orderBy(F.desc("qtd_ocorrencias"))
    )


def operational_overview(fact: DataFrame, tempo: DataFrame, distributors: DataFrame, uts: DataFrame, bases: DataFrame) -> DataFrame:
    """G26/JN06: inner star join for reporting. The fact is grouped by its surrogate keys before the lookups, so the
    joins carry group rows instead of fact rows."""
    sums = fact.groupBy("sk_tempo", "sk_distribuidora", "sk_ut", "sk_base").agg(
        F.count(F.lit(1)).alias("n"), _n("flag_executada", "ex"), _n("flag_no_prazo", "np"), _n("flag_atrasada", "at"),
        F.sum("dias_atraso").alias("dias"),
    )
    joined = (
        sums.join(tempo.select("sk_tempo", "ano_mes"), "sk_tempo")
        .join(distributors.select("sk_distribuidora", "nome_distribuidora"), "sk_distribuidora")
        .join(uts.select("sk_ut", "nome_ut"), "sk_ut")
        .join(bases.select("sk_base", "nome_base"), "sk_base")
    )
    return joined.groupBy("ano_mes", "nome_distribuidora", "nome_ut", "nome_base").agg(
        F.sum("n").alias("total_notas"), F.sum("ex").alias("executadas"), F.sum("np").alias("no_prazo"),
        F.sum("at").alias("atrasadas"), F.round(F.sum("np") * 100.0 / F.sum("n"), 2).alias("efetividade_pct"),
        F.round(F.sum("dias") / F.sum("n"), 1).alias("atraso_medio"),
    )


def effectiveness_by_worker(fact: DataFrame) -> DataFrame:
    """G27."""
    return fact.groupBy("sk_colaborador").agg(F.count(F.lit(1)).alias("total_notas"), _n("flag_no_prazo", "no_prazo"))
