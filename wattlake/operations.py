"""Driver tables in the role of service orders, deliveries, payments, targets and masters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.bindings import table
from wattlake.plans import calendar as cal
from wattlake.plans import silver

REFERENCE = "1998-06-30"

# Service type per part type and state per region key.
SERVICES = {
    "ECONOMY": "CORTE", "STANDARD": "VERIFICACAO_MEDIDOR", "PROMO": "EMISSAO_SEGUNDA_VIA",
    "SMALL": "RELIGACAO", "MEDIUM": "REVISAO_LEITURA", "LARGE": "ALTERACAO_TITULARIDADE",
}
STATES = ("SP", "RJ", "CE", "GO", "SP")


def _map(pairs: dict[str, str]):
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def _lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chave"), *columns)


def state_of(region_key):
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), region_key + 1)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """One service order per order line, typed."""
    rows = _lines(
        spark, sf, "o_custkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate", "o_orderdate", "o_orderstatus",
    )
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    joined = (
        rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    cancelled = (F.col("l_tax") == 0.0) & (F.col("l_discount") == 0.0)
    return joined.select(
        F.col("chave").alias("cod_nota"), F.col("o_custkey").alias("cod_uc"),
        F.col("n_regionkey").alias("cod_distribuidora"), F.col("c_nationkey").alias("cod_ut"),
        F.col("s_nationkey").alias("cod_base"), state_of(F.col("n_regionkey")).alias("uf"),
        F.when(F.col("p_size") <= 40, F.col("p_size")).alias("cod_lote"), F.col("l_suppkey").alias("cod_colaborador"),
        _map(SERVICES)[F.col("p_type")].alias("tipo_servico"),
        (F.col("l_returnflag") != "N").alias("flag_impacto_faturamento"),
        ((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.06)).alias("area_classificada_risco"),
        F.greatest(F.col("l_linenumber") - 4, F.lit(0)).alias("historico_incidentes_12m"),
        F.when(F.col("p_size") > 45, "SUBESTACAO").otherwise("RESIDENCIAL").alias("tipo_instalacao"),
        F.concat(F.lpad(F.floor(F.col("l_quantity") / 2).cast("string"), 2, "0"), F.lit(":00")).alias("horario_agendado"),
        (F.col("l_discount") >= 0.1).alias("flag_risco_manual"),
        F.col("o_orderdate").cast("date").alias("data_criacao"),
        F.when(F.col("l_linenumber") != 7, F.date_add("o_orderdate", 30)).alias("data_prevista"),
        F.when(F.col("o_orderstatus") != "P", F.col("l_shipdate").cast("date")).alias("data_execucao"),
        F.col("l_shipdate").alias("data_alteracao"),
        F.when(cancelled, "CANCELADA").when(F.col("l_returnflag") == "R", "DEVOLVIDA")
        .when(F.col("o_orderstatus") == "P", "ABERTA").when(F.col("l_linestatus") == "F", "FECHADA")
        .otherwise("EXECUTADA").alias("status"),
    )


def silver_notes(spark: SparkSession, sf: str) -> DataFrame:
    return silver.notes(notes(spark, sf), REFERENCE)


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(
        spark, sf, "o_custkey", "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "o_orderdate", "o_orderstatus"
    )
    lat, lon = F.col("l_tax") - 23.5, F.col("l_discount") - 46.6
    shift = (F.col("l_quantity") - 25) / 20000
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (
        rows.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("chave").alias("cod_entrega"), F.col("l_orderkey").alias("cod_fatura"), F.col("o_custkey").alias("cod_uc"),
            F.col("n_regionkey").alias("cod_distribuidora"), state_of(F.col("n_regionkey")).alias("uf"),
            F.col("o_orderdate").cast("date").alias("data_emissao"),
            F.date_add("o_orderdate", 900).alias("data_vencimento"),
            F.when(F.col("o_orderstatus") != "P", F.col("l_shipdate").cast("date")).alias("data_entrega"),
            lat.alias("lat_entrega"), lon.alias("lon_entrega"), (lat + shift).alias("lat_uc"), lon.alias("lon_uc"),
            (F.col("o_orderstatus") != "P").alias("flag_entregue"),
        )
    )


def payments(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf, "o_custkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    paid = F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber") * 10 - 30)
    open_ = F.col("l_returnflag") == "R"
    return (
        rows.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("chave").alias("cod_pagamento"), F.col("l_orderkey").alias("cod_fatura"), F.col("o_custkey").alias("cod_uc"),
            state_of(F.col("n_regionkey")).alias("uf"), F.col("c_nationkey").alias("cod_base"),
            F.col("l_extendedprice").alias("valor_fatura"),
            F.when(~open_, F.col("l_extendedprice")).alias("valor_pago"),
            F.col("l_shipdate").cast("date").alias("data_vencimento"), F.when(~open_, paid).alias("data_pagamento"),
        )
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly target and result per base (supplier nation) from quantities."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(
        F.col("s_nationkey").alias("cod_base"), state_of(F.col("n_regionkey")).alias("uf"),
        F.date_format("l_shipdate", "yyyy-MM").alias("mes_referencia"),
    ).agg(
        F.lit("efetividade").alias("indicador"), F.round(F.sum("l_quantity") * 0.75, 4).alias("valor_meta"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)).alias("valor_realizado"),
    )


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Meter read attempts: returned lines are failed reads, the priority is the reason."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("cod_uc"), (F.col("l_returnflag") != "R").alias("flag_lido"),
        F.col("o_orderpriority").alias("motivo_nao_leitura"), F.col("l_shipdate").cast("date").alias("data_referencia"),
    )


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar over the span of the order and ship dates."""
    o = table(spark, sf, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    li = table(spark, sf, "lineitem").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("z"))
    bounds = o.unionByName(li).agg(F.trunc(F.min("a"), "month").alias("a"), F.last_day(F.max("z")).alias("z"))
    return cal.with_states(cal.days(bounds, "a", "z"))


def masters(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return {
        "distribuidora": r.select(
            F.col("r_regionkey").alias("cod_distribuidora"), F.upper(F.trim("r_name")).alias("nome_distribuidora"),
            state_of(F.col("r_regionkey")).alias("uf"),
        ),
        "ut": n.select(
            F.col("n_nationkey").alias("cod_ut"), F.col("n_regionkey").alias("cod_distribuidora"), F.col("n_name").alias("nome_ut")
        ),
        "base": n.select(
            F.col("n_nationkey").alias("cod_base"), F.col("n_regionkey").alias("cod_co"),
            F.concat(F.lit("BASE "), "n_name").alias("nome_base"),
        ),
        "uc": c.select(
            F.col("c_custkey").alias("cod_uc"), F.col("c_nationkey").alias("cod_base"), F.col("c_mktsegment").alias("classe_consumo")
        ),
        "colaborador": s.select(
            F.col("s_suppkey").alias("cod_colaborador"), F.col("s_name").alias("nome_colaborador"),
            F.col("s_nationkey").alias("equipe"),
        ),
    }
