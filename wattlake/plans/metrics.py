"""Documented operational metrics at any grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.functions import rules as ru


def pct(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, half up; NULL for an empty whole."""
    return F.round(F.try_divide(part * 100.0, whole), 2)


def delivery_metrics(deliveries: DataFrame, *keys: str) -> DataFrame:
    """M01."""
    done = F.count_if("flag_entregue")
    return deliveries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("emitidas"), pct(done, F.count(F.lit(1))).alias("taxa_entrega_pct"),
        F.round(F.avg("dias_para_entrega"), 4).alias("prazo_medio_dias"),
        pct(F.count_if("flag_antes_vencimento"), done).alias("taxa_antes_vencimento_pct"),
        pct(F.count_if("flag_dentro_coordenada"), F.count(F.lit(1))).alias("taxa_coordenada_pct"),
    )


def effectiveness(notes: DataFrame, *keys: str) -> DataFrame:
    """M02/M03."""
    executed = F.col("status").isin("EXECUTADA", "FECHADA")
    total = F.count(F.lit(1))
    return notes.groupBy(*keys).agg(
        total.alias("atribuidas"), pct(F.count_if(executed), total).alias("efetividade_bruta_pct"),
        pct(F.count_if(executed & (F.col("status_atraso") == "NO_PRAZO")), total).alias("efetividade_liquida_pct"),
        pct(F.count_if(F.col("status") == "DEVOLVIDA"), total).alias("taxa_devolucao_pct"),
        pct(F.count_if(F.col("status_atraso").isin("ATRASADO", "PENDENTE_FORA_PRAZO")), total).alias("taxa_atraso_pct"),
        F.round(F.avg(F.when(F.col("dias_atraso") > 0, F.col("dias_atraso"))), 4).alias("atraso_medio_dias"),
    )


def worker_productivity(notes: DataFrame) -> DataFrame:
    """Mean executed notes per active day of a worker."""
    daily = (
        notes.filter(F.col("status").isin("EXECUTADA", "FECHADA") & F.col("data_execucao").isNotNull())
        .groupBy("cod_colaborador", "data_execucao").agg(F.count(F.lit(1)).alias("n"))
    )
    return daily.groupBy("cod_colaborador").agg(
        F.sum("n").alias("executadas"), F.count(F.lit(1)).alias("dias_ativos"), F.round(F.avg("n"), 6).alias("produtividade_media")
    )


def rework(notes: DataFrame) -> DataFrame:
    """Share of consumer units with more than one execution."""
    per_unit = notes.filter(F.col("status").isin("EXECUTADA", "FECHADA")).groupBy("cod_uc").agg(F.count(F.lit(1)).alias("n"))
    return per_unit.agg(
        F.count_if(F.col("n") > 1).alias("com_retrabalho"), F.count(F.lit(1)).alias("total"),
        pct(F.count_if(F.col("n") > 1), F.count(F.lit(1))).alias("taxa_retrabalho_pct"),
    )


def delay_bands(notes: DataFrame) -> DataFrame:
    """M04."""
    return notes.groupBy(ru.delay_band(F.col("dias_atraso")).alias("faixa")).agg(F.count(F.lit(1)).alias("qtd_notas"))


def open_aging(notes: DataFrame, reference: str) -> DataFrame:
    """M05."""
    days = F.datediff(F.lit(reference).cast("date"), F.col("data_prevista"))
    return (
        notes.filter(~F.col("status").isin("EXECUTADA", "FECHADA", "CANCELADA"))
        .groupBy(ru.aging_band(days).alias("faixa_aging")).agg(F.count(F.lit(1)).alias("qtd_notas"))
    )


def default_rate(payments: DataFrame, reference: str) -> DataFrame:
    """Share of units with an overdue open invoice, and the open value."""
    overdue = F.col("data_pagamento").isNull() & (F.col("data_vencimento") < F.lit(reference).cast("date"))
    per_unit = payments.groupBy("cod_uc").agg(
        F.max(overdue.cast("int")).alias("d"), F.sum(F.when(overdue, F.col("valor_fatura"))).alias("v")
    )
    return per_unit.agg(
        F.count(F.lit(1)).alias("ucs"), F.sum("d").alias("ucs_inadimplentes"),
        pct(F.sum("d"), F.count(F.lit(1))).alias("taxa_inadimplencia_pct"), F.round(F.sum("v"), 2).alias("valor_inadimplente_total"),
    )


def debt_aging(payments: DataFrame, reference: str) -> DataFrame:
    """Unpaid invoices by days past due."""
    days = F.datediff(F.lit(reference).cast("date"), F.col("data_vencimento"))
    return (
        payments.filter(F.col("data_pagamento").isNull() & (days > 0))
        .groupBy(ru.debt_band(days).alias("faixa"))
        .agg(F.count(F.lit(1)).alias("faturas"), F.round(F.sum("valor_fatura"), 2).alias("valor"))
    )


def debt_profiles(payments: DataFrame, reference: str) -> DataFrame:
    """Units per recurrence profile over the last twelve months."""
    start = F.add_months(F.lit(reference).cast("date"), -12)
    late = F.col("data_pagamento").isNull() | (F.col("data_pagamento") > F.col("data_vencimento"))
    window = (F.col("data_vencimento") > start) & (F.col("data_vencimento") <= F.lit(reference).cast("date"))
    months = payments.groupBy("cod_uc").agg(
        F.countDistinct(F.when(late & window, F.trunc("data_vencimento", "month"))).alias("m")
    )
    return months.groupBy(ru.debt_profile(F.col("m")).alias("perfil_inadimplencia")).agg(F.count(F.lit(1)).alias("ucs"))


def target_projection(targets: DataFrame, calendar: DataFrame, reference: str) -> DataFrame:
    """Linear projection over the business days of the month of the reference day."""
    ref = F.lit(reference).cast("date")
    month = (
        calendar.filter("flag_dia_util").groupBy(F.col("ano_mes").alias("mes_referencia"), "uf")
        .agg(F.count_if(F.col("data") <= ref).alias("decorridos"), F.count_if(F.col("data") > ref).alias("restantes"))
    )
    daily = F.try_divide(F.col("valor_realizado"), F.col("decorridos"))
    projected = F.col("valor_realizado") + daily * F.col("restantes")
    share = F.try_divide(projected, F.col("valor_meta")) * 100
    return targets.join(month, ["mes_referencia", "uf"]).select(
        "cod_base", "mes_referencia", "decorridos", "restantes",
        F.round(F.col("valor_meta") - F.col("valor_realizado"), 6).alias("gap_absoluto"),
        pct(F.col("valor_meta") - F.col("valor_realizado"), F.col("valor_meta")).alias("gap_pct"),
        F.round(share, 6).alias("pct_projecao"), ru.projection_status(share).alias("status_risco_meta"),
    )


def unread_reasons(reads: DataFrame) -> DataFrame:
    """M09/WIN16: failed reads by reason with their share of all failed reads."""
    failed = reads.filter(~F.col("flag_lido"))
    total = failed.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return failed.groupBy("motivo_nao_leitura").agg(F.count(F.lit(1)).alias("ocorrencias")).withColumn(
        "pct", F.round(F.col("ocorrencias") * 100.0 / total, 2)
    )


def unread_rate(reads: DataFrame, *keys: str) -> DataFrame:
    """M09."""
    failed = F.count_if(~F.col("flag_lido"))
    return reads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tentativas"), pct(failed, F.count(F.lit(1))).alias("taxa_nao_lidos_pct")
    )


def repeat_unread(reads: DataFrame, reference: str, at_least: int = 3) -> DataFrame:
    """Units with repeated failed reads in the last six months."""
    start = F.add_months(F.lit(reference).cast("date"), -6)
    return (
        reads.filter(~F.col("flag_lido") & (F.col("data_referencia") >= start))
        .groupBy("cod_uc").agg(F.count(F.lit(1)).alias("meses_nao_lido")).filter(F.col("meses_nao_lido") >= at_least)
    )


PERIODS = ("ano", "trimestre", "mes", "semana", "dia")


def rollup(notes: DataFrame, levels: list[str], time: str, periods: tuple[str, ...] = PERIODS, unit: str = "cod_uc") -> DataFrame:
    """Every level of a hierarchy at every level of the calendar (year, quarter, month, week, day), in one pass.

    ``nivel`` and ``periodo`` count the levels that are summed up, 0 being the finest. Units are counted exactly without a (cell, unit) pair
    ever travelling: the notes of a unit meet once, and a unit counts in a cell with its earliest note there. A note knows from the day before it at
    the same place how far up the calendar it is the earliest. Counts of (place, day) then travel once, dealt by place, and are summed up to the periods there.
    """
    day = F.col(time).cast("date")
    of = {
        "ano": F.year, "trimestre": lambda d: F.trunc(d, "quarter"), "mes": lambda d: F.trunc(d, "month"), "semana": lambda d: F.trunc(d, "week"), "dia": lambda d: d,
    }
    # A week can lie in two months; it is a part of its month here, as a roll-up has one parent a cell.
    never, places = len(periods) + 1, range(len(levels) + 1)
    rows = notes.select(*levels, F.col(unit).alias("_unit"), "status_atraso", "dias_atraso", day.alias("_day"))
    # Units are dealt in buckets, so that the tasks of a bucket can sum its days before they travel; notes without a unit are dealt by their cell.
    # Both shuffles keep their number of partitions: a note becomes up to 42 rows behind them, and merged partitions would sort and sum on disk.
    buckets = 4 * int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.when(F.col("_unit").isNull(), F.hash(*levels, "_day")).otherwise(F.hash("_unit"))
    merged = rows.withColumn("_bucket", F.pmod(dealt, F.lit(buckets))).repartition(buckets, "_bucket").groupBy("_bucket", "_unit", *levels, "_day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_atraso") == "ATRASADO").alias("a"), F.sum("dias_atraso").alias("d")
    )
    # The number of calendar levels at which a note still has company by an earlier one of its unit: it is the first of them in the levels from there on.
    for i in places:
        earlier = F.lag(F.struct("_day")).over(Window.partitionBy("_bucket", "_unit", *levels[:i]).orderBy("_day"))
        fresh = F.lit(never)
        for k in range(len(periods), 0, -1):
            start = of[periods[k - 1]]
            fresh = F.when(~start(F.col(f"_e{i}._day")).eqNullSafe(start(F.col("_day"))), k).otherwise(fresh)
        fresh = F.when(F.col("_unit").isNull(), never).when(F.col(f"_e{i}").isNull(), 0).otherwise(fresh)
        merged = merged.withColumn(f"_e{i}", earlier).withColumn(f"_f{i}", fresh).drop(f"_e{i}")
    up = lambda names, i: [F.when(F.lit(k < i), F.col(c)).alias(c) for k, c in enumerate(names)]
    place = F.array(*[F.struct(F.lit(len(levels) - i).cast("long").alias("nivel"), *up(levels, i), F.col(f"_f{i}").alias("f")) for i in places])
    placed = merged.select("_bucket", "_day", "n", "a", "d", F.explode(place).alias("p")).select("_bucket", "p.*", "_day", "n", "a", "d")
    days = placed.groupBy("_bucket", "nivel", *levels, "_day").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("d").alias("d"), *[F.count_if(F.col("f") <= k).alias(f"u{k}") for k in range(never)]
    )
    calendar = days.repartition(buckets, "nivel", *levels).withColumns({c: of[c](F.col("_day")) for c in periods})
    period = F.array(
        *[F.struct(F.lit(len(periods) - k).cast("long").alias("periodo"), *up(periods, k), F.col(f"u{k}").alias("u")) for k in range(never)]
    )
    cells = calendar.select("nivel", *levels, "n", "a", "d", F.explode(period).alias("t")).select("nivel", *levels, "t.*", "n", "a", "d")
    return cells.groupBy(*levels, *periods, "nivel", "periodo").agg(
        F.sum("n").alias("total"), F.sum("a").alias("atrasadas"), F.sum("d").alias("dias_atraso"), F.sum("u").alias("unidades")
    )
