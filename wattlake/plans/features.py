"""Point-in-time feature sets, hotspot detection, drift and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattlake.functions.rules import clip
from wattlake.operators.quantiles import linear_percentiles, order_statistics
from wattlake.operators.runs import run_lengths


def number(column: str) -> Column:
    """PRJ27: number with 0 for missing or unreadable values."""
    return F.coalesce(F.col(column).try_cast("double"), F.lit(0.0))


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns})


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def delay_features(notes: DataFrame, observation: str) -> DataFrame:
    """ML01: order features known on the observation day.

    Each entity is aggregated once with conditional aggregates for all its windows, then joined back. ``taxa_atraso``
    counts returned orders, as the source does.
    """
    obs = F.lit(observation).cast("date")
    base = notes.filter((F.col("data_criacao") <= obs) & (F.col("status") != "CANCELADA")).withColumns(
        {
            "dias_ate_vencimento": F.coalesce(F.datediff("data_prevista", "data_criacao").cast("double"), F.lit(0.0)),
            "dia_semana_criacao": F.coalesce(F.weekday("data_criacao"), F.lit(0)),
            "dia_semana_previsto": F.coalesce(F.weekday("data_prevista"), F.lit(0)),
            "flag_fim_de_mes": F.coalesce((F.dayofmonth("data_prevista") >= 25).cast("int"), F.lit(0)),
            "flag_inicio_de_mes": F.coalesce((F.dayofmonth("data_prevista") <= 5).cast("int"), F.lit(1)),
        }
    )
    returned = F.col("status") == "DEVOLVIDA"
    done = F.col("status").isin("EXECUTADA", "FECHADA")
    since = lambda days: F.col("data_criacao") >= F.date_sub(obs, days)
    units = base.filter(since(90)).groupBy("cod_uc").agg(
        F.count("cod_nota").alias("qtd_notas_uc_90d"),
        _share(returned).alias("taxa_atraso_uc_90d"),
        F.avg("dias_ate_vencimento").alias("media_dias_ate_vencimento_uc"),
        F.max("dias_ate_vencimento").alias("max_dias_ate_vencimento_uc"),
        F.count_if(returned).alias("qtd_devolucoes_uc_90d"),
    )
    week = since(7)
    bases = base.filter(since(30)).groupBy("cod_base").agg(
        F.avg(F.when(week, returned.cast("double"))).alias("taxa_atraso_base_7d"),
        F.count_if(week).alias("volume_notas_base_7d"),
        F.avg(F.when(week, done.cast("double"))).alias("efetividade_base_7d"),
        _share(returned).alias("taxa_atraso_base_30d"),
        F.countDistinct("cod_colaborador").alias("colaboradores_ativos_30d"),
    )
    workers = base.filter(since(30) & F.col("cod_colaborador").isNotNull()).groupBy("cod_colaborador").agg(
        _share(returned).alias("taxa_atraso_colaborador_30d"),
        (F.count("cod_nota") / 30.0).alias("produtividade_colaborador_dia"),
        _share(returned).alias("taxa_devolucao_colaborador_30d"),
    )
    joined = base.join(units, "cod_uc", "left").join(bases, "cod_base", "left").join(workers, "cod_colaborador", "left")
    active = F.coalesce(F.nullif(F.col("colaboradores_ativos_30d"), F.lit(0)), F.lit(1))
    late = F.greatest(F.datediff(F.coalesce("data_execucao", obs), "data_prevista"), F.lit(0))
    out = joined.withColumns(
        {
            "carga_colaboradores_base": F.coalesce("volume_notas_base_7d", F.lit(0)) / active,
            "target_flag_atraso": F.col("status").isin("DEVOLVIDA", "REABERTA").cast("int"),
            "target_dias_atraso": F.when(F.col("data_prevista").isNotNull(), late),
            "_observation_date": obs,
        }
    )
    return zero_fill(
        out,
        [
            "historico_incidentes_12m", "qtd_notas_uc_90d", "taxa_atraso_uc_90d", "media_dias_ate_vencimento_uc",
            "max_dias_ate_vencimento_uc", "qtd_devolucoes_uc_90d", "taxa_atraso_base_7d", "volume_notas_base_7d",
            "efetividade_base_7d", "taxa_atraso_base_30d", "colaboradores_ativos_30d", "taxa_atraso_colaborador_30d",
            "produtividade_colaborador_dia", "taxa_devolucao_colaborador_30d", "carga_colaboradores_base", "target_dias_atraso",
        ],
    )


def default_features(payments: DataFrame, observation: str, units: DataFrame | None = None) -> DataFrame:
    """ML02: payment features with 3, 6 and 12 month unit history and the run of unpaid invoices."""
    obs = F.lit(observation).cast("date")
    base = payments.filter(F.col("data_vencimento") <= obs).withColumns(
        {
            "valor_fatura": number("valor_fatura"),
            "valor_pago": number("valor_pago"),
            "dias_atraso_pagamento": F.greatest(
                F.datediff(F.coalesce("data_pagamento", obs), "data_vencimento"), F.lit(0)
            ).cast("double"),
            "flag_inadimplente": (
                F.col("data_pagamento").isNull() | (F.col("data_pagamento") > F.col("data_vencimento"))
            ).cast("int"),
            "mes_referencia": F.month("data_vencimento"),
            "trimestre_referencia": F.quarter("data_vencimento"),
        }
    )
    aggregates = []
    for months in (3, 6, 12):
        recent = F.col("data_vencimento") >= F.date_sub(obs, 30 * months)
        aggregates += [
            F.count_if(recent).alias(f"qtd_faturas_uc_{months}m"),
            F.avg(F.when(recent, F.col("flag_inadimplente"))).alias(f"taxa_inadimplencia_uc_{months}m"),
            F.avg(F.when(recent, F.col("dias_atraso_pagamento"))).alias(f"media_dias_atraso_uc_{months}m"),
        ]
    history = base.filter(F.col("data_vencimento") >= F.date_sub(obs, 360)).groupBy("cod_uc").agg(*aggregates)
    runs = run_lengths(
        base, "cod_uc", [F.col("data_vencimento"), F.col("cod_pagamento")], F.col("flag_inadimplente") == 1,
        F.trunc("data_vencimento", "month"), "meses_consecutivos_inadimplente",
    )
    out = runs.join(history, "cod_uc", "left")
    names = [a for m in (3, 6, 12) for a in (f"qtd_faturas_uc_{m}m", f"taxa_inadimplencia_uc_{m}m", f"media_dias_atraso_uc_{m}m")]
    if units is not None:
        placed = out.drop("cod_base").join(units.select("cod_uc", "cod_base"), "cod_uc", "left")
        regional = placed.groupBy("cod_base").agg(
            F.avg("flag_inadimplente").alias("taxa_inadimplencia_base"), F.avg("valor_fatura").alias("valor_medio_base")
        )
        out = placed.join(regional, "cod_base", "left")
        names += ["taxa_inadimplencia_base", "valor_medio_base"]
    return zero_fill(out.withColumn("_observation_date", obs), names)


def target_features(targets: DataFrame, observation: str) -> DataFrame:
    """ML03/WIN11: percentage, previous month, three-month mean, gap and change per base."""
    obs = F.trunc(F.lit(observation).cast("date"), "month")
    w = W.partitionBy("cod_base").orderBy("mes_referencia")
    goal = F.when(F.col("valor_meta") == 0, 1.0).otherwise(F.col("valor_meta"))
    base = (
        targets.withColumn("mes_referencia", F.to_date(F.concat("mes_referencia", F.lit("-01"))))
        .filter(F.col("mes_referencia") <= obs)
        .withColumns({"valor_meta": number("valor_meta"), "valor_realizado": number("valor_realizado")})
        .withColumn("pct_atingimento", clip(F.col("valor_realizado") * 100.0 / goal, 0.0, 200.0))
    )
    pct = F.col("pct_atingimento")
    return base.withColumns(
        {
            "lag_1_pct": F.coalesce(F.lag("pct_atingimento").over(w), F.lit(0.0)),
            "lag_3_media_pct": F.avg("pct_atingimento").over(w.rowsBetween(-2, 0)),
            "gap_meta": F.col("valor_meta") - F.col("valor_realizado"),
            "tendencia_mensal": F.coalesce(pct - F.lag("pct_atingimento").over(w), F.lit(0.0)),
            "target_pct_atingimento": pct,
            "target_flag_risco": (pct < 90.0).cast("int"),
            "_observation_date": F.lit(observation).cast("date"),
        }
    )


def anomaly_features(notes: DataFrame, observation: str, payments: DataFrame | None = None, keep=None) -> DataFrame:
    """ML04: rates per entity and the population z-score of each; mean and deviation enter as scalar subqueries.

    ``keep(frame)`` writes the rates, a row an entity, so all that reads the scores reads notes and payments once.
    """
    obs = F.lit(observation).cast("date")
    agg = notes.filter(F.col("data_criacao") <= obs).groupBy(F.col("cod_base").alias("entidade_id")).agg(
        F.count("status").cast("double").alias("total_notas"),
        _share(F.col("status") == "DEVOLVIDA").alias("taxa_devolucao"),
        _share(F.col("status") == "CANCELADA").alias("taxa_cancelamento"),
    )
    metrics = ["total_notas", "taxa_devolucao", "taxa_cancelamento"]
    if payments is not None:
        late = F.col("data_pagamento").isNull() | (F.col("data_pagamento") > F.col("data_vencimento"))
        rates = payments.filter(F.col("data_vencimento") <= obs).groupBy(F.col("cod_base").alias("entidade_id")).agg(
            _share(late).alias("taxa_inadimplencia")
        )
        agg = agg.join(rates, "entidade_id", "left")
        metrics.append("taxa_inadimplencia")
    agg = keep(agg) if keep else agg
    stats = agg.agg(F.struct(*[F.struct(F.avg(m).alias("m"), F.stddev_pop(m).alias("s")).alias(m) for m in metrics]).alias("st"))
    scored = agg.withColumn("_st", stats.select("st").scalar())
    out = scored.withColumns(
        {
            f"{m}_zscore": F.when(F.col(f"_st.{m}.s") == 0, 0.0).otherwise(
                (F.col(m) - F.col(f"_st.{m}.m")) / F.col(f"_st.{m}.s")
            )
            for m in metrics
        }
    ).drop("_st")
    return zero_fill(out, [*metrics, *[f"{m}_zscore" for m in metrics]]).withColumn("_observation_date", obs)


def daily_hotspots(df: DataFrame, time: str, region: str, cause: str, threshold: float = 3.0) -> DataFrame:
    """ML09/WIN10: daily counts per region and class with the rolling z-score of the last seven rows.

    The windows run over daily counts, so the largest partition is the number of days of a series.
    """
    counts = (
        df.filter(F.col(time).isNotNull())
        .groupBy(F.col(time).cast("date").alias("data"), F.col(region).alias("regiao"), F.col(cause).alias("classe_erro"))
        .agg(F.count(F.lit(1)).alias("qtd_erros"))
    )
    return score_daily_counts(counts, threshold)


def score_daily_counts(counts: DataFrame, threshold: float = 3.0, share: float = 0.1) -> DataFrame:
    """Rolling mean, sample deviation and z-score over the last seven rows of each series, and which rows are unusual among all."""
    w = W.partitionBy("regiao", "classe_erro").orderBy("data").rowsBetween(-6, 0)
    spread = F.coalesce(F.stddev_samp("qtd_erros").over(w), F.lit(0.0))
    scored = counts.withColumns({"rolling_mean_7d": F.avg("qtd_erros").over(w), "rolling_std_7d": spread})
    z = (F.col("qtd_erros") - F.col("rolling_mean_7d")) / F.when(F.col("rolling_std_7d") == 0, 1.0).otherwise(F.col("rolling_std_7d"))
    return flag_unusual(scored.withColumn("zscore", z), ["qtd_erros", "rolling_mean_7d", "zscore"], "zscore", threshold, share)


def flag_unusual(df: DataFrame, columns: list[str], z: str, threshold: float, share: float, fewest: int = 4) -> DataFrame:
    """ML09: ``anomaly_score`` and ``is_anomaly``. The score is the distance of a row from the mean of all rows, each column in its own deviations,
    less the exact quantile that leaves ``share`` of the rows above it; so rows above 0 are unusual, whatever the scale of the counts.

    A z-score inside its own seven rows never exceeds 2.27, so it cannot flag alone. Fewer than ``fewest`` rows have no quantile and go by z.
    """
    stats = df.agg(
        F.struct(F.count(F.lit(1)).alias("_rows"), *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("st")
    ).select("st").scalar()
    held = df.withColumn("_st", stats)
    parts = [(F.col(c) - F.col(f"_st.{c}.m")) / F.when(F.col(f"_st.{c}.s") > 0, F.col(f"_st.{c}.s")).otherwise(1.0) for c in columns]
    squares = parts[0] * parts[0]
    for x in parts[1:]:
        squares = squares + x * x
    far = held.withColumn("_far", F.round(F.sqrt(squares), 9))
    cut = linear_percentiles(far, [], "_far", {"cut": 1 - share}).select("cut").scalar()
    many = F.col("_st._rows") >= fewest
    score = F.when(many, F.round(F.col("_far") - cut, 9)).otherwise(F.abs(z))
    flagged = far.withColumn("anomaly_score", score)
    return flagged.withColumn("is_anomaly", (many & (F.col("anomaly_score") > 0)) | (F.abs(z) >= threshold)).drop("_st", "_far")


def drift(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """ML11: population stability index per column.

    Both frames are unpivoted to (feature, value). The inner edges are exact interpolated quantiles of the reference
    (a handful per feature); values outside its range are left out and the last bin is closed.
    """
    unpivot = lambda df: df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("v")) for c in columns]))
    )
    ref, cur = unpivot(reference), unpivot(current)
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    quantiles = linear_percentiles(ref, ["feature"], "v", names)
    edges = quantiles.select("feature", F.array_distinct(F.array(*[F.col(n) for n in names])).alias("edges"))
    sizes = ref.groupBy("feature").agg(F.count(F.lit(1)).alias("n_ref")).join(
        cur.groupBy("feature").agg(F.count(F.lit(1)).alias("n_cur")), "feature"
    )

    def histogram(df: DataFrame, alias: str) -> DataFrame:
        # Values are reduced to counts before meeting the edges.
        counted = df.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c"))
        below = F.size(F.filter("edges", lambda e: e <= F.col("v")))
        return (
            counted.join(edges, "feature")
            .filter((F.col("v") >= F.element_at("edges", 1)) & (F.col("v") <= F.element_at("edges", -1)))
            .groupBy("feature", F.least(below, F.size("edges") - 1).alias("bin"))
            .agg(F.sum("c").alias(alias))
        )

    grid = edges.filter(F.size("edges") > 2).select("feature", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    joined = (
        grid.join(histogram(ref, "a"), ["feature", "bin"], "left").join(histogram(cur, "b"), ["feature", "bin"], "left")
        .join(sizes, "feature")
    )
    r = F.greatest(F.coalesce("a", F.lit(0)) / F.col("n_ref"), F.lit(1e-6))
    c = F.greatest(F.coalesce("b", F.lit(0)) / F.col("n_cur"), F.lit(1e-6))
    psi = joined.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("drift_score"))
    full = edges.select("feature").join(psi, "feature", "left").na.fill(0.0, ["drift_score"])
    score = F.col("drift_score")
    return full.withColumn(
        "status", F.when(score < 0.1, "STABLE").when(score < 0.25, "WARNING").otherwise("CRITICAL")
    ).withColumnRenamed("feature", "feature_name")


def explanations(df: DataFrame, columns: list[str], alias: str = "explanations") -> DataFrame:
    """FN27: three largest absolute feature values with their direction, as JSON."""
    items = F.array(
        *[
            F.struct(
                (-F.abs(F.col(c).cast("double"))).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("n"), F.col(c).cast("double").alias("v")
            )
            for i, c in enumerate(columns)
        ]
    )
    top = F.transform(
        F.slice(F.array_sort(items), 1, 3),
        lambda e: F.struct(
            e["n"].alias("feature_name"), e["v"].alias("shap_value"),
            F.when(e["v"] >= 0, "AUMENTA_RISCO").otherwise("DIMINUI_RISCO").alias("direction"),
        ),
    )
    return df.withColumn(alias, F.to_json(top))


def parse_explanations(x: Column) -> Column:
    """FN28: JSON list to structs; anything else is an empty list."""
    kind = "array<struct<feature_name:string,shap_value:double,direction:string>>"
    return F.coalesce(F.from_json(x, kind), F.array().cast(kind))


def decile_position(scores: DataFrame, share: float, score: str = "score", key: str = "entity_id") -> DataFrame:
    """SRT06: the best-scored share of rows, ties at the cut by key.

    The score at the cut is an exact order statistic. Rows above it are kept where they are; only rows tied at the cut are ranked.
    """
    rows = scores.filter(F.col(score).isNotNull())
    cut = order_statistics(rows, [], score, {"cut": f"n - greatest(1, floor({share} * n))"}).select("cut").scalar()
    marked = rows.withColumn("_cut", cut)
    above = marked.filter(F.col(score) > F.col("_cut"))
    wanted = marked.agg(F.greatest(F.lit(1), F.floor(F.lit(share) * F.count(F.lit(1)))) - F.count_if(F.col(score) > F.col("_cut"))).first()[0]
    tied = marked.filter(F.col(score) == F.col("_cut")).orderBy(key).limit(max(0, int(wanted)))
    return above.unionByName(tied).drop("_cut")


# ---- snapshots ------------------------------------------------------------------------------------------------
def save_snapshot(df: DataFrame, root: str, feature_set: str) -> None:
    """SNK07: feature rows partitioned by observation date; only touched dates are replaced."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_observation_date")
        .parquet(f"{root}/{feature_set}")
    )


def manifest(df: DataFrame, feature_set: str, entity_key: str) -> DataFrame:
    """SNK07: rows, columns and null counts of a snapshot in one aggregation."""
    nulls = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.count_if(F.col(c).isNull()))])
    return df.agg(F.count(F.lit(1)).alias("linhas"), nulls.alias("nulos")).select(
        F.lit(feature_set).alias("feature_set"), F.lit(entity_key).alias("entity_key"), "linhas",
        F.lit(len(df.columns)).alias("colunas"), "nulos",
    )


def load_snapshot(spark, root: str, feature_set: str, observation: str) -> DataFrame:
    """SRC17: one observation date, by partition pruning."""
    return spark.read.parquet(f"{root}/{feature_set}").filter(F.col("_observation_date") == F.lit(observation).cast("date"))


def load_history(spark, root: str, feature_set: str) -> DataFrame:
    """SRC18."""
    return spark.read.parquet(f"{root}/{feature_set}")


def available_dates(spark, root: str, feature_set: str) -> DataFrame:
    """SRC19: dates from the partition column alone."""
    return load_history(spark, root, feature_set).select("_observation_date").distinct().orderBy("_observation_date")
