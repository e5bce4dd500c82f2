"""Second-level summaries over view rows (small, already aggregated inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions import taxonomy as tax
from wattlake.operators.grouping import scalar_of, share_within, top_by

# Display names of severities and months.
SEVERITY_LABELS = {"critical": "Crítica", "high": "Alta", "medium": "Média", "low": "Baixa"}
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def severity_buckets(rows: DataFrame, region: str | None = None) -> DataFrame:
    """The four severities with value and share, from severity view rows, optionally for one region."""
    if region:
        rows = rows.filter(F.upper("regiao") == region.upper())
    counts = rows.groupBy(F.lower("severidade").alias("key")).agg(F.sum("qtd_erros").alias("value"))
    grid = counts.agg(F.count(F.lit(1)).alias("_k")).select(
        F.explode(F.array(*[F.lit(s) for s in tax.SEVERITY_ORDER])).alias("key")
    )
    labels = F.create_map(*[F.lit(v) for kv in SEVERITY_LABELS.items() for v in kv])
    dense = grid.join(counts, "key", "left").na.fill(0, ["value"]).withColumn("label", labels[F.col("key")])
    return share_within(dense, [], "value", "pct", 100.0)


def cause_scatter(causes: DataFrame) -> DataFrame:
    """Volume against rebill percentage, undefined and empty causes left out."""
    name = F.trim(F.coalesce("causa_canonica", F.lit("")))
    return causes.filter((name != "") & (F.lower(name) != "indefinido") & (F.col("qtd_erros") > 0)).select(
        name.alias("id"),
        F.col("qtd_erros").alias("x"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("taxa_refaturamento") * 100)).alias("y"),
    )


def subject_model_summary(
    subjects: DataFrame, coverage: DataFrame, categories: DataFrame, regions: DataFrame, region: str = "SP"
) -> DataFrame:
    """Leading subject, its share, and how much of the region the classifier evaluated."""
    total = scalar_of(regions.filter(F.col("regiao") == region), F.sum("volume_total"))
    local = coverage.filter(F.col("regiao") == region)
    evaluated = F.sum(F.when(F.col("causa_canonica_confidence").isin("high", "low"), F.col("qtd_ordens")))
    named = subjects.filter("assunto IS NOT NULL AND trim(assunto) <> ''")
    local_categories = categories.filter(F.col("regiao") == region)
    return top_by(named, 1, "qtd_ordens", "assunto").select(
        F.col("assunto").alias("subject_name"),
        F.col("qtd_ordens").alias("subject_total"),
        total.alias("total_regiao"),
        (F.col("qtd_ordens") * 100.0 / total).alias("subject_share"),
        scalar_of(local, evaluated).alias("evaluated"),
        scalar_of(local, evaluated * 100.0 / F.sum("qtd_ordens")).alias("evaluated_share"),
        F.when(scalar_of(local, F.count_if(F.col("causa_canonica_confidence") == "low")) > 0, "high_low")
        .otherwise("high").alias("confidence_note"),
        scalar_of(local_categories, F.countDistinct("categoria")).alias("categories_found"),
    )


def month_label(day):
    """FN21: Portuguese month label such as ``mar/99``."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat(F.element_at(names, F.month(day)), F.lit("/"), F.date_format(day, "yy"))


def monthly_series(monthly: DataFrame, region: str = "SP", max_months: int = 12) -> DataFrame:
    """Last months of a region with a label."""
    return (
        monthly.filter((F.col("regiao") == region) & F.col("mes_ingresso").isNotNull())
        .orderBy(F.desc("mes_ingresso"))
        .limit(max_months)
        .select(F.col("mes_ingresso").alias("iso"), month_label("mes_ingresso").alias("label"), F.col("qtd_erros").alias("total"))
    )


def weighted_invoice(rows: DataFrame) -> DataFrame:
    """Mean invoice weighted by orders; rows without weight or value are ignored."""
    kept = rows.filter("qtd_ordens > 0 AND valor_fatura_reclamada_medio > 0")
    product = F.col("qtd_ordens") * F.col("valor_fatura_reclamada_medio")
    return kept.agg(
        F.coalesce(F.try_divide(F.sum(product), F.sum("qtd_ordens")), F.lit(0.0)).alias("valor"),
        F.coalesce(F.sum("qtd_ordens"), F.lit(0)).alias("qtd_ordens"),
        F.coalesce(F.sum("qtd_instalacoes"), F.lit(0)).alias("qtd_instalacoes"),
        F.coalesce(F.sum(product), F.lit(0.0)).alias("total_reclamado"),
    )


def cause_ranking(causes: DataFrame) -> DataFrame:
    """Counts rebuilt from the valid percentage."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("proc")))
    valid = F.round(share / 100 * F.col("vol"), 0).cast("long")
    return causes.filter("vol > 0").select(
        "id", F.col("nome").alias("label"), "vol", valid.alias("procedentes"),
        F.greatest(F.col("vol") - valid, F.lit(0)).alias("improcedentes"),
        share.alias("pct_procedentes"), "reinc", F.col("cat").alias("categoria"),
    )


def outcome_split(heatmap: DataFrame, region: str = "SP", severities: tuple[str, ...] = tax.SEVERITY_ORDER) -> DataFrame:
    """Valid share weighted by volume."""
    rows = heatmap.filter((F.upper("regiao") == region) & F.col("severidade").isin(*severities) & (F.col("qtd_erros") > 0))
    valid = F.sum(F.col("qtd_erros") * F.col("taxa_refaturamento"))
    return rows.agg(
        F.coalesce(F.sum("qtd_erros"), F.lit(0)).alias("total"),
        F.coalesce(valid, F.lit(0.0)).alias("procedentes"),
        F.coalesce(F.sum("qtd_erros") - valid, F.lit(0.0)).alias("improcedentes"),
        F.coalesce(F.try_divide(valid * 100, F.sum("qtd_erros")), F.lit(0.0)).alias("pct_procedentes"),
    )


def apply_boosts(critiques: DataFrame, current: DataFrame) -> DataFrame:
    """Boost deltas summed per target, added to the current value (1.0 when new), held in 0.5..2.0."""
    deltas = (
        critiques.select(F.explode("recommended_boosts").alias("b"))
        .filter("b.card_id IS NOT NULL")
        .groupBy(F.col("b.card_id").alias("target"))
        .agg(F.sum("b.delta").alias("delta"))
    )
    joined = deltas.join(current, "target", "full_outer")
    updated = F.coalesce("boost", F.lit(1.0)) + F.col("delta")
    return joined.select(
        "target",
        F.when(F.col("delta").isNull(), F.col("boost"))
        .otherwise(F.greatest(F.lit(0.5), F.least(F.lit(2.0), updated)))
        .alias("boost"),
    )
