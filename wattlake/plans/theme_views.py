"""CE complaint theme views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattlake.functions import rules as ru
from wattlake.functions import text as tx
from wattlake.functions import themes as th
from wattlake.operators.grouping import ordinal, scalar_of, share_within, top_by
from wattlake.plans.views import with_trend

LABELS = tuple(label for _, label, _ in th.THEMES)
BUCKETS = ("1", "2", "3-4", "5-9", "10+")


def prepare(frame: DataFrame) -> DataFrame:
    """PRJ18: CE totals with month text, theme, severity, tariff group and hashed installation."""
    rows = frame.filter("_source_region = 'CE' AND _data_type = 'reclamacao_total'")
    return (
        rows.withColumn("assunto_clean", F.upper(F.trim(F.coalesce("assunto", F.lit("(sem assunto)")))))
        .withColumn("macro_tema", th.theme_of(F.col("assunto_clean")))
        .withColumns(
            {
                "dt_ingresso": F.col("dt_ingresso").try_cast("timestamp"),
                "ano_mes": F.date_format("dt_ingresso", "yyyy-MM"),
                "macro_tema_label": th.theme_label(F.col("macro_tema")),
                "severidade": th.theme_severity(F.col("macro_tema")),
                "grupo_norm": F.coalesce(F.nullif(F.upper(F.trim("grupo")), F.lit("")), F.lit("ND")),
                "causa_raiz_clean": F.trim(F.coalesce("causa_raiz", F.lit(""))),
                "instalacao_clean": F.trim(F.coalesce("instalacao", F.lit(""))),
            }
        )
        .withColumns(
            {
                "tem_causa_raiz": F.col("causa_raiz_clean") != "",
                "instalacao_hash": tx.pseudonym(F.col("instalacao_clean")),
            }
        )
    )


def kpis(ce: DataFrame) -> DataFrame:
    """Nine measures of the CE totals."""
    per_installation = (
        ce.filter("instalacao_clean <> ''").groupBy("instalacao_hash").agg(F.count(F.lit(1)).alias("n"))
    )
    leader = top_by(ce.groupBy("macro_tema_label").agg(F.count(F.lit(1)).alias("n")), 1, "n", "macro_tema_label")
    total = F.count(F.lit(1))
    return ce.agg(
        total.alias("total_reclamacoes"),
        F.coalesce(F.avg((F.col("grupo_norm") == "GB").cast("double")), F.lit(0.0)).alias("share_grupo_b"),
        F.coalesce(F.avg(F.col("tem_causa_raiz").cast("double")), F.lit(0.0)).alias("taxa_rotulo_causa_raiz"),
        F.countDistinct("assunto_clean").alias("assuntos_distintos"),
        F.countDistinct("ano_mes").alias("meses_cobertos"),
    ).withColumns(
        {
            "unique_instalacoes": scalar_of(per_installation, F.count(F.lit(1))),
            "instalacoes_reincidentes": scalar_of(per_installation, F.count_if(F.col("n") >= 2)),
            "tema_dominante": F.coalesce(scalar_of(leader, F.max("macro_tema_label")), F.lit("—")),
            "share_tema_dominante": F.coalesce(
                scalar_of(leader, F.max("n")) / F.greatest("total_reclamacoes", F.lit(1)), F.lit(0.0)
            ),
        }
    )


def executive_table(ce: DataFrame) -> DataFrame:
    """The measures as label and text rows."""
    thousands = lambda c: F.translate(F.format_number(c, 0), ",", ".")
    percent = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
    pairs = [
        ("Volume total", thousands("total_reclamacoes")),
        ("Instalações únicas", thousands("unique_instalacoes")),
        ("Instalações reincidentes (≥2)", thousands("instalacoes_reincidentes")),
        ("% Grupo B", percent("share_grupo_b")),
        ("Cobertura de causa-raiz", percent("taxa_rotulo_causa_raiz")),
        ("Tema dominante", F.col("tema_dominante")),
        ("Share do tema dominante", percent("share_tema_dominante")),
        ("Assuntos distintos", F.col("assuntos_distintos").cast("string")),
        ("Meses cobertos", F.col("meses_cobertos").cast("string")),
    ]
    rows = F.array(*[F.struct(F.lit(label).alias("metrica"), value.alias("valor")) for label, value in pairs])
    return kpis(ce).select(F.inline(rows))


def distribution(ce: DataFrame, scale: float = 1.0) -> DataFrame:
    """Rows per theme with their share."""
    counts = ce.groupBy("macro_tema", "macro_tema_label").agg(F.count(F.lit(1)).alias("qtd"))
    return share_within(counts, [], "qtd", scale=scale).orderBy(F.desc("qtd"), "macro_tema")


def monthly_trend(ce: DataFrame) -> DataFrame:
    """The first month of a theme has no change."""
    counts = ce.groupBy("ano_mes", "macro_tema_label").agg(F.count(F.lit(1)).alias("qtd"))
    return with_trend(counts, ["macro_tema_label"], "ano_mes", "qtd", None)


def crossing(ce: DataFrame, errors: DataFrame, scale: float = 1.0) -> DataFrame:
    """A52/JN14: rows per theme whose installation also has a CE reading error.

    Complaints are first counted per (theme, installation), so the join sees one row per pair even when a single
    installation holds most complaints.
    """
    keys = errors.filter("_source_region = 'CE' AND instalacao_hash <> ''").select("instalacao_hash").distinct()
    pairs = ce.groupBy("macro_tema_label", "instalacao_hash").agg(F.count(F.lit(1)).alias("n"))
    flagged = pairs.join(keys.withColumn("hit", F.lit(True)), "instalacao_hash", "left")
    return (
        flagged.groupBy("macro_tema_label")
        .agg(
            F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("qtd_com_erro_leitura"),
            F.sum("n").alias("qtd_total"),
        )
        .withColumn("percentual", F.col("qtd_com_erro_leitura") * scale / F.col("qtd_total"))
        .orderBy(F.desc("qtd_com_erro_leitura"), "macro_tema_label")
    )


def pareto(ce: DataFrame, top_n: int = 20) -> DataFrame:
    """A54/WIN08: leading subjects with share and running share of all rows."""
    counts = top_by(
        ce.groupBy(F.col("assunto_clean").alias("assunto")).agg(F.count(F.lit(1)).alias("qtd")), top_n, "qtd", "assunto"
    )
    total = F.greatest(scalar_of(ce, F.count(F.lit(1))), F.lit(1))
    running = W.orderBy(F.desc("qtd"), "assunto").rowsBetween(W.unboundedPreceding, 0)
    # The window runs over at most top_n rows.
    return counts.withColumn("percentual", F.col("qtd") * 100.0 / total).withColumn(
        "acumulado_pct", F.sum("percentual").over(running)
    )


def cause_drill(ce: DataFrame, theme: str | None = None, top_n: int = 15) -> DataFrame:
    """Leading root causes, share of the labelled rows in scope."""
    rows = ce.filter("tem_causa_raiz")
    if theme:
        rows = rows.filter(F.col("macro_tema") == theme)
    counts = top_by(
        rows.groupBy(F.col("causa_raiz_clean").alias("causa_raiz")).agg(F.count(F.lit(1)).alias("qtd")),
        top_n, "qtd", "causa_raiz",
    )
    return counts.withColumn("percentual", F.col("qtd") * 100.0 / F.greatest(scalar_of(rows, F.count(F.lit(1))), F.lit(1)))


def heatmap(ce: DataFrame) -> DataFrame:
    """A56/SRT03: months by theme; the themes are the fixed pivot values, so the schema is fixed."""
    counts = ce.groupBy("ano_mes", "macro_tema").agg(F.count("ordem").alias("n"))
    return (
        counts.groupBy("ano_mes").pivot("macro_tema", [t for t, _, _ in th.THEMES]).agg(F.sum("n")).na.fill(0)
        .orderBy("ano_mes")
    )


def repeat_installations(ce: DataFrame, top_n: int = 20) -> DataFrame:
    """A57."""
    return top_by(
        ce.filter("instalacao_clean <> ''").groupBy("instalacao_hash").agg(
            F.count("ordem").alias("qtd_reclamacoes"),
            F.size(F.collect_set("macro_tema")).cast("long").alias("temas_distintos"),
            F.max("dt_ingresso").alias("ultimo_ingresso"),
        ),
        top_n, "qtd_reclamacoes", "instalacao_hash",
    )


def group_radar(ce: DataFrame) -> DataFrame:
    """Theme share per tariff group with every theme present."""
    counts = ce.groupBy(F.col("grupo_norm").alias("grupo"), "macro_tema_label").agg(F.count(F.lit(1)).alias("qtd"))
    grid = counts.select("grupo").distinct().select(
        "grupo", F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("macro_tema_label")
    )
    dense = grid.join(counts, ["grupo", "macro_tema_label"], "left").na.fill(0, ["qtd"])
    return share_within(dense, ["grupo"], "qtd", scale=100.0)


def reincidence(ce: DataFrame) -> DataFrame:
    """Installations per bucket, every bucket present."""
    counts = (
        ce.filter("instalacao_clean <> ''").groupBy("instalacao_hash").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(ru.reincidence_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("instalacoes"))
    )
    grid = counts.agg(F.count(F.lit(1)).alias("_k")).select(
        F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket")
    )
    return grid.join(counts, "bucket", "left").na.fill(0, ["instalacoes"]).orderBy(ordinal("bucket", BUCKETS))
