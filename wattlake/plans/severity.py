"""SP severity views: overview, months, categories, causes, ranking, descriptions and the category tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattlake.functions import taxonomy as tax
from wattlake.functions import text as tx
from wattlake.functions import themes as th
from wattlake.operators.grouping import (
    distinct_orders,
    scalar_of,
    title_words,
    top_by,
    top_per_group,
)
from wattlake.plans.frame import proc_flag, severity_scope

Severity = str | tuple[str, ...]


def _per_order(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per order (and key): an order is valid when any of its rows is."""
    return rows.groupBy(*keys, "ordem").agg(F.max(proc_flag()).alias("proc"))


def distribution(frame: DataFrame) -> DataFrame:
    """All four severities, absent ones as zero."""
    rows = severity_scope(frame, tax.SEVERITY_ORDER)
    counts = (
        _per_order(rows, "severidade")
        .groupBy("severidade")
        .agg(F.count(F.lit(1)).alias("qtd_erros"), F.count_if("proc").alias("procedentes"))
    )
    # Four fixed names: the grid is a literal array exploded from one aggregated row.
    grid = counts.agg(F.coalesce(F.sum("qtd_erros"), F.lit(0)).alias("_total")).select(
        "_total", F.explode(F.array(*[F.lit(s) for s in tax.SEVERITY_ORDER])).alias("severidade")
    )
    return (
        grid.join(counts, "severidade", "left")
        .na.fill(0, ["qtd_erros", "procedentes"])
        .select(
            "severidade", "qtd_erros", "procedentes",
            (F.col("qtd_erros") - F.col("procedentes")).alias("improcedentes"),
            F.coalesce(F.round(F.try_divide("qtd_erros", "_total"), 4), F.lit(0.0)).alias("pct"),
        )
    )


def overview(frame: DataFrame, severity: Severity = "high") -> DataFrame:
    """A22/WIN13: totals, valid share, repeat clients, mean invoice, categories and quarter change."""
    rows = severity_scope(frame, severity)
    orders = _per_order(rows).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.count_if("proc"), F.lit(0)).alias("procedentes")
    )
    repeat = rows.filter("instalacao_hash <> ''").groupBy("instalacao_hash").agg(distinct_orders("n")).filter("n > 1")
    by_category = rows.groupBy("categoria").agg(distinct_orders("n"))
    leading = by_category.orderBy(F.desc("n")).limit(3)
    # At most six month rows leave the ordered limit.
    months = (
        rows.filter("mes_ingresso IS NOT NULL").groupBy("mes_ingresso").agg(distinct_orders("n"))
        .orderBy(F.desc("mes_ingresso")).limit(6)
        .withColumn("r", F.row_number().over(W.orderBy(F.desc("mes_ingresso"))))
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum(F.when(F.col("r") <= 3, F.col("n"))).alias("ultimo"),
            F.sum(F.when(F.col("r") > 3, F.col("n"))).alias("anterior"),
        )
    )
    change = F.when(F.col("k") >= 6, F.try_divide(F.col("ultimo") - F.col("anterior"), F.col("anterior")))
    total = F.greatest("total", F.lit(1))
    zero = F.lit(0.0)
    return orders.select(
        "total", "procedentes", (F.col("total") - F.col("procedentes")).alias("improcedentes"),
        F.round(F.col("procedentes") / total, 4).alias("pct_procedentes"),
        scalar_of(repeat, F.count(F.lit(1))).alias("reincidentes_clientes"),
        F.coalesce(F.round(scalar_of(rows, F.avg("valor_fatura_reclamada_medio")), 2), zero).alias("valor_medio_fatura"),
        scalar_of(by_category, F.count(F.lit(1))).alias("categorias_count"),
        F.coalesce(F.round(scalar_of(leading, F.sum("n")) / total, 4), zero).alias("top3_share"),
        F.coalesce(F.round(months.select(change.alias("c")).scalar(), 4), zero).alias("delta_trimestre"),
    )


def monthly(frame: DataFrame, severity: Severity = "high") -> DataFrame:
    """Distinct orders per month; valid rows are counted per row, as the source of the numbers does."""
    return (
        severity_scope(frame, severity)
        .filter("mes_ingresso IS NOT NULL")
        .groupBy("mes_ingresso")
        .agg(distinct_orders("qtd_erros"), F.count_if(proc_flag()).alias("procedentes"))
        .select(
            F.col("mes_ingresso").cast("string").alias("mes_ingresso"), "qtd_erros", "procedentes",
            (F.col("qtd_erros") - F.col("procedentes")).alias("improcedentes"),
        )
        .orderBy("mes_ingresso")
    )


def categories(frame: DataFrame, severity: Severity = "high", limit: int = 12) -> DataFrame:
    """A24/SET02: leading categories with the tail collapsed into one row."""
    counts = severity_scope(frame, severity).groupBy("categoria").agg(distinct_orders("vol"))
    head = top_by(counts, limit, "vol", "categoria")
    rest = counts.join(head.select("categoria"), "categoria", "left_anti").agg(
        F.count(F.lit(1)).alias("k"), F.sum("vol").alias("vol")
    )
    total = F.greatest(scalar_of(counts, F.sum("vol")), F.lit(1))
    pct = F.round(F.col("vol") / total * 100, 2).alias("pct")
    ident = F.regexp_replace("categoria", r"[^a-z0-9]+", "_")
    return head.select(ident.alias("categoria_id"), "categoria", "vol", pct).unionByName(
        rest.filter("k > 0").select(
            F.lit("outros").alias("categoria_id"),
            F.concat(F.lit("Demais ("), F.col("k").cast("string"), F.lit(")")).alias("categoria"),
            "vol", pct,
        )
    )


def causes(frame: DataFrame, severity: Severity = "high", limit: int = 14) -> DataFrame:
    """Volume, valid share and repeat installations per cause with a running id."""
    rows = severity_scope(frame, severity)
    base = rows.groupBy("causa_canonica").agg(
        distinct_orders("vol"),
        F.round(F.avg(proc_flag().cast("double")) * 100, 2).alias("proc"),
        F.min("categoria").alias("cat"),
    )
    repeat = (
        rows.filter("instalacao_hash <> ''").groupBy("causa_canonica", "instalacao_hash").agg(distinct_orders("n"))
        .groupBy("causa_canonica").agg(F.count_if(F.col("n") > 1).alias("reinc"))
    )
    kept = top_by(base.join(repeat, "causa_canonica", "left"), limit, "vol", "causa_canonica")
    position = F.row_number().over(W.orderBy(F.desc("vol"), "causa_canonica"))
    return kept.select(
        F.concat(F.lit("c"), F.lpad(position.cast("string"), 2, "0")).alias("id"),
        F.col("causa_canonica").alias("nome"), "vol", "proc",
        F.coalesce("reinc", F.lit(0)).alias("reinc"), "cat",
    )


def ranking(frame: DataFrame, severity: Severity = "high", limit: int = 10) -> DataFrame:
    """A26/WIN14: repeat installations with modal attributes and the last nine monthly counts, zero-padded."""
    rows = severity_scope(frame, severity).filter("instalacao_hash <> ''")
    leading = top_by(
        rows.groupBy("instalacao_hash").agg(distinct_orders("reinc")).filter("reinc > 1"), limit, "reinc", "instalacao_hash"
    )
    kept = rows.join(leading.select("instalacao_hash"), "instalacao_hash", "left_semi")
    detail = kept.groupBy("instalacao_hash").agg(
        F.max("instalacao").alias("rotulo"),
        F.mode("categoria", True).alias("cat"),
        F.mode("causa_canonica", True).alias("causa"),
        F.avg("valor_fatura_reclamada_medio").alias("valor"),
    )
    months = kept.filter("mes_ingresso IS NOT NULL").groupBy("instalacao_hash", "mes_ingresso").agg(distinct_orders("n"))
    last = top_per_group(months, ["instalacao_hash"], [F.desc("mes_ingresso")], 9, "r")
    series = last.groupBy("instalacao_hash").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("mes_ingresso", "n"))), lambda e: e["n"].cast("int")
        ).alias("s")
    )
    padded = F.concat(F.array_repeat(F.lit(0), 9 - F.size("s")), F.col("s"))
    return leading.join(detail, "instalacao_hash").join(series, "instalacao_hash", "left").select(
        F.when(F.col("rotulo") != "", F.col("rotulo"))
        .otherwise(F.concat(F.lit("INS-"), F.upper(F.substring("instalacao_hash", 1, 7))))
        .alias("inst"),
        "cat", "causa", "reinc", F.coalesce("valor", F.lit(0.0)).alias("valor"),
        F.coalesce(padded, F.array_repeat(F.lit(0), 9)).alias("spark"), F.lit("SP/SP").alias("cidade"),
    )


def _installation_lists(rows: DataFrame, per_cause: int = 10) -> DataFrame:
    """Up to ten leading installations per cause as one nested list."""
    counts = (
        rows.filter("instalacao_hash <> ''")
        .groupBy("causa_canonica", "instalacao_hash")
        .agg(
            distinct_orders("reinc"), F.max("instalacao").alias("inst"),
            F.coalesce(F.avg("valor_fatura_reclamada_medio"), F.lit(0.0)).alias("valor"),
        )
    )
    kept = top_per_group(counts, ["causa_canonica"], [F.desc("reinc"), F.asc("instalacao_hash")], per_cause, "r")
    return kept.groupBy("causa_canonica").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("r", "inst", "reinc", "valor"))),
            lambda e: F.struct(
                e["inst"].alias("inst"), F.lit("SP").alias("cidade"), e["reinc"].alias("reinc"), e["valor"].alias("valor")
            ),
        ).alias("top_instalacoes")
    )


def _row_text() -> Column:
    """Cleaned text, topic name when it adds something, and topic keywords."""
    text = F.col("texto_completo")
    name = F.when((F.col("topic_name") != "") & (F.col("topic_name") != text), F.col("topic_name"))
    words = F.nullif(F.replace("topic_keywords", F.lit(","), F.lit(", ")), F.lit(""))
    return F.trim(F.concat_ws(" — ", F.nullif(text, F.lit("")), name, words))


def descriptions(frame: DataFrame, severity: Severity = "high", limit: int = 12) -> DataFrame:
    """Dearest orders first, one row per order, with action, owner area and the installations of the cause."""
    rows = severity_scope(frame, severity)
    work = rows.filter("texto_completo IS NOT NULL").withColumn("_text", _row_text()).filter("_text <> ''")
    sort_key = F.struct(
        (-F.coalesce("valor_fatura_reclamada_medio", F.lit(-1.0))).alias("v"),
        F.char_length("_text").alias("len"),
        F.col("_text").alias("t"),
    )
    # One representative row per order by a map-side minimum, then an ordered limit.
    picked = (
        work.groupBy("ordem")
        .agg(
            F.min_by(
                F.struct(
                    "causa_canonica", "categoria", "data_ingresso", "_text", "valor_fatura_reclamada_medio",
                    F.coalesce("flag_resolvido_com_refaturamento", F.lit(False)).alias("proc"),
                ),
                F.struct(sort_key.alias("k"), "causa_canonica"),
            ).alias("e"),
            F.min(sort_key).alias("k"),
        )
        .orderBy("k.v", "k.len", "ordem")
        .limit(limit)
    )
    return picked.join(
        _installation_lists(rows), F.col("e.causa_canonica") == F.col("causa_canonica"), "left"
    ).select(
        F.concat(F.lit("ORD-"), "ordem").alias("id"),
        title_words(F.col("e.categoria")).alias("cat"),
        F.col("e.categoria").alias("categoria_id"),
        F.col("e.causa_canonica").alias("causa"),
        F.coalesce(F.date_format("e.data_ingresso", "yyyy-MM-dd"), F.lit("")).alias("data"),
        F.col("e.proc").alias("proc"),
        F.coalesce("e.valor_fatura_reclamada_medio", F.lit(0.0)).alias("valor"),
        tx.excerpt(F.col("e._text")).alias("resumo"),
        th.suggested_action(F.col("e.causa_canonica"), F.col("e.proc")).alias("sugestao"),
        th.owner_area(F.col("e.categoria")).alias("area"),
        "top_instalacoes",
    )


def category_tree(
    frame: DataFrame, severity: Severity = tax.SEVERITY_ORDER, top_categories: int = 8, top_causes: int = 6
) -> DataFrame:
    """Leading categories, their leading causes, shares, and the dearest real example of each."""
    rows = severity_scope(frame, severity)
    totals = rows.groupBy("categoria").agg(distinct_orders("categoria_qtd"))
    overall = F.greatest(scalar_of(totals, F.sum("categoria_qtd")), F.lit(1))
    heads = top_by(totals, top_categories, "categoria_qtd", "categoria")
    dear = -F.coalesce("valor_fatura_reclamada_medio", F.lit(-1.0))
    told = F.trim(F.coalesce("texto_completo", F.lit(""))) != ""
    per_cause = rows.groupBy("categoria", "causa_canonica").agg(
        distinct_orders("qtd"), F.count_if(proc_flag()).alias("procedentes"), F.min(F.when(told, dear)).alias("_v")
    )
    kept = top_per_group(
        per_cause.join(heads, "categoria"), ["categoria"], [F.desc("qtd"), F.asc("causa_canonica")], top_causes, "r"
    )
    # Only the dearest rows of a kept cause carry their text to its group.
    dearest = kept.select(F.col("categoria").alias("_cat"), F.col("causa_canonica").alias("_cause"), F.col("_v").alias("_least"))
    same = F.col("categoria").eqNullSafe(F.col("_cat")) & F.col("causa_canonica").eqNullSafe(F.col("_cause")) & (dear == F.col("_least"))
    example = F.struct(
        dear.alias("v"), "ordem", F.trim("texto_completo").alias("t"), "data_ingresso", proc_flag().alias("proc")
    )
    found = rows.filter(told).join(dearest, same).groupBy("_cat", "_cause").agg(F.min(example).alias("x"))
    kept = kept.join(
        found, F.col("categoria").eqNullSafe(F.col("_cat")) & F.col("causa_canonica").eqNullSafe(F.col("_cause")), "left"
    )
    invalid = F.col("qtd") - F.col("procedentes")
    return kept.select(
        F.col("categoria").alias("categoria_id"),
        title_words(F.col("categoria")).alias("categoria_label"),
        "categoria_qtd",
        F.round(F.col("categoria_qtd") / overall * 100, 2).alias("categoria_pct"),
        F.col("causa_canonica").alias("subcausa_id"),
        F.col("causa_canonica").alias("subcausa_label"),
        "qtd",
        F.round(F.col("qtd") / F.greatest("categoria_qtd", F.lit(1)) * 100, 2).alias("percentual_na_categoria"),
        "procedentes",
        invalid.alias("improcedentes"),
        F.coalesce(F.concat(F.lit("ORD-"), "x.ordem"), F.lit("")).alias("exemplo_id"),
        F.coalesce(F.date_format("x.data_ingresso", "yyyy-MM-dd"), F.lit("")).alias("exemplo_data"),
        tx.excerpt(F.col("x.t")).alias("exemplo_descricao"),
        F.when(F.col("x.proc"), "procedente").when(~F.col("x.proc"), "improcedente").otherwise("").alias("exemplo_status"),
        F.coalesce(F.greatest(-F.col("x.v"), F.lit(0.0)), F.lit(0.0)).alias("exemplo_valor_fatura"),
        th.suggested_action(F.col("causa_canonica"), F.col("procedentes") > invalid).alias("recomendacao_operacional"),
    )


def tree_nodes(tree: DataFrame) -> DataFrame:
    """One node per category with its sub-causes nested, largest first."""
    return tree.groupBy("categoria_id").agg(
        F.max("categoria_label").alias("categoria_label"),
        F.max("categoria_qtd").alias("categoria_qtd"),
        F.max("categoria_pct").alias("categoria_pct"),
        F.sum("procedentes").alias("procedentes"),
        F.sum("improcedentes").alias("improcedentes"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("qtd")).alias("neg"), "subcausa_id", "qtd"))),
            lambda e: F.struct(e["subcausa_id"].alias("subcausa_id"), e["qtd"].alias("qtd")),
        ).alias("subcausas"),
    )
