"""View rows rendered as text cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions.questions import count_text, money_text, percent_text
from wattlake.plans import theme_views as tv
from wattlake.plans import views as vw
from wattlake.plans.frame import training_only


def card(rows: DataFrame, anchor: str, title: str, region: str, line: Column, order: Column) -> DataFrame:
    """One card from a short view: its rows become numbered lines in view order."""
    ranked = rows.select(F.struct(order.alias("o"), line.alias("t")).alias("e"))
    lines = F.transform(F.array_sort(F.collect_list("e")), lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["t"]))
    return ranked.agg(F.concat_ws("\n", lines).alias("body")).select(
        F.lit(anchor).alias("anchor"), F.lit(title).alias("title"), "body", F.lit(region).alias("region")
    )


def _ranking(rows: DataFrame, key: str, count: str, anchor: str, title: str, region: str) -> DataFrame:
    text = F.concat(F.coalesce(key, F.lit("(sem valor)")), F.lit(": "), count_text(F.col(count)), F.lit(" ordens ("), percent_text(F.col("percentual") * 100), F.lit(")"))
    return card(rows, anchor, title, region, text, F.struct((-F.col(count)).alias("n"), F.coalesce(key, F.lit("~")).alias("k")))


def view_cards(frame: DataFrame, scope: str = "CE+SP") -> DataFrame:
    """Cards of the general, SP and CE views; ``scope`` keeps the cards of one region."""
    base = training_only(frame)
    cards = [
        card(
            vw.by_region(base), "visao-regional", "Visão por regional", "CE+SP",
            F.concat("regiao", F.lit(": "), count_text(F.col("qtd_ordens")), F.lit(" ordens, refaturamento "), percent_text(F.col("taxa_refaturamento") * 100)),
            F.col("regiao"),
        ),
        card(
            vw.seasonality(base), "sazonalidade-ce-sp", "Sazonalidade", "CE+SP",
            F.concat("regiao", F.lit(": pico em "), "mes_pico", F.lit(" com "), count_text(F.col("qtd_pico"))), F.col("regiao"),
        ),
        card(
            vw.coverage_window(base), "cobertura", "Janela de cobertura", "CE+SP",
            F.concat("regiao", F.lit(": "), F.col("inicio").cast("string"), F.lit(" a "), F.col("fim").cast("string")), F.col("regiao"),
        ),
        card(
            vw.sp_invoice_by_meter(base), "sp-fatura-medidor", "Fatura por tipo de medidor", "SP",
            F.concat("tipo_medidor_dominante", F.lit(": "), money_text(F.col("valor_fatura_reclamada_medio"))), F.col("tipo_medidor_dominante"),
        ),
    ]
    for region in ("CE", "SP"):
        local = base.filter(F.col("regiao") == region)
        low = region.lower()
        cards.append(_ranking(vw.top_subjects(local), "assunto", "qtd_ordens", f"{low}-assuntos", f"Assuntos {region}", region))
        cards.append(_ranking(vw.top_causes(local), "causa_canonica", "qtd_ordens", f"{low}-causas", f"Causas {region}", region))
    cards.append(
        card(
            tv.distribution(tv.prepare(frame)), "ce-temas", "Temas CE", "CE",
            F.concat("macro_tema_label", F.lit(": "), percent_text(F.col("percentual") * 100)), F.struct((-F.col("qtd")).alias("n"), "macro_tema"),
        )
    )
    out = cards[0]
    for c in cards[1:]:
        out = out.unionByName(c)
    return out if scope == "CE+SP" else out.filter(F.col("region") == scope)
