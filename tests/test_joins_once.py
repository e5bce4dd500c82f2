"""Joins that many readers share are made once, and narrow rows travel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlake import bindings as b
from wattlake.catalog import operation_queries as oq
from wattlake.catalog import source_queries as sq
from wattlake.sources import scans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sheets_are_joined_once(spark):
    sheets = sq._sheets(spark, SF, written=True)
    landed = scans.land_complaints(sheets)
    assert len(sheets) == 9 and "Join" not in plan(landed)
    alone = scans.land_complaints(sq._sheets(spark, SF))
    assert sorted(landed.select("ordem", "_source_hash").collect()) == sorted(alone.select("ordem", "_source_hash").collect())


def test_fact_reads_the_notes_once(spark):
    """Calendar and risk classes come from written tables, so the facts are joined for the notes alone."""
    assert plan(oq._fact(spark, SF)).count("l_shipdate") and plan(oq._fact(spark, SF)).count("explode") == 0
    assert not any(f.endswith("lineitem.parquet") for f in oq._dims(spark, SF)["risco"].inputFiles())


def test_line_texts_are_built_after_the_join(spark):
    """A line carries its texts' parts to its order only where they are asked for, and never the whole answer."""
    lines = plan(b.complaints(spark, SF)).split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    top = min(depth(x) for x in lines if "Join Inner, (ordem" in x)
    assert [x for x in lines if "AS devolutiva#" in x] and all(depth(x) < top for x in lines if "AS devolutiva#" in x)
    below = [x for x in plan(b.complaints(spark, SF).select("ordem", "flag_resolvido_com_refaturamento", "status")).split("\n") if "_rebilled" in x and "AS" in x]
    assert below and not any("p_name#" in x.split("AS _rebilled")[1] for x in below if "AS _rebilled" in x)


def test_examples_are_the_dearest_rows(spark):
    """Of a cause the dearest row with a text is shown, by order and text on ties; a cause without texts shows none."""
    from datetime import datetime

    from wattlake.plans import severity as sv

    day = datetime(2024, 1, 1)
    rows = [
        ("1", "digitacao", 5.0, " barato ", day), ("2", "digitacao", 9.0, "caro", day), ("2", "digitacao", 9.0, "ainda", day),
        ("3", "digitacao", 90.0, "  ", day), ("4", "digitacao", None, "sem valor", day), ("5", "consumo_elevado_revisao", None, " ", day),
    ]
    frame = spark.createDataFrame(rows, "ordem string, causa_canonica string, valor_fatura_reclamada_medio double, texto_completo string, data_ingresso timestamp")
    frame = frame.withColumns({"categoria": F.lit("x"), "procedente_real": F.lit(True), "regiao": F.lit("SP")})
    whole = sv.severity_scope
    sv.severity_scope = lambda f, s: f
    try:
        tree = sv.category_tree(frame)
        shown = {r.subcausa_id: r for r in tree.collect()}
    finally:
        sv.severity_scope = whole
    assert shown["digitacao"].exemplo_valor_fatura == 9.0 and shown["consumo_elevado_revisao"].exemplo_valor_fatura == 0.0
    assert "ainda" in [v for v in shown["digitacao"].asDict().values() if isinstance(v, str)]
    assert "_least" in plan(tree)
