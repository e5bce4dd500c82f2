"""Frames that hold only the parts a reader asks for."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wattlake import bindings as b
from wattlake import runtime
from wattlake.plans import frame as fr
from wattlake.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_reader_names_the_parts_it_reads(spark, monkeypatch):
    from wattlake.catalog import load

    whole = b.build_frame(spark, SF, parts=(*fr.WHOLE, "digest"))
    asked = []

    def frame(_spark, _sf, parts=fr.WHOLE):
        asked.append(parts)
        return whole.select(*fr.columns_of(parts)).limit(0)

    monkeypatch.setattr(b, "frame", frame)
    queries = load()[0]
    missing = {}
    for name in registry._PARTS:
        asked.clear()
        try:
            queries[name](spark, SF)
        except AnalysisException as e:  # a column of a part that is not named does not resolve
            missing[name] = str(e)[:160]
        assert asked and all(p == registry.parts_of(name) for p in asked), name
    assert not missing


def test_views_by_group_read_no_text_profile_or_outcome(spark):
    plan = _plan(b.build_frame(spark, SF, parts=registry.parts_of("by_group")))
    for column in ("text#", "p_type#", "l_extendedprice#", "quality#", "vec_id#"):
        assert column not in plan, column


@pytest.mark.parametrize("parts", [(), ("cause",), ("topic",), ("cause", "outcome", "digest"), ("meter", "invoice")])
def test_a_part_frame_has_the_rows_of_the_whole_one(spark, parts):
    columns = fr.columns_of(parts)
    whole = b.build_frame(spark, SF, parts=(*fr.WHOLE, "digest"))
    assert whole.columns == [*fr.FRAME_COLUMNS, "texto_md5"]
    some = b.build_frame(spark, SF, parts=parts)
    assert some.columns == columns
    digest = lambda df: df.select(F.xxhash64(*columns).alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    assert digest(some) == digest(whole)


def test_digest_stands_for_the_text(spark):
    frame = b.build_frame(spark, SF, parts=("text", "digest"))
    assert frame.filter(F.md5("texto_completo") != F.col("texto_md5")).isEmpty()


def test_unknown_part():
    with pytest.raises(ValueError):
        fr.columns_of(("colour",))


def test_a_written_frame_with_more_parts_serves_fewer(spark, monkeypatch):
    monkeypatch.setattr(b, "_WRITTEN", {})
    monkeypatch.setattr(runtime, "_TABLES", {})
    b.frame(spark, SF, ("topic",))
    b.frame(spark, SF, ())
    assert len(runtime._TABLES) == 1
    b.frame(spark, SF, ("outcome",))
    assert len(runtime._TABLES) == 2


def test_topics_with_many_untopiced_rows(spark):
    silver = spark.createDataFrame(
        [(str(i), "SP", "erro_leitura" if i % 2 else "reclamacao_total", "2026-01-03", None, "zz") for i in range(6)],
        "ordem string, _source_region string, _data_type string, dt_ingresso string, causa_raiz string, texto_completo string",
    )
    topics = spark.createDataFrame([("1", 7), ("2", 7), ("3", 8)], "ordem string, topic_id int")
    names = spark.createDataFrame([(7, "a", ["x", "y"]), (8, "b", ["z"])], "topic_id int, topic_name string, keywords array<string>")
    causes = spark.createDataFrame([(7, "digitacao", None)], "topic_id int, canonical_target string, confidence string")
    frame = fr.prepare_frame(silver, topic_assignments=topics, topic_taxonomy=names, topic_causes=causes, include_total=True)
    got = {r["ordem"]: (r["topic_id"], r["topic_name"], r["topic_keywords"]) for r in frame.collect()}
    assert got["1"] == ("7", "a", "x, y") and got["3"] == ("8", "b", "z")
    assert got["2"] == got["5"] == (None, "sem_topico", "")  # totals have no topic
    causa = {r["ordem"]: r["causa_canonica"] for r in frame.collect()}
    assert causa["1"] in ("digitacao", "texto_incompleto") and causa["2"] == "reclamacao_total_sem_causa"


def test_meter_profiles_meet_orders_and_no_text_is_dealt_by_installation(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(b.build_frame(spark, SF, parts=registry.parts_of("wide_frame")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(instalacao#" in line]
    assert dealt
    # The rows of the frame, named by their last join, stay dealt by order.
    tops = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert "[ordem#" in tops[0]


def test_meters_joined_to_rows_or_to_orders_give_the_same_frame(spark):
    from wattlake.plans import profiles

    profile = profiles.meter_profile(b.meters(spark, SF))
    columns = ["ordem", "linha", "instalacao", *profiles.METER_COLUMNS, "perfil_medidor_disponivel"]
    late = profiles.enrich(b.complaints(spark, SF), profile, None, clean_keys=True).select(*columns)
    early = profiles.enrich(b.complaints(spark, SF, profile), None, None, clean_keys=True).select(*columns)
    assert early.count() == late.count() > 0
    assert early.exceptAll(late).isEmpty()
    assert early.filter("perfil_medidor_disponivel").count() > 0
