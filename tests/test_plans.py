"""Frame, views, features, quality and sinks on small literal frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattlake import runtime
from wattlake.operators import dedup, quantiles, runs, upsert
from wattlake.plans import evaluation as ev
from wattlake.plans import features as ft
from wattlake.plans import frame as fr
from wattlake.plans import quality, registry, retrieval, theme_views, views
from wattlake.sources import generators, scans, sinks
from wattlake.sources.contracts import Column, Contract

SILVER = "ordem string, _source_region string, _data_type string, dt_ingresso string, causa_raiz string, texto_completo string, instalacao string, assunto string, flag_resolvido_com_refaturamento string"


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("1", "SP", "base_n1_sp", "2026-01-03", "digitacao", "erro", "10", "A", "true"),
        ("2", "SP", "base_n1_sp", "2026-02-03", "digitacao", "erro", "10", "A", "false"),
        ("3", "CE", "erro_leitura", "2026-02-10", None, "medidor com defeito", "11", "B", "nao"),
        ("4", "CE", "reclamacao_total", "2026-02-11", None, "x", "11", "CORTE", "sim"),
        ("5", None, "erro_leitura", "bad", None, "", None, None, None),
    ]
    return fr.prepare_frame(spark.createDataFrame(rows, SILVER), include_total=True)


def test_frame_resolution(frame):
    got = {r["ordem"]: r for r in frame.collect()}
    assert got["1"]["causa_canonica"] == "digitacao" and got["1"]["causa_canonica_confidence"] == "high"
    assert got["3"]["causa_canonica"] == "medidor_danificado"
    assert got["4"]["causa_canonica"] == "reclamacao_total_sem_causa" and got["4"]["flag_resolvido_com_refaturamento"]
    assert got["5"]["data_ingresso"] is None and got["5"]["regiao"] == "NAO_INFORMADA" and got["5"]["instalacao_hash"] == ""
    assert got["1"]["topic_name"] == "sem_topico"


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        fr.prepare_frame(spark.createDataFrame([("1",)], "ordem string"))


def test_registry(frame):
    assert len(registry.VIEWS) == 68
    with pytest.raises(KeyError):
        registry.get_view("nope")
    rows = {r["regiao"]: r["qtd_ordens"] for r in registry.aggregate(frame, "by_region").collect()}
    assert rows == {"SP": 2, "CE": 1}
    only = registry.aggregate(frame, "by_region", {"regiao": "SP", "start_date": "2026-02-01"}).collect()
    assert [(r["regiao"], r["qtd_ordens"]) for r in only] == [("SP", 1)]


def test_views_on_an_empty_frame(frame):
    empty = frame.limit(0)
    for view_id in ("kpis", "top_assuntos", "mis_executive_summary", "sp_severidade_alta_overview", "sp_severidade_distribution", "ce_macro_distribution"):
        registry.aggregate(empty, view_id).collect()


def test_shares_sum_to_one(frame):
    total = views.root_cause_distribution(frame).agg(F.sum("percentual")).first()[0]
    assert total == pytest.approx(1.0)


def test_theme_crossing(frame):
    rows = theme_views.crossing(theme_views.prepare(frame), frame.filter("_data_type <> 'reclamacao_total'")).collect()
    assert [(r["macro_tema_label"], r["qtd_com_erro_leitura"], r["qtd_total"]) for r in rows] == [("Religação & Multas", 1, 1)]


def test_run_lengths_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, i, i // 5, rng.random() < 0.7) for k in (1, 2, 3) for i in range(40)] + [(4, i, i // 3, True) for i in range(25)]
    df = spark.createDataFrame(rows, "k int, i int, s int, f boolean")
    got = {(r["k"], r["i"]): r["run_length"] for r in runs.run_lengths(df, "k", [F.col("i")], F.col("f"), F.col("s")).collect()}
    length, last = 0, None
    for k, i, _, f in rows:
        length = 0 if k != last else length
        length, last = (length + 1 if f else 0), k
        assert got[(k, i)] == length


def test_order_statistics_against_sorting(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.choice([0, 1, 1, 1, rng.randint(0, 5000)]))) for g in ("a", "b") for _ in range(3000)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    low = {r["g"]: r for r in quantiles.lower_percentiles(df, ["g"], "v", {"p95": 0.95, "p0": 0.0, "p100": 1.0}).collect()}
    mid = {r["g"]: r for r in quantiles.linear_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in ("a", "b", "c"):
        v = sorted(x for k, x in rows if k == g)
        assert low[g]["p95"] == v[int(0.95 * (len(v) - 1))] and low[g]["p0"] == v[0] and low[g]["p100"] == v[-1]
        at = 0.95 * (len(v) - 1)
        want = v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
        assert mid[g]["p95"] == pytest.approx(want)


def test_dedup_and_upsert(spark):
    df = spark.createDataFrame([("001", 1, "a"), ("001", 2, "b"), ("002", 1, "c")], "k string, o int, v string")
    assert sorted((r["k"], r["v"]) for r in dedup.latest_wins(df, ["k"], [F.col("o")]).collect()) == [("001", "b"), ("002", "c")]
    new = spark.createDataFrame([("002", 9, "z"), ("003", 1, "n")], "k string, o int, v string")
    merged = upsert.merge(df, new, ["k"])
    assert sorted(r["v"] for r in merged.collect()) == ["a", "b", "n", "z"]
    assert sorted(r["v"] for r in upsert.merge_latest(df.filter("o = 1"), new, ["k"]).collect()) == ["a", "n", "z"]


def test_point_in_time_features(spark):
    day = dt.date(2026, 2, 1)
    rows = [(i, 501 + i % 2, 7, 4000, day + dt.timedelta(days=i), day + dt.timedelta(days=i + 3), None, "DEVOLVIDA" if i % 2 else "EXECUTADA", "1") for i in range(10)]
    rows.append((999, 501, 7, 4000, dt.date(2026, 5, 1), dt.date(2026, 5, 4), None, "EXECUTADA", None))
    notes = spark.createDataFrame(
        rows, "cod_nota int, cod_uc int, cod_base int, cod_colaborador int, data_criacao date, data_prevista date, data_execucao date, status string, historico_incidentes_12m string"
    )
    out = ft.delay_features(notes, "2026-03-01").collect()
    assert len(out) == 10 and all(r["cod_nota"] != 999 for r in out)
    assert {r["qtd_notas_uc_90d"] for r in out} == {5.0}


def test_drift_flags_a_shift(spark):
    ref = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    same = {r["feature_name"]: r["status"] for r in ft.drift(ref, ref, ["x", "y"]).collect()}
    moved = {r["feature_name"]: r["status"] for r in ft.drift(ref, ref.withColumn("x", F.col("x") + 400), ["x", "y"]).collect()}
    assert same == {"x": "STABLE", "y": "STABLE"} and moved["x"] in ("WARNING", "CRITICAL") and moved["y"] == "STABLE"


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "c")], "k int, v string")
    suite = (quality.Expectation("unique", "k"), quality.Expectation("not_null", "v"), quality.Expectation("row_count", options={"greater_than": 2}))
    got = {r["expectation"]: (r["failures"], r["success"]) for r in quality.evaluate(df, "t", suite).collect()}
    assert got == {"unique:k": (1, False), "not_null:v": (1, False), "row_count": (0, True)}
    recon = quality.reconcile(df, df.limit(2), "bronze_to_silver", "t").first()
    assert recon["status"] == "FAIL" and recon["delta_count"] == 1


def test_evaluation_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["B", "x"], "ok [fonte: docs/b.md]", ["docs/b.md"])], "r array<string>, e array<string>, a string, s array<string>")
    row = df.select(
        ev.recall_at(F.col("r"), F.col("e"), 5), ev.mrr(F.col("r"), F.col("e")), ev.ndcg_at(F.col("r"), F.col("e"), 10),
        ev.citation_accuracy(F.col("a"), F.col("s")), ev.refused(F.lit("Não encontrei essa informação")),
    ).first()
    assert row[0] == 0.5 and row[1] == 0.5 and row[2] == pytest.approx(0.3869, abs=1e-3) and row[3] == 1.0 and row[4]


def test_cosine_blocks_do_not_change_the_result(spark):
    rng = random.Random(1)
    vec = lambda n: [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(n)]
    q, c = spark.createDataFrame(vec(6), "q int, v array<double>"), spark.createDataFrame(vec(60), "c int, w array<double>")
    fast = retrieval.cosine_topk(q, c, "q", "c", "v", "w", 4).collect()
    slow = retrieval.cosine_topk(q, c, "q", "c", "v", "w", 4, block=2, part=7).collect()
    key = lambda rows: sorted((r["q"], r["rank"], r["c"], round(r["cosseno"], 8)) for r in rows)
    assert key(fast) == key(slow) and len(fast) == 24


def test_known_questions(spark):
    seeds = spark.createDataFrame([(1, "Quais as principais causas em SP?"), (2, "Como ler a fatura?")], "seed_id int, question string")
    qs = spark.createDataFrame([("x", "quais as principais causas em sp"), ("y", "Quais as principais causa em SP?"), ("z", "outra coisa")], "question_id string, question string")
    got = {r["question_id"]: (r["seed_id"], round(r["ratio"], 2)) for r in retrieval.known_questions(qs, seeds).collect()}
    assert got["x"] == (1, 1.0) and got["y"][0] == 1 and "z" not in got


def test_ingest_and_scan(spark, tmp_path):
    contract = Contract(
        "pagamentos", (Column("cod", "bigint", False, source_name="COD"), Column("quando", "timestamp", format="dd/MM/yyyy HH:mm:ss")),
        strategy="incremental", watermark_column="quando",
    )
    (tmp_path / "in.csv").write_text("COD;quando\n1;01/02/2026 10:00:00\n2;03/02/2026 10:00:00\n", encoding="utf-8")
    rows = scans.scan_delimited(spark, contract, str(tmp_path / "in.csv"))
    result = sinks.ingest(spark, contract, rows, f"{tmp_path}/bronze", f"{tmp_path}/audit", "dd/MM/yyyy HH:mm:ss")
    assert result["rows"] == 2 and result["watermark"] == dt.datetime(2026, 2, 3, 10)
    last = scans.last_watermark(spark.read.parquet(f"{tmp_path}/audit"), "pagamentos")
    assert scans.newer_than(rows, "quando", "dd/MM/yyyy HH:mm:ss", last).count() == 0
    assert scans.newer_than(rows, "quando", "dd/MM/yyyy HH:mm:ss", None).count() == 2
    with pytest.raises(ValueError):
        contract.check_columns(rows.drop("cod"))
    assert "PARTITIONED BY (_partition_date)" in contract.bronze_ddl()


def test_partition_overwrite_and_rewrite(spark, tmp_path):
    df = spark.createDataFrame([("2026-01", 1), ("2026-02", 2)], "mes_referencia string, v int")
    sinks.overwrite_months(df, f"{tmp_path}/m")
    sinks.overwrite_months(df.filter("v = 2").withColumn("v", F.lit(5)), f"{tmp_path}/m")
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [1, 5]
    sinks.rewrite(spark, df, f"{tmp_path}/t")
    sinks.rewrite(spark, upsert.merge(sinks.read_current(spark, f"{tmp_path}/t"), df.limit(1), ["mes_referencia"]), f"{tmp_path}/t")
    assert sinks.read_current(spark, f"{tmp_path}/t").count() == 2
    sinks.export(sinks.domain_rows(df, "metas", "2026-02"), f"{tmp_path}/x", "parquet")
    assert spark.read.parquet(f"{tmp_path}/x").count() == 1
    assert sum(len(b) for b in sinks.stream_rows(df, 1)) == 2


def test_json_lines_and_generators(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"question_hash":"a","latency_total_ms":5}\nnot json\n', encoding="utf-8")
    assert scans.read_json_lines(spark, str(tmp_path / "t.jsonl"), "question_hash string, latency_total_ms double").count() == 1
    assert scans.read_optional(spark, str(tmp_path / "absent"), "a int").count() == 0
    assert generators.service_orders(spark, 50).count() == 50 and generators.payments(spark, 20).filter("valor_pago = ''").count() == 4


def test_materialise_once(spark):
    calls = []
    build = lambda: calls.append(1) or spark.range(3).toDF("a")
    assert runtime.materialise(spark, build, "t", "v1").count() == 3
    assert runtime.materialise(spark, build, "t", "v1").count() == 3
    assert len(calls) == 1


def test_fallback_labels_learn_from_classified_rows(spark):
    from wattlake.plans import fallback

    rows = [(i, "digitacao errada do leiturista", "digitacao") for i in range(40)] + [(i, "medidor danificado quebrado", "medidor") for i in range(40, 70)]
    rows += [(100, "medidor quebrado ontem", "indefinido"), (101, "leiturista errada", "indefinido"), (102, None, "indefinido"), (103, "", "indefinido")]
    df = spark.createDataFrame(rows, "k long, t string, c string")
    got = fallback.fallback_labels(df, "k", "t", "c", "indefinido")
    by_key = {r.k: r for r in got.collect()}
    assert len(by_key) == len(rows) and by_key[100].rotulo == "medidor" and by_key[101].rotulo == "digitacao"
    assert by_key[102].rotulo == by_key[103].rotulo == "digitacao"  # no word: the commonest class
    assert all(0 < r.confianca <= 1 for r in by_key.values()) and by_key[0].confianca == 1.0
    report = fallback.coverage(got, "indefinido").first()
    assert report.indefinidos_antes == 4 and report.indefinidos_depois == 0 and report.conferidos == report.concordantes > 0
    none = fallback.fallback_labels(df.filter("c = 'indefinido'"), "k", "t", "c", "indefinido").collect()
    assert {r.rotulo for r in none} == {"indefinido"}
