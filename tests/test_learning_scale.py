"""Learned tables are read once and no row moves to its class."""

from __future__ import annotations

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattlake import operations as op
from wattlake import runtime
from wattlake.plans import features as ft
from wattlake.plans import models as ml
from wattlake.plans import textmodels as tm

SF = "/root/testdata/sf0.001"


@pytest.fixture
def keep(spark):
    return lambda df: runtime.materialise(spark, lambda: df, "tested", uuid.uuid4().hex)


def test_weights_do_not_move_rows(spark):
    rows = spark.range(0, 700, 1, 7).select("id", F.when(F.col("id") % 100 < 99, F.when(F.col("id") % 10 < 8, "a").otherwise("b")).alias("y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tm.balanced(rows, "y")
        assert out.rdd.getNumPartitions() == 7
        n = Counter(r.y for r in rows.collect() if r.y)
        assert {(r.y, r["_weight"]) for r in out.collect()} == {(y, sum(n.values()) / len(n) / k) for y, k in n.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tm.balanced(rows.filter("y IS NULL"), "y").count() == 0


def test_text_is_cut_once(spark, keep):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    counts = keep(ml.text_counts(docs, "text", "lang"))
    placed = ml.train_text(counts, "lang").transform(counts)
    assert placed.count() == docs.count() and not any("documents" in f for f in placed.inputFiles())
    right = placed.groupBy("lang", "prediction").count().groupBy("lang").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
    assert right > 0.9 * docs.count()


def test_topic_terms(spark, keep):
    """Sizes and term counts against the assignments; a row repeated under its key counts as one document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(50)
    docs = keep(docs.union(docs.limit(3)))
    kept = []
    assigned, taxonomy = ml.topic_model(docs, "doc_id", "text", 3, lambda df: kept.append(keep(df)) or kept[-1])
    sizes = Counter(r.topic_id for r in assigned.collect())
    assert {r.topic_id: r.registros for r in taxonomy.collect()} == sizes and sum(sizes.values()) == 53
    words = kept[0].join(assigned.distinct(), "doc_id").select("doc_id", "topic_id", F.explode("_words").alias("w")).collect()
    tf, df = Counter((r.topic_id, r.w) for r in words), {(r.topic_id, r.w): set() for r in words}
    for r in words:
        df[r.topic_id, r.w].add(r.doc_id)
    assert {(r.topic_id, r.termo): (r.tf, r.df) for r in kept[1].collect()} == {k: (tf[k], len(df[k])) for k in tf}
    assert not any("documents" in f for f in taxonomy.inputFiles())


def test_scores_read_the_rates_alone(spark, keep):
    notes, payments = op.notes(spark, SF), op.payments(spark, SF)
    columns = ["total_notas_zscore", "taxa_devolucao_zscore", "taxa_inadimplencia_zscore"]
    features = ft.anomaly_features(notes, "1998-07-31", payments, keep)
    assert not any("lineitem" in f for f in ml.anomaly_scores(features, columns).inputFiles())
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(features) == rounded(ft.anomaly_features(notes, "1998-07-31", payments))


def test_centres_are_read_by_position(spark, keep):
    """Distances against plain arithmetic; of a centre nothing is searched, and texts are cut before the vocabulary is learned."""
    rows = spark.createDataFrame(
        [(1, "a", [0, 5], [1.0, 2.0]), (2, "a", [5], [4.0]), (3, "b", [2], [1.0]), (4, "a", [], [])], "k long, g string, _ids array<int>, _weights array<double>"
    )
    found = tm.exemplars(rows, "g", "k", tm.centres(rows, "g"), 5)
    centre = {"a": {0: 1 / 3, 5: 2.0}, "b": {2: 1.0}}
    for r in found.collect():
        row = rows.filter(F.col("k") == r.k).first()
        mine = dict(zip(row["_ids"], row["_weights"], strict=True))
        assert abs(r.distancia**2 - sum((mine.get(i, 0) - c) ** 2 for i, c in centre[r.g].items())) < 1e-9
    assert "element_at(_centre" not in found._jdf.queryExecution().analyzed().toString()
    kept = []
    tm.topics(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id", "text", lambda df: kept.append(keep(df)) or kept[-1])
    assert kept[0].columns == ["doc_id", "_w"] and not any("documents" in f for f in kept[1].select("features").inputFiles())
