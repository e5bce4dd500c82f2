"""Range finder against numpy, folds and F1 against DuckDB, topics and exemplars over their assignments."""

from __future__ import annotations

import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlake import runtime
from wattlake.plans import textmodels as tm

SF = "/root/testdata/sf0.001"


def keeper(spark):
    return lambda df: runtime.materialise(spark, lambda: df, "tested", uuid.uuid4().hex)


def test_range_finder_finds_the_singular_vectors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text")
    termed = tm.with_terms(docs, "text")
    vocabulary = tm.Vocabulary.learn(termed, 500)
    sparse = keeper(spark)(tm.entries(vocabulary.vectors(termed)).select("doc_id", "_ids", "_weights"))
    rows = sparse.collect()
    matrix = np.zeros((len(rows), 500))
    for k, r in enumerate(rows):
        matrix[k, r["_ids"]] = r["_weights"]
    assert np.allclose(np.linalg.norm(matrix, axis=1), 1)
    left, values, right = np.linalg.svd(matrix, full_matrices=False)
    directions, found = tm.singular_directions(sparse, 500, len(rows), 6, spare=20, rounds=5)
    assert np.allclose(found, values[:6], rtol=1e-3)
    assert np.allclose(np.abs((directions * right[:6].T).sum(axis=0))[:2], 1, atol=1e-3)
    placed = {r["doc_id"]: np.array(r["embedding"]) for r in tm.project(sparse, directions, ["doc_id"]).collect()}
    wanted = matrix @ directions
    wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
    assert all(np.allclose(placed[r["doc_id"]], wanted[k]) for k, r in enumerate(rows))


def test_vectors_follow_the_formula_and_bear_nulls(spark):
    rows = spark.createDataFrame([(1, "um dois dois"), (2, None), (3, ""), (4, "dois tres"), (4, "dois tres")], "k int, t string")
    termed = tm.with_terms(rows, "t")
    vocabulary = tm.Vocabulary.learn(termed, 100)
    assert vocabulary.terms[0] == "dois" and set(vocabulary.terms) == {"um", "dois", "tres", "um dois", "dois dois", "dois tres"}
    assert vocabulary.idf[0] == pytest.approx(np.log(6 / 4) + 1)
    sparse = keeper(spark)(tm.entries(vocabulary.vectors(termed)))
    assert [len(r["_ids"]) for r in sparse.orderBy("k").collect()] == [4, 0, 0, 3, 3]
    directions, _ = tm.singular_directions(sparse, 6, 5, 2)
    placed = tm.project(sparse, directions, ["k"]).orderBy("k").collect()
    assert placed[1]["embedding"] == [0.0, 0.0] and np.linalg.norm(placed[3]["embedding"]) == pytest.approx(1)
    empty = tm.with_terms(rows.limit(0), "t")
    none = tm.Vocabulary.learn(empty, 100)
    assert none.terms == [] and none.vectors(empty).count() == 0


def test_folds_and_f1_against_sql(spark):
    rows = spark.range(400).select(
        "id", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 37 as int))").alias("d"),
        F.concat(F.lit("c"), F.col("id") % 5).alias("y"), F.concat(F.lit("c"), F.col("id") % 7).alias("p"))
    folded = tm.expanding_folds(rows, "d")
    data = folded.toPandas()
    con = duckdb.connect()
    con.register("data", data)
    wrong = con.execute("""WITH o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r FROM data), c AS (SELECT d AS cut FROM o WHERE r IN (100, 200, 300))
SELECT count(*) FROM data WHERE fold <> (SELECT count(*) FROM c WHERE cut <= data.d)""").fetchone()[0]
    assert wrong == 0 and set(data["fold"]) == {0, 1, 2, 3}
    sizes = {r["fold"]: (r["treino"], r["teste"]) for r in tm.fold_sizes(folded, "y").collect()}
    assert sizes[3][0] + sizes[3][1] == 400 and all(sizes[k][0] == sum(data["fold"] < k) for k in sizes)
    got = tm.macro_f1(folded, [], "y", "p").first()
    want = con.execute("""WITH c AS (SELECT y AS c FROM data UNION SELECT p FROM data)
SELECT avg((SELECT 2.0 * count(*) FILTER (y = c AND p = c) / (count(*) FILTER (y = c) + count(*) FILTER (p = c)) FROM data)), count(*) FROM c""").fetchone()
    assert got["macro_f1"] == pytest.approx(want[0]) and got["classes"] == want[1] == 7


def test_classifier_learns_from_earlier_folds_only(spark):
    words = {0: "leitura errada do medidor", 1: "fatura vencida sem entrega", 2: "corte indevido de energia"}
    rows = spark.createDataFrame([(i, words[i % 3] + f" caso{i}" if i else "nada disso", f"2024-01-{1 + i // 4:02d}", "so antes" if i == 0 else f"k{i % 3}") for i in range(80)], "id int, t string, d string, y string")
    placed = tm.text_embeddings(rows, "t", ["id", "d", "y"], keeper(spark), 8)
    folded = keeper(spark)(tm.expanding_folds(placed, "d"))
    scores = {r["fold"]: r["macro_f1"] for r in tm.fold_scores(folded, "y").collect()}
    assert len(scores) == 3 and all(s > 0.95 for s in scores.values())
    alone = tm.TextClassifier.fit(folded.filter("y = 'k1'"), "y").predict(folded).select("classe").distinct().collect()
    assert [r["classe"] for r in alone] == ["k1"]
    assert tm.fold_predictions(folded.limit(0), "y").count() == 0


def test_topics_follow_the_size_rule_and_examples_are_nearest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assigned, taxonomy = tm.topics(docs, "doc_id", "text", keeper(spark))
    place, found = assigned.toPandas(), taxonomy.toPandas().set_index("topic_id")
    assert len(place) == docs.count() and len(found) == tm.topic_count(len(place))
    con = duckdb.connect()
    con.register("place", place)
    assert dict(con.execute("SELECT topic_id, count(*) FROM place GROUP BY 1").fetchall()) == found["topic_size"].to_dict()
    assert (found["keywords"].map(len) <= 5).all() and (found["examples"].map(len) == np.minimum(found["topic_size"], 3)).all()
    assert [tm.topic_count(n) for n in (0, 1, 19, 40, 159, 1000)] == [1, 1, 1, 2, 7, 8]


def test_exemplars_against_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((200, 6))
    points[points < 0.4] = 0
    rows = spark.createDataFrame([(k, int(k % 7 == 0), np.flatnonzero(p).tolist(), p[p != 0].tolist()) for k, p in enumerate(points)], "k int, g int, _ids array<int>, _weights array<double>")
    found = tm.exemplars(rows, "g", "k", tm.centres(rows, "g"), 3).collect()
    for g in (0, 1):
        members = [k for k in range(200) if int(k % 7 == 0) == g]
        away = np.linalg.norm(points[members] - points[members].mean(axis=0), axis=1)
        best = [members[i] for i in np.lexsort((members, away))[:3]]
        assert [r["k"] for r in sorted(found, key=lambda r: r["rank"]) if r["g"] == g] == best


def test_pair_metrics_equal_the_list_metrics(spark):
    from wattlake.plans import evaluation as ev

    rng = np.random.default_rng(2)
    lists = {k: [f"s{x}" for x in rng.permutation(30)[: rng.integers(1, 15)]] for k in range(40)}
    wanted = {k: [f"s{x}" for x in rng.permutation(30)[: rng.integers(0, 14)]] for k in range(40)}
    cases = spark.createDataFrame([(k, lists[k], wanted[k]) for k in lists], "k int, retrieved array<string>, expected array<string>")
    ranked = spark.createDataFrame([(k, s, i + 1) for k in lists for i, s in enumerate(lists[k])], "k int, s string, posicao int")
    pairs = spark.createDataFrame([(k, s) for k in wanted for s in wanted[k] + wanted[k][:1]], "k int, s string")
    got = {r["k"]: (r["esperados"], r["recall_5"], r["mrr_10"], r["ndcg_10"]) for r in ev.pair_metrics(ranked, pairs, "k", "s").collect()}
    ten = F.slice("retrieved", 1, 10)
    want = cases.select("k", F.size("expected"), F.round(ev.recall_at(F.col("retrieved"), F.col("expected"), 5), 4), F.round(ev.mrr(ten, F.col("expected")), 4),
                        F.round(ev.ndcg_at(F.col("retrieved"), F.col("expected"), 10), 4)).collect()
    assert all(got[r[0]] == pytest.approx(tuple(r[1:]), abs=2e-4) for r in want) and len(got) == 40
