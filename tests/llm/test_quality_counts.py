"""The sharded language model against the one in the driver, and its growth with the trusted text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wattlake.llm import quality


def test_sharded_model(spark):
    rng = random.Random(2)
    texts = [("x", " ".join("".join(rng.choices("abcde", k=4)) for _ in range(80))) for _ in range(4)] + [("y", "dad had a bad cab " * 9)]
    sample = spark.createDataFrame(texts, "lang string, text string")
    model = quality.kneser_ney(sample, 2)
    known, gammas = quality.sharded(sample, 2)
    rows = [(1, "x", "abcd zq dead"), (2, "y", "dad had"), (3, "z", "bad cab dad"), (4, "x", "12"), (5, "y", "dad had"), (6, None, None)]
    got = {r.doc_id: r.perplexity for r in quality.perplexities(spark.createDataFrame(rows, "doc_id long, lang string, text string"), known, gammas).collect()}
    bits = lambda t: model.code_lengths([b"\n\n" + t])[0] - model.code_lengths([b"\n\n"])[0]
    want = {1: bits(rows[0][2].encode())[0] / 12, 2: bits(b"dad had")[1] / 7, 3: bits(b"bad cab dad").min() / 11}
    for k, w in want.items():
        assert got[k] == pytest.approx(2**w, rel=1e-4)
    assert got[5] == pytest.approx(got[2]) and got[4] is None and got[6] is None


def test_all_trusted_text_counts(spark, monkeypatch):
    """Every trusted document of the learning half is counted, however many there are and however long."""
    docs = spark.range(1, 1_201).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.when(F.col("id") == 1_200, F.repeat(F.lit("long text "), 7_000)).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    seen, build = [], quality.sharded
    monkeypatch.setattr(quality, "sharded", lambda sample, order: (seen.append(sample.agg(F.count("text"), F.sum(F.octet_length("text"))).first()), build(sample, order))[1])
    quality.quality(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count()
    half = docs.filter(quality.trusted_half()).agg(F.count("text"), F.sum(F.octet_length("text"))).first()
    assert seen[0] == half and half[0] > 400


def test_grams_travel_once_a_lot(spark):
    """Texts that share grams cost their lot one row a gram, and neither the size of a lot nor repeats change a perplexity."""
    texts = [(i, "x" if i % 3 else None, f"the same words again and again {i % 5} {'more ' * (i % 7)}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, own string, text string").withColumn("langs", F.array(F.lit("x"))).coalesce(1)
    distinct = len({g for t in texts for g in quality.byte_grams(t[2].encode(), 2).tolist()})
    lots = quality.text_lots(docs, 2)
    assert lots.filter("gram IS NOT NULL").count() == distinct and lots.filter("text IS NOT NULL").count() == 60
    small = quality.text_lots(docs, 2, lot_bytes=100)
    assert small.select("lot").distinct().count() > 10
    cost = lots.filter("gram IS NOT NULL").select("lang", "gram", (F.col("gram") % 7 + 1).cast("double").alias("bits"))
    one, many = ([tuple(r) for r in quality.lot_perplexities(d, cost, 2).orderBy("doc_id").collect()] for d in (lots, small))
    assert one == many and len(one) == 60
    want = {i: 2 ** (sum(g % 7 + 1 for g in quality.byte_grams(t.encode(), 2).tolist()) / len(t)) for i, _, t in texts}
    assert all(p == pytest.approx(want[i]) for i, _, p in one)
