"""The vector operator deals its cells in turns and writes no copies of vectors."""

from __future__ import annotations

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from wattlake.llm import embeddings
from wattlake.llm.common import saved, shared_folder, table


def test_no_copies_of_vectors_are_written(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark) + "/llm")
    names = lambda: {s.getPath().toString() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    saved(spark.range(1), "test-folder")
    before = names()
    rows = embeddings.near_vectors(table(spark, SF, "embeddings")).count()
    wide = [f for f in names() - before if {"vector", "embedding"} & set(spark.read.parquet(f).columns)]
    assert rows and sum(spark.read.parquet(f).count() for f in wide) <= rows


def test_turns_hold_every_cell(spark):
    """The cells of all turns and blocks are as many as the counts say, negative and crowded ones too."""
    rng = np.random.default_rng(3)
    rows = [(k, 1, [float(v) for v in rng.standard_normal(8)]) for k in range(60)] + [(100 + k, 1, [1.0, 0.001 * k] + [0.0] * 6) for k in range(40)]
    frame = spark.createDataFrame(rows, "id long, copies long, embedding array<float>")
    key = ["dim", "block", "x", "y"]
    counted = embeddings._places(frame, 4, 0.2).groupBy(*key).agg(F.sum("homes"), F.sum("guests"))
    found: dict[tuple, list[int]] = {}
    for block in range(4):
        for turn in range(embeddings.TURNS):
            for r in embeddings._places(frame, 4, 0.2, block, turn).collect():
                found.setdefault((r.dim, r.block, r.x, r.y), [0, 0])[0 if r.home else 1] += 1
    assert {tuple(r[:4]): list(r[4:]) for r in counted.collect()} == found
    assert sum(map(sum, found.values())) == 100 * 4 * 5


def test_rounds_find_the_same(spark, monkeypatch):
    frame = table(spark, SF, "embeddings")
    whole = sorted(map(tuple, embeddings.near_vectors(frame).collect()))
    monkeypatch.setattr(embeddings, "ROUND_ROWS", 1)
    rounds = embeddings.near_vectors(frame.limit(120), chunk_rows=7)
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, embeddings.near_vectors(frame.limit(120)).collect())) and len(whole) == frame.count()
