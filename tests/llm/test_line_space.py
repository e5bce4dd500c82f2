"""The line operator leaves no shuffle files and spent tables behind, and meets lines by the same keys in parts as at once."""

from __future__ import annotations

import time

from conftest import SF
from pyspark.sql import functions as F

from wattlake.llm import lines
from wattlake.llm.common import components, documents, saved, shared_folder


def shuffles(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")


def test_written_tables_keep_no_shuffle_files(spark):
    before = shuffles(spark)
    out = saved(spark.range(5_000).groupBy((F.col("id") % 701).alias("k")).count(), "test-space")
    for _ in range(50):
        if shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffles(spark) <= before and out.count() == 701


def test_components_drop_their_rounds(spark):
    out = components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"), name="test-rounds")
    assert {r.component for r in out.collect()} == {0}
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark) + "/llm")
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert sum(n.startswith("test-rounds") for n in names) == 1


def test_keys_in_parts(spark):
    """The keys of all parts are those of one, and of a line of any length the hashes of its grams, the smallest of each class if they are many."""
    norms = ["abc de fg hij", "ação é à ß " * 40 + "fim", "数据处理需要清洗重复的内容", "x y " * 700 + "end"]
    texts = spark.createDataFrame(list(enumerate(norms)), "line long, norm string")
    whole = {(r.line, r.key) for r in lines.gram_members(texts).collect()}
    assert whole == {(r.line, r.key) for k in range(3) for r in lines.gram_members(texts, k, 3).collect()}
    for at, norm in enumerate(norms):
        grams = [norm[i : i + n] for n, lo, hi in lines.GRAMS if lo <= len(norm) <= hi for i in range(len(norm) - n + 1)]
        hashes = spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g").bitwiseOR(F.lit(1 << 40)).alias("h"))
        hashes = {r.h for r in hashes.collect()}
        if len(grams) > 1 << lines.SLOTS_LOG:
            hashes = {min(h for h in hashes if h >> 59 == c) for c in {h >> 59 for h in hashes}}
        assert {k for line, k in whole if line == at} == {h & ((1 << lines.KEY_BITS) - 1) for h in hashes}


def test_verified_in_rounds(spark):
    """More pairs than lines are verified in rounds, and none is lost."""
    texts = lines.text_table(documents(spark, SF).limit(5), 5).limit(6)
    texts = saved(texts, "test-verified")
    pairs = texts.select(F.col("line").alias("a")).crossJoin(texts.select(F.col("line").alias("b"))).filter("a <= b")
    assert pairs.count() == 21
    found = lines._verified(pairs, texts, 0, "test-rounds-of", False)
    assert found.count() == 21 == found.distinct().count()
