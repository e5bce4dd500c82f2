"""Results that hang on the rows alone: mixing under other splits, untouched columns, a reopened digest index."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wattlake.llm import exact, langid, mixing

KINDS = "doc_id long, text string, lang string, source string"


def some_docs(n: int) -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 40))), rng.choice(["en", "fr"]), rng.choice(["a", "b", None])) for i in range(n)]
    return rows + rows[:5] + [(None, "no id here", "en", "a"), (7, None, None, "c"), (8, "", "en", "c")]


def test_mix_is_the_same_however_rows_are_split(spark):
    rows = some_docs(600)
    random.Random(1).shuffle(rows)
    one, many = spark.createDataFrame(rows, KINDS).coalesce(1), spark.createDataFrame(rows[::-1], KINDS).repartition(4)
    key = lambda df: sorted(map(str, df.collect()))
    report = key(mixing.mix_report(one))
    assert report == key(mixing.mix_report(many)) and any("taken=0" not in r for r in report)
    assert key(mixing.mix_documents(one)) == key(mixing.mix_documents(many))


def test_stages_leave_the_columns_of_a_document_alone(spark):
    extra = {"score": F.lit("mine"), "lang_pred": F.lit(3), "bits": F.lit("b"), "row": F.lit("r"), "own": F.lit(2.5), "shard": F.lit("s"), "h1": F.lit("h")}
    docs = spark.createDataFrame(some_docs(60), KINDS).select("*", *[v.alias(k) for k, v in extra.items()])
    for stage in (langid.known_language, mixing.mix_documents):
        got = stage(docs)
        assert got.dtypes == docs.dtypes
        held = {(r.score, r.lang_pred, r.bits, r.row, r.own, r.shard, r.h1) for r in got.collect()}
        assert held == {("mine", 3, "b", "r", 2.5, "s", "h")}
        assert stage(docs.limit(0)).collect() == []


def test_digest_index_keeps_its_buckets(spark, tmp_path):
    digests = exact.text_digests(spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string"))
    path = str(tmp_path / "index")
    exact.DigestIndex(spark, path, 8).ingest(digests)
    with pytest.raises(ValueError, match="8 buckets"):
        exact.DigestIndex(spark, path, 4)
    again = exact.DigestIndex(spark, path)
    again.ingest(digests)
    assert again.buckets == 8 and again.table().count() == 300
    assert again.decide(digests).filter("kept").count() == 300
