"""Fallback labels whose word counts are made once."""

from __future__ import annotations

from wattlake.plans import fallback


def _rows(spark):
    words = ("medidor leitura visor", "fatura valor vencimento", "medidor fatura", "", "xyz nova")
    rows = [(i, words[i % 5] + " medidor" * (i % 3), ("a", "b", "indefinido")[(i % 5) % 3]) for i in range(60)]
    return spark.createDataFrame([*rows, (100, None, "indefinido")], "k long, t string, c string")


def test_words_are_counted_once(spark, tmp_path):
    made = []

    def keep(df, name):
        made.append(name)
        path = f"{tmp_path}/{name}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = _rows(spark)
    got = fallback.fallback_labels(rows, "k", "t", "c", "indefinido", keep)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and len(set(made)) == len(made) == 4
    plain = fallback.fallback_labels(rows, "k", "t", "c", "indefinido")
    assert sorted(got.collect()) == sorted(plain.collect())
    assert got.count() == 61


def test_words_of_a_row_are_counted_where_it_is(spark):
    docs = _rows(spark).repartition("k")
    plan = fallback.counted(docs, "k", "c", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
