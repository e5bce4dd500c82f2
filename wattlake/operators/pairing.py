"""All-pairs comparison of a corpus with a list of queries, in bounded blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_queries(corpus: DataFrame, queries: DataFrame, payload: Column, corpus_key: str, query_key: str, block: int = 256) -> DataFrame:
    """Each corpus row with every query payload as ``_q``.

    Queries are packed into blocks of about ``block`` entries; the corpus meets them by (block, salt). One block, the
    usual case, reads each corpus row once; more queries add passes, never larger blocks. The salt spreads the corpus
    evenly over the tasks whatever its keys are, and every pair is produced exactly once.
    """
    blocks = max(1, math.ceil(queries.count() / block))
    salts = corpus.sparkSession.sparkContext.defaultParallelism
    packed = (
        queries.select(F.pmod(F.xxhash64(query_key), F.lit(blocks).cast("long")).alias("_block"), payload.alias("_q"))
        .groupBy("_block").agg(F.collect_list("_q").alias("_qs"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    rows = corpus.withColumns(
        {
            "_salt": F.pmod(F.xxhash64(corpus_key), F.lit(salts)).cast("int"),
            "_block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))),
        }
    )
    return rows.join(packed, ["_block", "_salt"]).withColumn("_q", F.explode("_qs")).drop("_block", "_salt", "_qs")
