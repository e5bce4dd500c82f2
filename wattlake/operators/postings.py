"""Stored inverted index in document shards, with bounds per block, and its top-k search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.operators.grouping import top_per_group

K1, B = 1.5, 0.75
BLOCK = 128  # postings of a block
SHARD_DOCS = 16_384  # documents of a shard; bounds what a search task holds
QUERY_LOT = 256  # queries that a search task answers


def build(docs: DataFrame, key: str, text: str, tokens: Callable[[Column], Column], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Blocks of postings: shard, termo, n_bloco, n, chaves, tfs, tamanhos, tf_max, tamanho_min.

    Documents are dealt to shards of about ``shard_docs`` by key and shuffled once, as texts; words are then counted and gathered inside a shard. Each
    document also has a posting under the empty term, so the lengths of all documents come from the index. A list is cut into blocks by ascending key;
    the largest frequency and the smallest length of a block bound what any of its documents can score.
    """
    spark = docs.sparkSession
    # Rows with a key only: a document must be nameable in a result.
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    shards = max(spark.sparkContext.defaultParallelism, -(-rows.count() // shard_docs))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("_k"), F.lit(shards)).cast("int")).repartitionByRange(shards, "shard")
    words = dealt.select("shard", "_k", tokens(F.coalesce("_t", F.lit(""))).alias("_w")).withColumn("tamanho", F.size("_w"))
    each = words.select("shard", "_k", "tamanho", F.explode(F.concat(F.array(F.lit("")), "_w")).alias("termo"))
    counted = each.groupBy("shard", "termo", "_k", "tamanho").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    lists = counted.groupBy("shard", "termo").agg(F.array_sort(F.collect_list(F.struct("_k", "tf", "tamanho"))).alias("_l"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / BLOCK).cast("int")), lambda i: F.slice("_l", i * BLOCK + 1, BLOCK))
    blocks = lists.select("shard", "termo", F.posexplode(cut).alias("n_bloco", "_b"))
    return blocks.select(
        "shard", "termo", "n_bloco", F.size("_b").alias("n"), F.col("_b._k").alias("chaves"), F.col("_b.tf").alias("tfs"), F.col("_b.tamanho").alias("tamanhos"),
        F.array_max("_b.tf").alias("tf_max"), F.array_min("_b.tamanho").alias("tamanho_min"),
    ).sortWithinPartitions("shard", "termo", "n_bloco")


def postings(index: DataFrame, key: str) -> DataFrame:
    """Rows (key, termo, tf, tamanho) of all documents, read from the index."""
    zipped = F.explode(F.arrays_zip("chaves", "tfs", "tamanhos"))
    return index.filter("termo <> ''").select("termo", zipped.alias("_p")).select(
        F.col("_p.chaves").alias(key), "termo", F.col("_p.tfs").alias("tf"), F.col("_p.tamanhos").alias("tamanho")
    )


def sizes(index: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    every = index.filter("termo = ''").select(F.explode("tamanhos").alias("t"))
    return every.agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("media"))


def frequencies(index: DataFrame) -> DataFrame:
    """Documents per term; reads two short columns."""
    return index.filter("termo <> ''").groupBy("termo").agg(F.sum("n").alias("df"))


def weight(tf, length, average):
    """The part of a BM25 contribution that lies in the document, as a column or an array."""
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / average))


class _Shard:
    """Blocks of the asked terms of one shard; documents are numbered in the order of their keys."""

    def __init__(self, rows: pd.DataFrame, average: float):
        chunks = rows["chaves"].to_numpy()
        self.keys, numbers = np.unique(np.concatenate(chunks), return_inverse=True)
        ends = np.cumsum([len(c) for c in chunks])
        tfs, lengths = np.concatenate(rows["tfs"].to_numpy()), np.concatenate(rows["tamanhos"].to_numpy())
        weights = weight(tfs.astype(float), lengths.astype(float), average)
        bounds = weight(rows["tf_max"].to_numpy(float), rows["tamanho_min"].to_numpy(float), average)
        self.terms: dict[str, list[tuple[float, np.ndarray, np.ndarray]]] = {}
        for term, a, z, bound in zip(rows["termo"], ends - [len(c) for c in chunks], ends, bounds, strict=True):
            self.terms.setdefault(term, []).append((float(bound), numbers[a:z], weights[a:z]))
        self.scored = self.skipped = 0

    def best(self, asked: list[tuple[str, float]], k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and rounded scores of the k best documents. A block is left out only if none of its documents can still be among them."""
        slack = 10.0**-digits
        held = [(idf * max(b for b, _, _ in self.terms[t]), idf, self.terms[t]) for t, idf in asked if t in self.terms]
        held.sort(key=lambda x: -x[0])
        rest = np.append(np.cumsum([top for top, _, _ in held][::-1])[::-1], 0.0)
        sums, seen = np.zeros(len(self.keys)), np.zeros(len(self.keys), bool)
        floor = 0.0
        for at, (_, idf, blocks) in enumerate(held):
            for bound, docs, weights in blocks:
                # What a document of this block has so far, may get here, and may get from the terms after this one.
                if floor > 0 and sums[docs].max() + idf * bound + rest[at + 1] < floor - slack:
                    self.skipped += 1
                    continue
                sums[docs] += idf * weights
                seen[docs] = True
                self.scored += 1
            if at + 1 < len(held) and seen.sum() >= k:
                floor = float(np.partition(sums, len(sums) - k)[len(sums) - k])
        found = np.flatnonzero(seen & (sums >= floor - slack))
        scores = np.round(sums[found], digits)
        order = np.lexsort((found, -scores))[:k]
        return found[order], scores[order]


def search(
    index: DataFrame, queries: DataFrame, qkey: str, dkey: str, k: int, score: str = "bm25", digits: int = 6
) -> DataFrame:
    """The k documents of highest BM25 for each query: qkey, dkey, score, rank. Scores are rounded; equal ones go by key.

    ``queries`` has rows (qkey, termo, qtf). Only blocks of asked terms leave the scan; each shard meets each lot of queries in one task, skips blocks that
    cannot reach its k-th best, and gives back k rows a query, whatever the size of the corpus. Queries without a known term have no row.
    """
    lots = max(1, -(-queries.select(qkey).distinct().count() // QUERY_LOT))
    shards = index.select("shard").distinct()
    stats = sizes(index)
    n, average = (stats.select(c).scalar() for c in ("n", "media"))
    known = frequencies(index.select("termo", "n").join(queries.select("termo").distinct(), "termo", "left_semi"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    asked = queries.join(known, "termo").select(
        F.pmod(F.xxhash64(qkey), F.lit(lots)).cast("int").alias("lote"), F.col(qkey).alias("_q"), "termo", (idf * F.col("qtf")).alias("peso")
    )
    wanted = index.join(asked.select(F.col("lote").alias("_lote"), "termo").distinct(), "termo").withColumn("media", F.greatest(average, F.lit(1.0)))
    # Every shard meets every lot: the shards are few, one a task.
    numbers = shards.agg(F.sort_array(F.collect_set("shard")).alias("s")).select("s").scalar()
    spread = asked.withColumn("_shard", F.explode(numbers))
    kinds = f"{qkey} {dict(queries.dtypes)[qkey]}, {dkey} {index.schema['chaves'].dataType.elementType.simpleString()}, {score} double"

    def meet(held: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(ask):
            shard = _Shard(held, float(held["media"].iat[0]))
            for name, rows in ask.groupby("_q", sort=False):
                at, scores = shard.best(list(zip(rows["termo"], rows["peso"], strict=True)), k, digits)
                out.append(pd.DataFrame({qkey: [name] * len(at), dkey: shard.keys[at], score: scores}))
        return pd.concat(out) if out else pd.DataFrame({qkey: [], dkey: [], score: []})

    found = wanted.groupBy("shard", "_lote").cogroup(spread.groupBy("_shard", "lote")).applyInPandas(meet, kinds)
    return top_per_group(found, [qkey], [F.desc(score), F.asc(dkey)], k)
