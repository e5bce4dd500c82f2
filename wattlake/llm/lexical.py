"""Ranked lexical search by bag deduplication: documents that look alike to the items are scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlake.llm.common import hashed, prefix_sums, saved

# A term is a run of bytes of ASCII letters and digits or of characters above U+007F; only A-Z change case.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
STRETCH = 1 << 22  # bytes of a text whose words are in memory at once
TILE = 2048  # classes scored at once
SALTS = 32  # parts of an item's candidates that are cut before they meet


def term_counts(text: bytes | None) -> tuple[int, Counter]:
    """Number of terms of a whole text, and how often each occurs. Very long texts are counted a stretch at a time."""
    counts: Counter = Counter()
    data, at = text or b"", 0
    while at < len(data):
        stop = at + STRETCH
        part = data[at:stop].translate(_TERM_BYTES)
        if stop < len(data) and (end := part.rfind(b" ")) > 0:
            part = part[:end]
        elif stop < len(data):  # one term longer than a stretch: take the text up to the end of that term
            rest = data[at:].translate(_TERM_BYTES)
            end = rest.find(b" ", len(part))
            part = rest if end < 0 else rest[:end]
        counts.update(part.split())
        at += max(1, len(part))
    return counts.total(), counts


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, term, block); blocks of items hold about ``block`` postings at most, so that each can be sent to all tasks."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                _, found = term_counts(text)
                yield pd.DataFrame({"item_id": [item] * len(found), "term": list(found)})

    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInPandas(words, "item_id long, term binary").distinct()


def _blocks(terms: DataFrame, postings: int) -> DataFrame:
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = prefix_sums(sizes, [], ["item_id"], {"before": "n"}, "lexical-items")
    return saved(terms.join(sizes.select("item_id", F.floor(F.col("before") / postings).alias("block")), "item_id"), "lexical-terms")


def _bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document: doc_id, n, and its bag, that is the sorted numbers of the vocabulary's terms in it and how often each occurs."""
    sent = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = sent.value
        for batch in batches:
            lengths, terms, often = [], [], []
            for text in batch["text"]:
                n, counts = term_counts(text)
                bag = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                lengths.append(n)
                terms.append([t for t, _ in bag])
                often.append([c for _, c in bag])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": lengths, "terms": terms, "tfs": often})

    return docs.mapInPandas(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best_classes(classes: DataFrame, starts: np.ndarray, places: np.ndarray, weights: np.ndarray, items: np.ndarray, k: int) -> DataFrame:
    """The k best classes of each item among those of a task: item_id, class, least, score.

    ``places[starts[t] : starts[t + 1]]`` are the items (by position) that hold term ``t``.
    """
    sent = classes.sparkSession.sparkContext.broadcast((starts, places, weights, items))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, places, weights, items = sent.value
        held: list[list[tuple[int, int, int]]] = [[] for _ in items]
        floor = np.zeros(len(items), np.int64)
        last = np.iinfo(np.int64).max
        for batch in batches:
            for begin in range(0, len(batch), TILE):
                tile = batch.iloc[begin : begin + TILE]
                sizes = tile["terms"].map(len).to_numpy()
                rows = np.repeat(np.arange(len(tile)), sizes)
                terms, tfs = np.concatenate(tile["terms"].to_numpy()), np.concatenate(tile["tfs"].to_numpy()).astype(np.int64)
                m = tile["m"].to_numpy(np.int64)[rows]
                gains = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))
                scores = np.zeros((len(items), len(tile)), np.int64)
                order = np.argsort(terms, kind="stable")
                cuts = np.flatnonzero(np.diff(terms[order])) + 1
                for group in np.split(order, cuts):
                    at = places[starts[terms[group[0]]] : starts[terms[group[0]] + 1]]
                    scores[np.ix_(at, rows[group])] += gains[group]
                ids = tile["class"].to_numpy()
                least = tile["least"].fillna(last).to_numpy(np.int64)
                for i in np.flatnonzero(scores.max(axis=1, initial=0) >= np.maximum(floor, 1)):
                    found = np.flatnonzero(scores[i] >= max(floor[i], 1))
                    if len(found) > 4 * k:  # all that reach the k-th best stay, whatever the number of ties
                        bound = np.partition(scores[i][found], len(found) - k)[len(found) - k]
                        found = found[scores[i][found] >= bound]
                    both = held[i] + [(-int(scores[i, c]), int(least[c]), int(ids[c])) for c in found]
                    held[i] = sorted(both)[:k]
                    if len(held[i]) == k:
                        floor[i] = -held[i][-1][0]
        out = [(int(items[i]), c, None if e == last else e, -s) for i, best in enumerate(held) for s, e, c in best]
        yield pd.DataFrame(out, columns=["item_id", "class", "least", "score"]).astype({"least": "Int64"})

    return classes.filter("size(terms) > 0").select("class", "least", "m", "terms", "tfs").mapInPandas(score, "item_id long, class long, least long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_postings: int = 1_000_000,
) -> DataFrame:
    """Per item its ``k`` documents of highest score above 0: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    Every document is reduced to its bag: the items' terms it holds, with their numbers, and the length class m. Documents with the same bag
    and m form a class: grouped by a hash, told apart by the bags themselves. A class is scored once for every item. The k best documents of an
    item lie in its k best classes (equal scores by smallest doc_id), and there among the k smallest ids of each; so only those are expanded.

    Items go to the tasks in blocks of about ``block_postings`` (item, term) pairs, which bounds what is sent; one more block is one more pass. A class that
    holds most documents is one row after map-side aggregation, and its members are cut to k before they are shuffled.

    Documents without a term count nowhere; rows that repeat are documents of their own; a null doc_id comes last among equals. Items that
    repeat an item_id are one item with the terms of both; items without id or terms, and empty tables, give no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    terms = _blocks(item_terms(items, item_col, item_text), block_postings)
    found = None
    for block in sorted(r.block for r in terms.select("block").distinct().collect()):  # as many as blocks, not items
        mine = terms.filter(F.col("block") == block)
        # At most one block's pairs: a bounded number.
        pairs = mine.select("term", "item_id").toPandas().sort_values(["term", "item_id"])
        names, number = np.unique(pairs["term"].to_numpy(), return_inverse=True)
        item_ids, places = np.unique(pairs["item_id"].to_numpy(), return_inverse=True)
        starts = np.searchsorted(number, np.arange(len(names) + 1))
        bags = saved(_bags(rows, [bytes(t) for t in names]), "lexical-bags")

        totals = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
        if not totals.N:
            continue
        m = F.lit(50) + F.expr(f"(50L * n * {totals.N}L) div {totals.L}L")
        df = bags.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        w = F.floor(1000 * F.log(F.lit(2.0 * totals.N + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = np.zeros(len(names), np.int64)
        known = df.select("t", w.alias("w")).toPandas()  # one row a term of the block
        weights[known["t"].to_numpy()] = known["w"].to_numpy()

        key = hashed("m", "terms", "tfs")
        keyed = bags.filter("size(terms) > 0").withColumn("m", m).withColumn("bag", key)
        # The bags themselves are grouping keys, so a hash that two bags share joins nothing.
        classes = keyed.groupBy("bag", "m", "terms", "tfs").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"))
        classes = saved(classes.withColumn("class", F.monotonically_increasing_id()), "lexical-classes")

        local = _best_classes(classes, starts, places, weights, item_ids, k)
        order = [F.desc("score"), F.asc_nulls_last("least"), F.asc("class")]
        salted = Window.partitionBy("item_id", "salt").orderBy(*order)
        local = local.withColumn("salt", F.pmod(hashed("class"), F.lit(SALTS)))
        local = local.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
        whole = Window.partitionBy("item_id").orderBy(*order)
        best = saved(local.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k).select("item_id", "class", "score"), "lexical-best")

        chosen = classes.join(best.select("class").distinct(), "class", "left_semi").select("class", "bag", "m", "terms", "tfs")
        members = keyed.select("doc_id", "bag", "m", "terms", "tfs").join(chosen, ["bag", "m", "terms", "tfs"]).select("class", "doc_id")
        first = Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id"))
        members = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).drop("r")
        ranked = best.join(members, "class")
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = ranked.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS ts
  FROM documents),
n AS (SELECT r, doc_id, len(ts) AS n, ts FROM t WHERE len(ts) > 0),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM n) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark
  WHERE item_id IS NOT NULL),
w AS (SELECT q.item_id, q.term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), tot),
s AS (SELECT w.item_id, tf.r, tf.doc_id,
    sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * tf.n * docs) // terms))))::BIGINT AS score
  FROM w JOIN tf USING (term), tot GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""
