"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import WORD, hashed, prefix_sums, saved

LEVELS = 6  # levels of the splitting tree that one task does for a node


def ranked(rows: DataFrame) -> DataFrame:
    """Add row_id, the place of each row in the order of its two content hashes ``h1``, ``h2``, and drop these.

    So the numbers, and all draws that hang on them, come from the rows alone and not from how a scan was split. Rows that are equal in
    all hashed columns may swap numbers, which changes nothing. Written, so that the numbers stay.
    """
    numbered = prefix_sums(rows.withColumn("one", F.lit(1).cast("long")), [], ["h1", "h2"], {"row_id": "one"}, "ranked")
    return saved(numbered.drop("one", "h1", "h2"), "sized")


def content(docs: DataFrame) -> list[Column]:
    """Two independent hashes of a row over all its columns that can be hashed."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return [hashed(*columns, seed=21).alias("h1"), hashed(*columns, seed=22).alias("h2")]


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, source, size): words of the whole text, 0 for null."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    plain = docs.select("doc_id", "source", text_col)
    return ranked(plain.select("doc_id", "source", size.alias("size"), *content(plain)))


def source_targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_no, source_size, n_docs, weight, target), one row per source.

    Sources in code-point order, null last, take the weights in turn. ``share`` of all words is dealt by weight; a source stops at ``most``
    times its size and the rest is dealt again by weight until none is above. The driver holds four sums per turn, whatever the
    number of sources, and turns end once no further source stops.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per_source = per_source.withColumns({"unnamed": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    numbered = prefix_sums(per_source, [], ["unnamed", "source"], {"source_no": "one"}, "sources").drop("unnamed", "one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = saved(numbered.withColumn("weight", weight), "weighted")
    level, stopped = 0.0, -1
    while True:
        full = (F.col("source_size") * most <= F.col("weight") * level) if stopped >= 0 else F.lit(False)
        total, held, free, count = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if count == stopped or free <= 0:
            break
        level, stopped = max(0.0, share * total - most * held) / free, count
    return table.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * level).cast("double"))


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, source_no, n): exact block quotas of each source dealt among ``shards`` of equal size.

    A node of the tree is a range of shards with the quotas it has to place. It gives its left half as many blocks as those shards hold,
    drawn without replacement over sources (multivariate hypergeometric), and the rest to the right half. A task takes one node with
    one number per source and does ``LEVELS`` levels below it, so rounds are few and no task sees blocks.
    """
    blocks = quotas.agg(F.sum("quota")).first()[0] or 0
    nodes = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "source_no", "quota")

    def descend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no", ignore_index=True)
        names, out = rows["source_no"].to_numpy(), []
        todo = [(int(rows["lo"].iat[0]), int(rows["hi"].iat[0]), rows["quota"].to_numpy(), 0)]
        while todo:
            lo, hi, counts, depth = todo.pop()
            if hi - lo == 1 or depth == LEVELS:
                some = counts > 0
                out.append(pd.DataFrame({"lo": lo, "hi": hi, "source_no": names[some], "quota": counts[some]}))
                continue
            mid = (lo + hi) // 2
            left = blocks * mid // shards - blocks * lo // shards
            drawn = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, left, method="marginals")
            todo += [(lo, mid, drawn, depth + 1), (mid, hi, counts - drawn, depth + 1)]
        return pd.concat(out, ignore_index=True)

    for turn in range(math.ceil(math.log2(max(2, shards)) / LEVELS)):
        nodes = nodes.groupBy("lo", "hi").applyInPandas(descend, "lo long, hi long, source_no long, quota long")
        nodes = saved(nodes, f"nodes-{turn}")
    return nodes.select(F.col("lo").alias("shard"), "source_no", F.col("quota").alias("n"))


def fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block that its target cuts: whole documents, longest first, as long as they fit, and one more if that comes nearer."""
    rows = rows.sort_values(["size", "perm", "row_id"], ascending=[False, True, True], ignore_index=True)
    room, keep = float(rows["room"].iat[0]), np.zeros(len(rows), bool)
    sizes = rows["size"].to_numpy()
    for k, size in enumerate(sizes):
        if size <= room:
            keep[k], room = True, room - size
    rest = np.flatnonzero(~keep)
    if len(rest) and sizes[rest[-1]] - room < room:
        keep[rest[-1]] = True
    return rows.loc[keep, ["row_id", "source_no", "epoch", "draw", "size"]]


def draw(
    rows: DataFrame,
    targets: DataFrame,
    seed: int = 0,
    most: int = 2,
    block_words: int = 65_536,
    block_docs: int = 4_096,
    shard_blocks: int = 64,
) -> DataFrame:
    """(row_id, epoch, shard, place, size): one row for each time that a document is taken.

    A source's documents are dealt by hash into blocks of about ``block_words`` words or ``block_docs`` documents. Its blocks are put in a
    random order, once for each epoch, and taken until the target is reached; only the last one may be taken in part. The
    splitting tree says how many blocks of each source a shard gets; it gets the next ones in that order, so shards share none.
    ``place`` orders the documents inside a shard. A document is taken once per epoch at most.
    """
    blocks_of = F.greatest(
        F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n_docs") / block_docs)
    ).cast("long")
    keyed = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    keyed = keyed.select("row_id", "size", "source_no", "target", F.pmod(hashed("row_id", seed=seed + 1), blocks_of).alias("block"))
    keyed = saved(keyed, "keyed")
    blocks = keyed.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    turns = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumns(
        {"perm": hashed("source_no", "epoch", "block", seed=seed + 2), "one": F.lit(1).cast("long")}
    )
    lined = prefix_sums(turns, ["source_no"], ["epoch", "perm", "block"], {"before": "words", "draw": "one"}, "blocks")
    taken = saved(lined.filter(F.col("before") < F.col("target")), "drawn")

    quotas = taken.groupBy("source_no").agg(F.count(F.lit(1)).alias("quota"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    leaves = prefix_sums(split_quotas(quotas, shards, seed), ["source_no"], ["shard"], {"start": "n"}, "leaves")
    slots = leaves.select("source_no", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("draw"))

    member = keyed.drop("target").join(
        taken.select("source_no", "block", "epoch", "draw", "words", (F.col("target") - F.col("before")).alias("room")), ["source_no", "block"]
    )
    cut = F.col("words") > F.col("room")
    columns = ["row_id", "source_no", "epoch", "draw", "size"]
    part = member.filter(cut).withColumn("perm", hashed("row_id", "epoch", seed=seed + 3))
    part = part.groupBy("source_no").applyInPandas(fill, "row_id long, source_no long, epoch int, draw long, size long")
    everything = member.filter(~cut).select(columns).unionByName(part)
    return everything.join(slots, ["source_no", "draw"]).select(
        "row_id", "epoch", "shard", hashed("row_id", "epoch", seed=seed + 4).alias("place"), "size"
    )


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per document: size, size and target of its source, and the words that the mix takes of it (repeats counted).

    Null text has size 0; null sources form the last source; a null doc_id stays null. Repeated rows are documents of their own. Without any
    word all targets are 0 and nothing is taken. Reruns over the same rows take the same, however they are split.
    """
    rows = sized(docs)
    targets = saved(source_targets(rows), "targets")
    taken = draw(rows, targets, seed).groupBy("row_id").agg(F.sum("size").alias("taken"))
    known = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    known = known.select("row_id", "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target")
    return known.join(taken, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, seed: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """The mixed documents themselves, with all their columns: shard by shard, shuffled inside each.

    A document that is taken twice comes twice, one that is not taken is absent. ``columns`` limits and orders the result.
    """
    columns = list(columns or docs.columns)
    # The document's own columns travel in one struct, so that no name of theirs meets one of the mix.
    own = docs.select(F.struct("*").alias("own"), "source", "text", *content(docs))
    held = saved(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = ranked(held.select("row", "source", size.alias("size"), "h1", "h2"))
    draws = draw(rows, saved(source_targets(rows), "targets"), seed).join(rows.select("row_id", "row"), "row_id").select("row", "shard", "place")
    mixed = held.select("row", "own").join(draws, "row")
    placed = mixed.repartition("shard").sortWithinPartitions("shard", "place")
    return placed.select(*[F.col("own").getField(c).alias(c) for c in columns])
