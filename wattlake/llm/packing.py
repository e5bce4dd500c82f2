"""Packing token pieces into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import hashed, saved
from wattlake.llm.tokens import encoder, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1) -> DataFrame:
    """Ids of each whole text plus the end id, cut only where longer than ``capacity``: one row per piece, without the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                rows += [(doc_id, k, start, n, zlib.crc32(part)) for k, (start, n, part) in enumerate(pieces(ids, capacity))]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, placed in turn, and the number of bins.

    ``open_bins[g]`` counts the open bins with residual gap g. An item goes where the sum of the squared counts becomes smallest: into a
    bin of some gap, which moves that bin to a smaller gap, or into a new bin. Ties go to the tightest bin, then to an open one.
    """
    open_bins = np.zeros(capacity, np.int64)
    at_gap: list[list[int]] = [[] for _ in range(capacity)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins, never = 0, np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        before = open_bins[s:]
        fresh = 2 * int(open_bins[capacity - s]) + 1 if s < capacity else 0
        gap = capacity
        if before.size:
            change = 2 * (open_bins[: capacity - s] - before) + 2
            change[0] -= 1  # a bin that becomes full leaves the counts
            change[before == 0] = never
            left = int(change.argmin())
            if change[left] <= fresh:
                gap = left + s
        if gap == capacity:
            where[k], bins = bins, bins + 1
        else:
            where[k] = at_gap[gap].pop()
            open_bins[gap] -= 1
        offset[k] = capacity - gap
        if gap > s:
            open_bins[gap - s] += 1
            at_gap[gap - s].append(int(where[k]))
    return where, offset, bins


def pack(cut: DataFrame, capacity: int = 4096, group_pieces: int = 65_536) -> DataFrame:
    """Give every piece a sequence and an offset in it.

    Pieces as long as a sequence stand alone. The others are dealt by row number to groups of about ``group_pieces`` rows of a few
    numbers each, whatever their source, so no task grows with the corpus; each group leaves a few bins open, about two in a
    thousand. A group is packed in hash order and in falling order of length, and the outcome with fewer sequences counts.
    Pieces with the same doc_id and piece number (repeated rows) are packed each by itself.
    """
    cut = saved(cut, "pieces")
    short = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    # Dealt by row number, so neither a repeated id nor a null one makes a group larger than others.
    short = short.withColumn("row", F.monotonically_increasing_id())
    short = short.withColumn("group_id", F.pmod(hashed("row", seed=4), F.lit(groups)).cast("int"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        falling = np.argsort(-lengths, kind="stable")
        where, offset, used = sum_of_squares(lengths, capacity)
        other, shift, fewer = sum_of_squares(lengths[falling], capacity)
        if fewer < used:
            where[falling], offset[falling] = other, shift
        group = int(rows["group_id"].iat[0])
        out = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        # Odd numbers are shared sequences, even ones those of whole-length pieces.
        out["sequence_id"] = 2 * (where + (group << 36)) + 1
        out["offset"] = offset
        return out

    shared = short.withColumn("order", hashed("doc_id", "piece", seed=5)).groupBy("group_id").applyInPandas(place, PLACES)
    alone = cut.filter(F.col("length") == capacity).select(
        "*", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return shared.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, group_pieces: int = 65_536) -> DataFrame:
    """Tokenise whole documents and pack them: one row per piece.

    Null and empty texts are the end id alone. A null doc_id stays null. Repeated rows are packed as often as they come. Columns other
    than doc_id and text are ignored. ``tokenizer`` is the path of a tokenizer file that every worker has.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity, group_pieces)
