"""Language identification by prediction by partial matching: frozen byte context trees and exact code lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.llm.common import hashed

UNKNOWN = "und"
STRETCH = 1 << 20  # bytes scored at once


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text leaves 1 when divided by 3. A null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


class Lookup:
    """64-bit keys to row numbers by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask, self.probes = np.uint64(64 - bits), (1 << bits) - 1, 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several that want a slot the last one gets it
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask
            self.probes += bool(len(todo))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        rows = self.slots[at]
        wrong = np.flatnonzero((rows >= 0) & (self.keys[rows] != keys))
        for _ in range(self.probes - 1):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & self.mask
            rows[wrong] = self.slots[at[wrong]]
            again = rows[wrong]
            wrong = wrong[(again >= 0) & (self.keys[again] != keys[wrong])]
        rows[wrong] = -1
        return rows


@dataclass
class PpmModel:
    """Code lengths in bits for every language.

    ``grams[k]`` finds a context of k bytes with the byte after it, ``cost[k]`` holds what that byte costs there, escapes to shorter
    contexts included; ``contexts[k]`` and ``escape[k]`` give the price of leaving a context in which the byte was never seen.
    """

    languages: list[str]
    order: int
    grams: list[Lookup] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    contexts: list[Lookup] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, languages: list[str], order: int, counts: pd.DataFrame) -> PpmModel:
        """From rows (language number, order, gram, n). Escapes by method C: q symbols seen in n tries cost n/(total+q), an escape q/(total+q)."""
        model, width = cls(languages, order), len(languages)
        floor = np.full((1, width), 8.0)  # below the empty context all 256 bytes are equally likely
        for k in range(order + 1):
            rows = counts[counts["size"] == k]
            grams, at = np.unique(rows["gram"].to_numpy().astype(np.uint64), return_inverse=True)
            n = np.zeros((len(grams), width))
            n[at, rows["language"].to_numpy()] = rows["n"].to_numpy()
            contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                seen = np.log2((total + kinds)[of] / n)
            if k:
                lower = model.cost[k - 1][model.grams[k - 1].find(grams & np.uint64((1 << 8 * k) - 1))]
            else:
                lower = floor
            model.grams.append(Lookup(grams))
            model.cost.append(np.where(n > 0, seen, escape[of] + lower).astype(np.float32))
            model.contexts.append(Lookup(contexts))
            model.escape.append(escape.astype(np.float32))
        return model

    def bits(self, data: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language; ``since`` is how many bytes of its text come before it."""
        keys = [data.astype(np.uint64)]
        for k in range(1, self.order + 1):
            longer = keys[-1].copy()
            longer[k:] |= keys[0][:-k] << np.uint64(8 * k)
            keys.append(longer)
        out = np.zeros((len(data), len(self.languages)), np.float32)
        todo = np.arange(len(data))
        for k in range(self.order, -1, -1):
            able = since[todo] >= k
            tried, later = todo[able], todo[~able]
            grams = keys[k][tried]
            rows = self.grams[k].find(grams)
            hit = rows >= 0
            out[tried[hit]] += self.cost[k][rows[hit]]
            missed = tried[~hit]
            left = self.contexts[k].find(grams[~hit] >> np.uint64(8))
            known = left >= 0
            out[missed[known]] += self.escape[k][left[known]]
            todo = np.concatenate([missed, later])
        out[todo] += np.float32(8)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): exact code length of every whole text, a stretch of bytes at a time."""
        total = np.zeros((len(texts), len(self.languages)))
        which: list[int] = []
        parts: list[tuple[bytes, int]] = []  # bytes, and how many of them only give context
        held = 0

        def flush() -> None:
            nonlocal held
            if not parts:
                return
            data = np.frombuffer(b"".join(p for p, _ in parts), np.uint8)
            lengths = np.array([len(p) for p, _ in parts])
            starts = np.cumsum(lengths) - lengths
            since = np.arange(len(data)) - np.repeat(starts, lengths)
            bits = self.bits(data, since)
            for (_, lead), start in zip(parts, starts, strict=True):
                bits[start : start + lead] = 0
            np.add.at(total, which, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
            which.clear(), parts.clear()
            held = 0

        for k, text in enumerate(texts):
            for at in range(0, len(text), STRETCH):
                lead = min(at, self.order)
                parts.append((text[at - lead : at + STRETCH], lead))
                which.append(k)
                held += len(parts[-1][0])
                if held >= STRETCH:
                    flush()
        flush()
        return total


def train(
    docs: DataFrame, order: int = 4, rows_per_language: int = 400, row_bytes: int = 65_536, usable: Column | None = None
) -> PpmModel:
    """Learn one context tree per non-null ``lang`` from a bounded sample of labelled texts.

    A text of up to ``row_bytes`` bytes is one piece, a longer one is cut into pieces of ``row_bytes // 4`` characters, none of them longer than
    ``row_bytes`` bytes. Of each language the ``rows_per_language`` pieces with the smallest hash of id and place are learned from, among texts that
    hold a letter and are not held out. So what reaches the driver is bounded by the parameters, whatever the input, and a language that has only long texts is learned too.
    """
    usable = ~held_out() if usable is None else usable
    able = usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & has_letter()
    step = max(1, row_bytes // 4)
    rows = docs.filter(able).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    whole = F.octet_length("text") <= row_bytes
    pieces = F.when(whole, 1).otherwise(F.ceil(F.char_length("text") / step).cast("int"))
    units = rows.select("doc_id", "lang", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_piece"))
    place = F.when(F.col("_piece") == 0, hashed("doc_id", seed=1)).otherwise(F.xxhash64(hashed("doc_id", seed=1), "_piece"))
    chosen = units.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id", "_piece")))
    chosen = chosen.filter(F.col("_nth") <= rows_per_language).groupBy("doc_id", "lang").agg(F.collect_set("_piece").alias("_pieces"))
    cut = rows.join(chosen, ["doc_id", "lang"]).select("lang", "text", whole.alias("_whole"), F.explode("_pieces").alias("_piece"))
    sample = cut.select("lang", F.when(F.col("_whole"), F.col("text")).otherwise(F.substring("text", F.col("_piece") * step + 1, F.lit(step))).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                arrays = [np.frombuffer(t.encode(), np.uint8).astype(np.uint64) for t in texts]
                for k in range(order + 1):
                    grams = []
                    for a in arrays:
                        if len(a) > k:
                            g = a[k:].copy()
                            for j in range(1, k + 1):
                                g |= a[k - j : len(a) - j] << np.uint64(8 * j)
                            grams.append(g)
                    if grams:
                        found, n = np.unique(np.concatenate(grams), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "size": k, "gram": found.astype(np.int64), "n": n})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, size int, gram long, n long")
    counts = counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    counts["language"] = counts["lang"].map({name: k for k, name in enumerate(languages)}).astype(int)
    return PpmModel.build(languages, order, counts)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (probability of that language given the code lengths) and bits (its code length).

    A text that is null, empty or without a letter is ``und`` with score 0 and null bits, as is any text if nothing was
    learned. Equal code lengths go to the first language by name. Columns of these three names in ``docs`` are replaced. Rows are
    judged one by one, so repeated rows and very long texts need no special case: a text is coded a stretch at a time.
    """
    docs = docs.drop("lang_pred", "score", "bits")
    added = [("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's parameters
    at, columns_out = docs.columns.index(text_col), [*docs.columns, *(name for name, _ in added)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            letters = np.asarray(batch.column(batch.num_columns - 1).to_pylist(), bool)
            texts = [t.as_py().encode() if ok else b"" for t, ok in zip(batch.column(at), letters, strict=True)]
            names, scores, lengths = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if known.languages and len(texts):
                bits = known.code_lengths(texts)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(texts)), best]
                scores = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
                names = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                lengths = [float(n) if ok else None for n, ok in zip(least, letters, strict=True)]
            extra = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + extra
            yield pa.RecordBatch.from_arrays(columns, names=columns_out)

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    return docs.select("*", has_letter(text_col).alias("_letters")).mapInArrow(judge, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    model = train(docs)
    found = identify(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents in a learned language, with their own columns; a null ``lang`` is filled with the prediction.

    Rejected are texts without a letter and texts that no learned language compresses: whose code is longer than eight bits a
    byte and 64 bits. Where nothing can be learned (no labelled text) only texts without a letter are rejected.
    """
    model = train(docs)
    columns = docs.columns
    if not model.languages:
        return docs.filter(has_letter())
    # The document's own columns travel in one struct, so that none of theirs meets a column of the model.
    found = identify(docs.select(F.struct("*").alias("own"), F.col("text").cast("string").alias("text")), model)
    plain = F.col("bits") <= 8 * F.octet_length("text") + 64
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & plain)
    named = lambda c: F.coalesce(F.col("own").getField(c), F.col("lang_pred")) if c == "lang" else F.col("own").getField(c)
    return kept.select(*[named(c).alias(c) for c in columns])
