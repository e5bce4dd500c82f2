"""Quality classifier: interpolated modified Kneser-Ney byte n-grams learned from trusted text, perplexity thresholds by language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import saved, shared_path
from wattlake.llm.langid import Lookup, PpmModel, has_letter

NO_LANGUAGE = "und"
LOT_BYTES = 1 << 26  # text of a lot, which one task holds with its grams


def _top_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): occurrences of every run of order + 1 bytes, the text led in by line breaks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                grams = []
                for text in texts:
                    a = np.frombuffer(b"\n" * order + text.encode(), np.uint8).astype(np.int64)
                    g = a[order:].copy()
                    for j in range(1, order + 1):
                        g |= a[order - j : len(a) - j] << (8 * j)
                    grams.append(g)
                found, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": found, "n": n})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_tables(sample: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Interpolated modified Kneser-Ney model for every language of ``sample`` (lang, text): its grams with ``alpha``, its contexts with ``gamma``.

    The longest grams have their counts, shorter ones the number of different bytes that come before them. Each count is lowered by one of
    three discounts, found from how many grams were seen once to four times; what that frees in a context goes to the next shorter
    one. Counts, context sums and discounts meet in joins sharded by gram. Where a count of counts is 0 the discounts are 0.5, 1 and 1.5.
    """
    level = _top_counts(sample, order)
    found = None
    for k in range(order, -1, -1):
        level = saved(level, f"grams-{k}")
        named = level.withColumns({"size": F.lit(k), "context": F.shiftright("gram", 8)})
        found = named if found is None else found.unionByName(named)
        if k:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))
            level = level.groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    grams = saved(found, "grams")
    times = [F.count(F.when(F.col("n") == t, 1)).alias(f"t{t}") for t in (1, 2, 3, 4)]
    t1, t2, t3, t4 = (F.col(f"t{t}").cast("double") for t in (1, 2, 3, 4))
    y = t1 / (t1 + 2 * t2)
    sound = (t1 > 0) & (t2 > 0) & (t3 > 0) & (t4 > 0)
    value = lambda i, more, these: F.when(sound, F.least(F.lit(i), F.greatest(F.lit(0.05), i - (i + 0.0) * y * more / these))).otherwise(i / 2)
    cut = grams.groupBy("lang", "size").agg(*times).select("lang", "size", value(1.0, 2 * t2, t1).alias("d1"), value(2.0, 1.5 * t3, t2).alias("d2"), value(3.0, 4 * t4 / 3, t3).alias("d3"))
    context = grams.groupBy("lang", "size", "context").agg(
        F.sum("n").alias("total"), *[F.count(F.when(c, 1)).alias(f"k{i}") for i, c in enumerate((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), 1)]
    )
    context = context.join(cut, ["lang", "size"]).withColumn(
        "gamma", (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
    )
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    alpha = grams.join(context, ["lang", "size", "context"]).select("lang", "size", "gram", ((F.col("n") - taken) / F.col("total")).alias("alpha"), "gamma")
    return alpha, context.select("lang", "size", "context", "gamma")


def kneser_ney(sample: DataFrame, order: int) -> PpmModel:
    """The model of a small ``sample`` as code lengths in the driver; ``sharded`` is for samples that grow."""
    alpha, context = gram_tables(sample, order)
    return _tables(alpha.toPandas(), context.toPandas(), order)


def sharded(sample: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The model on disk, by length of context: the probability ``p`` of each seen (lang, gram), and ``gamma`` of each (lang, context)."""
    alpha, context = gram_tables(sample, order)
    context = saved(context, "contexts")
    alpha, known = saved(alpha, "alpha"), []
    for k in range(order + 1):
        own = alpha.filter(F.col("size") == k)
        if k:
            below = known[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            own = own.withColumn("suffix", low_bytes("gram", k)).join(below, ["lang", "suffix"])
        else:
            own = own.withColumn("lower", F.lit(1 / 256))
        known.append(saved(own.select("lang", "gram", (F.col("alpha") + F.col("gamma") * F.col("lower")).alias("p")), f"known-{k}"))
    return known, [context.filter(F.col("size") == k).select("lang", "context", "gamma") for k in range(order + 1)]


def low_bytes(gram: str, k: int):
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))


def probabilities(wanted: DataFrame, known: list[DataFrame], gammas: list[DataFrame]) -> DataFrame:
    """(lang, full, p) for each (lang, gram) of ``wanted``: joins by gram with the sharded tables; what one lacks goes on to shorter contexts."""
    left = wanted.select("lang", F.col("gram").alias("full"), "gram", F.lit(1.0).alias("weight"))
    out = None
    for k in range(len(known) - 1, -1, -1):
        met = left.withColumn("context", F.shiftright("gram", 8)).join(known[k], ["lang", "gram"], "left").join(gammas[k], ["lang", "context"], "left")
        met = saved(met, f"met-{k}")
        seen = met.filter("p IS NOT NULL").select("lang", "full", (F.col("weight") * F.col("p")).alias("p"))
        out = seen if out is None else out.unionByName(seen)
        rest = F.col("weight") * F.coalesce("gamma", F.lit(1.0))
        left = met.filter("p IS NULL").select("lang", "full", low_bytes("gram", k).alias("gram"), rest.alias("weight"))
    return out.unionByName(left.select("lang", "full", (F.col("weight") / 256).alias("p")))


def byte_grams(text: bytes, order: int) -> np.ndarray:
    """Every run of order + 1 bytes of a text led in by line breaks, one for each byte."""
    a = np.frombuffer(b"\n" * order + text, np.uint8).astype(np.int64)
    g = a[order:].copy()
    for j in range(1, order + 1):
        g |= a[order - j : len(a) - j] << (8 * j)
    return g


_LOTS = "lot long, doc_id long, own string, langs array<string>, text string, lang string, gram long"


def text_lots(texts: DataFrame, order: int, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Texts (doc_id, own, langs, text) dealt to lots, and once for each lot the (lang, gram) that its texts need.

    A task cuts the texts it reads into lots of about ``lot_bytes``; a longer text is a lot of its own. Texts stay where they are: the table is
    written in buckets of lots, so a later join by lot moves the grams alone. A gram that many texts of a lot hold is one row.
    """
    schema = pa.schema(
        [("lot", pa.int64()), ("doc_id", pa.int64()), ("own", pa.string()), ("langs", pa.list_(pa.string())), ("text", pa.string()), ("lang", pa.string()), ("gram", pa.int64())]
    )

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, held, waiting = 0, 0, 0
        seen: dict[str, np.ndarray] = {}
        fresh: dict[str, list[np.ndarray]] = {}

        def settle() -> None:
            nonlocal waiting
            for lang, found in fresh.items():
                seen[lang] = np.unique(np.concatenate([*found, seen.get(lang, np.empty(0, np.int64))]))
            fresh.clear()
            waiting = 0

        def vocabulary() -> Iterator[pa.RecordBatch]:
            settle()
            for lang, grams in seen.items():
                for at in range(0, len(grams), 100_000):
                    some = grams[at : at + 100_000]
                    yield batch_of(len(some), lot=np.full(len(some), lot), lang=[lang] * len(some), gram=some)
            seen.clear()

        for batch in batches:
            for doc_id, own, langs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lot = (part << 32) + number
                data = text.encode()
                grams = byte_grams(data, order)
                for lang in langs:
                    fresh.setdefault(lang, []).append(grams)
                waiting += len(grams) * len(langs)
                held += len(data)
                yield batch_of(1, lot=[lot], doc_id=[doc_id], own=[own], langs=[langs], text=[text])
                if waiting > 4_000_000:
                    settle()
                if held >= lot_bytes:
                    yield from vocabulary()
                    number, held = number + 1, 0
        if held:
            yield from vocabulary()

    lots = texts.select("doc_id", "own", "langs", "text").mapInArrow(deal, _LOTS)
    spark = texts.sparkSession
    path = shared_path(spark, "text-lots")
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    lots.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "lot").format("parquet").saveAsTable(name)
    return spark.table(name)


def lot_perplexities(lots: DataFrame, cost: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, perplexity) of the texts of lots: each text's grams are looked up in its lot's share of ``cost`` (lang, gram, bits).

    Of the languages of a text the one that fits best counts.
    """

    def score(texts: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        known = {}
        for lang, rows in bits.groupby("lang"):
            at = np.argsort(rows["gram"].to_numpy())
            known[lang] = rows["gram"].to_numpy()[at], rows["bits"].to_numpy()[at]
        out = []
        for langs, text in zip(texts["langs"], texts["text"], strict=True):
            data = text.encode()
            found, n = np.unique(byte_grams(data, order), return_counts=True)
            best = min(float(n @ known[x][1][np.searchsorted(known[x][0], found)]) for x in langs)
            out.append(2.0 ** min(best / len(data), 1000.0))
        return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "lang": texts["own"], "perplexity": np.array(out, float)})

    needed = lots.filter("gram IS NOT NULL").select("lot", "lang", "gram").join(cost, ["lang", "gram"])
    texts = lots.filter("text IS NOT NULL").select("lot", "doc_id", "own", "langs", "text")
    return texts.groupBy("lot").cogroup(needed.select(F.col("lot").alias("of"), "lang", "gram", "bits").groupBy("of")).applyInPandas(score, "doc_id long, lang string, perplexity double")


def _tables(alpha: pd.DataFrame, gamma: pd.DataFrame, order: int) -> PpmModel:
    languages = sorted(alpha["lang"].unique().tolist())
    number = {name: k for k, name in enumerate(languages)}
    model, lower = PpmModel(languages, order), np.full((1, len(languages)), 1 / 256)
    for k in range(order + 1):
        own = alpha[alpha["size"] == k]
        left = gamma[gamma["size"] == k]
        grams, at = np.unique(own["gram"].to_numpy().astype(np.uint64), return_inverse=True)
        contexts, of = np.unique(left["context"].to_numpy().astype(np.uint64), return_inverse=True)
        a, g = np.zeros((len(grams), len(languages))), np.ones((len(contexts), len(languages)))
        a[at, own["lang"].map(number).to_numpy(int)] = own["alpha"].to_numpy()
        g[of, left["lang"].map(number).to_numpy(int)] = left["gamma"].to_numpy()
        if k:
            below = lower[model.grams[k - 1].find(grams & np.uint64((1 << 8 * k) - 1))]
        else:
            below = np.repeat(lower, len(grams), axis=0)
        found = Lookup(contexts)
        lower = a + g[found.find(grams >> np.uint64(8))] * below
        model.grams.append(Lookup(grams))
        model.cost.append(-np.log2(np.maximum(lower, 1e-30)).astype(np.float32))
        model.contexts.append(found)
        model.escape.append(-np.log2(g).astype(np.float32))
    return model


def trusted_half(doc_id: str = "doc_id"):
    """Whether a trusted document is learned from; the others set the thresholds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0


def perplexities(docs: DataFrame, known: list[DataFrame], gammas: list[DataFrame]) -> DataFrame:
    """(doc_id, lang, perplexity): two to the bits a byte of the whole text under its language's model; null without a letter or a model.

    A text of no language, or of one that has no model, takes the model that fits it best. The distinct grams of a lot of texts meet the
    probabilities in a join by gram and go back to their lot; the driver sees the names of the languages.
    """
    order = len(known) - 1
    names = sorted(r.lang for r in known[0].select("lang").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("able", has_letter())
    none = F.lit(None).cast("double").alias("perplexity")
    if not names:
        return rows.select("doc_id", "lang", none)
    every = F.array(*[F.lit(x) for x in names])
    langs = F.when(F.array_contains(every, F.col("lang")), F.array("lang")).otherwise(every)
    lots = text_lots(rows.filter("able").select("doc_id", F.col("lang").alias("own"), langs.alias("langs"), "text"), order)
    wanted = lots.filter("gram IS NOT NULL").select("lang", "gram").distinct()
    cost = probabilities(wanted, known, gammas).select("lang", F.col("full").alias("gram"), (-F.log2("p")).alias("bits"))
    return lot_perplexities(lots, saved(cost, "gram-bits"), order).unionByName(rows.filter("NOT able").select("doc_id", "lang", none))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    order: int = 4,
    quantile: float = 0.99,
    margin: float = 1.5,
) -> DataFrame:
    """Per row: doc_id, perplexity, threshold (of its language) and kept.

    Trusted are documents labelled quality 1. By a hash of the id half of them are learned from, all with a letter and whole. The threshold of a language is ``margin`` times the
    ``quantile`` of the perplexities of all documents of the other half; a language without such documents takes that of all of them.
    A document above its threshold goes, as does a text without a letter (null, empty): its perplexity is null. If nothing is trusted
    every text with a letter stays. Labels that repeat count once; one that says both 0 and 1 is not trusted. A null doc_id has no label.
    Repeated rows are judged alike, other columns are ignored.
    """
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    learned = rows.filter(has_letter() & trusted_half()).join(trusted, "doc_id", "left_semi").select("lang", "text")
    known, gammas = sharded(learned, order)
    scored = saved(perplexities(rows, known, gammas), "scored")

    others = scored.join(trusted, "doc_id", "left_semi").filter(~trusted_half() & F.col("perplexity").isNotNull())
    at = lambda: F.percentile_approx("perplexity", quantile, 100_000) * margin
    limits = others.groupBy("lang").agg(at().alias("own"))
    anywhere = saved(others.agg(at().alias("any")), "threshold").first()["any"]
    out = scored.join(limits, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(anywhere).cast("double")))
    fits = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    texts = F.col("perplexity").isNotNull() if not known[0].isEmpty() else F.lit(True)
    return out.select("doc_id", "perplexity", "threshold", (fits & texts).alias("kept"))
