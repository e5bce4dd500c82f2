"""Text vectors by truncated singular values, a classifier on expanding time folds, and topics with exemplars."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.functions import taxonomy as tax
from wattlake.functions.text import bounded_example, mask_sensitive, squeeze
from wattlake.operators.grouping import top_per_group
from wattlake.operators.quantiles import order_statistics

ENTRIES = 1 << 16  # matrix entries multiplied at once in a task

# Words without meaning for the topics of complaints.
TOPIC_STOP_WORDS = (
    "a", "acordo", "ao", "aos", "apos", "analise", "apresentada", "as", "base", "celular", "cliente", "clientes", "clt", "com", "conf",
    "conforme", "conta", "da", "das", "de", "demais", "dia", "do", "dos", "dt", "email", "em", "erro", "erro leitura", "entenda", "esta",
    "fat", "fatura", "feito", "foi", "foram", "gmtuk", "ha", "informada", "informacoes", "informacoes que", "informa", "inst", "instalacao",
    "julgar", "julgar necessarias", "leped", "leitura", "lt", "mes", "na", "nas", "nao", "necessarias", "no", "nos", "ordem", "os", "para",
    "pela", "pelo", "periodo", "por", "que", "procedente", "realizado", "realizada", "reclama", "ref", "refs", "referencia", "solicitado",
    "solicita", "seu", "sistema", "sua", "sua conta", "trata", "valor", "voce", "xx",
)


def words_and_pairs(words: Column) -> Column:
    """An array of words followed by its neighbouring pairs, joined by a blank."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b)))


def with_words(rows: DataFrame, text: str, pattern: str = r"(?U)\b\w\w+\b", stop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``_w``: lower-case words of a text without stop words; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))
    if stop:
        found = F.filter(found, lambda w: ~w.isin(*stop))
    return rows.withColumn("_w", found)


def with_terms(rows: DataFrame, text: str, pattern: str = r"(?U)\b\w\w+\b", stop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``_terms``: lower-case words and pairs of words of a text, stop words left out before pairing; null has none."""
    return with_words(rows, text, pattern, stop).withColumn("_terms", words_and_pairs(F.col("_w"))).drop("_w")


@dataclass
class Vocabulary:
    """Terms in the order of their columns with their inverse document frequency. As long as the parameter that limits it."""

    terms: list[str]
    idf: np.ndarray
    rows: int

    @classmethod
    def learn(cls, rows: DataFrame, features: int) -> Vocabulary:
        """The ``features`` terms used most often, by name on ties. One pass counts uses and rows of every term in the tasks that read them."""
        use = lambda a, inside: F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(1 - inside).alias("u"), F.lit(inside).alias("d")))
        both = F.concat(use(F.col("_terms"), 0), use(F.array_distinct("_terms"), 1))
        counts = rows.select(F.explode(both).alias("_e")).groupBy(F.col("_e.t").alias("t")).agg(F.sum("_e.u").alias("u"), F.sum("_e.d").alias("d"))
        total = rows.count()
        best = counts.orderBy(F.desc("u"), "t").limit(features).collect()  # bounded by the parameter
        idf = np.array([np.log((1 + total) / (1 + r["d"])) + 1 for r in best])
        return cls([r["t"] for r in best], idf, total)

    def vectors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features``: uses times inverse document frequency at unit length, sparse; a row without a known term is all zero."""
        terms, idf = (self.terms, self.idf) if self.terms else (["\0"], np.ones(1))
        counted = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_n")
        weighed = ElementwiseProduct(scalingVec=Vectors.dense(idf.tolist()), inputCol="_n", outputCol="_x")
        unit = Normalizer(p=2.0, inputCol="_x", outputCol="features")
        return unit.transform(weighed.transform(counted.transform(rows))).drop("_terms", "_n", "_x")


def entries(vectors: DataFrame, features: str = "features") -> DataFrame:
    """``vectors`` with ``_ids`` and ``_weights`` of the sparse column."""
    raw = F.unwrap_udt(F.col(features))
    return vectors.withColumns({"_ids": raw["indices"], "_weights": raw["values"]})


def _slices(ids: pd.Series, weights: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with entries in runs of about ENTRIES entries: (row numbers, starts, ids, weights)."""
    sizes = np.array([len(i) for i in ids], np.int64)
    kept = np.flatnonzero(sizes)
    if not len(kept):
        return
    run = np.cumsum(sizes[kept]) // ENTRIES
    for rows in np.split(kept, np.flatnonzero(np.diff(run)) + 1):
        n = sizes[rows]
        yield rows, np.cumsum(n) - n, np.concatenate([np.asarray(ids.iloc[r], np.int64) for r in rows]), np.concatenate([np.asarray(weights.iloc[r]) for r in rows])


def gram_product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A times ``basis`` for the matrix A whose rows are (_ids, _weights).

    Each task adds up its own rows and gives back one line per column of A that it saw; the sum over tasks is an aggregation. Only
    columns x rank numbers reach the driver, whatever the number of rows.
    """
    width, rank = basis.shape
    shared = rows.sparkSession.sparkContext.broadcast(basis)  # columns x rank numbers

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, total = shared.value, np.zeros((width, rank))
        for batch in batches:
            for _, starts, ids, weights in _slices(batch["_ids"], batch["_weights"]):
                product = np.add.reduceat(weights[:, None] * q[ids], starts, axis=0)
                sizes = np.diff(np.append(starts, len(ids)))
                order = np.argsort(ids, kind="stable")
                ordered = ids[order]
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                total[ordered[first]] += np.add.reduceat((weights[:, None] * np.repeat(product, sizes, axis=0))[order], first, axis=0)
        seen = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"at": seen, **{f"c{j}": total[seen, j] for j in range(rank)}})

    names = [f"c{j}" for j in range(rank)]
    partial = rows.select("_ids", "_weights").mapInPandas(multiply, "at long, " + ", ".join(f"{c} double" for c in names))
    summed = partial.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((width, rank))
    out[summed["at"].to_numpy(np.int64)] = summed[names].to_numpy()
    return out


def singular_directions(rows: DataFrame, width: int, count: int, dimensions: int = 32, spare: int = 10, rounds: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """TXT05: leading right singular vectors (width x d) and singular values of the matrix of ``rows``, by a randomised range finder.

    A seeded random basis with ``spare`` more directions than wanted is multiplied by A'A ``rounds`` times and made orthonormal each time;
    a small eigenproblem inside its range gives the values. d is at most rows - 1 and width - 1, at least 1. Each direction's largest
    component is positive, so the signs are the same in every run.
    """
    d = max(1, min(dimensions, count - 1, width - 1))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, d + spare))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(gram_product(rows, basis))[0]
    values, inner = np.linalg.eigh(basis.T @ gram_product(rows, basis))
    best = np.argsort(values)[::-1][:d]
    directions = basis @ inner[:, best]
    peaks = directions[np.abs(directions).argmax(axis=0), np.arange(d)]
    return directions * np.where(peaks < 0, -1.0, 1.0), np.sqrt(np.maximum(values[best], 0.0))


def project(rows: DataFrame, directions: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` with ``embedding``: the row along the directions at unit length; all zero for a row without entries."""
    shared, d = rows.sparkSession.sparkContext.broadcast(directions), directions.shape[1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), d))
            for at, starts, ids, weights in _slices(batch["_ids"], batch["_weights"]):
                out[at] = np.add.reduceat(weights[:, None] * shared.value[ids], starts, axis=0)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            yield batch[columns].assign(embedding=list(out / np.where(norms == 0, 1.0, norms)))

    schema = T.StructType([*rows.select(*columns).schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return rows.select(*columns, "_ids", "_weights").mapInPandas(place, schema)


def text_embeddings(rows: DataFrame, text: str, columns: list[str], keep, dimensions: int = 32, features: int = 4096) -> DataFrame:
    """TXT05: ``columns`` and ``embedding`` of every row. ``keep(frame)`` writes the sparse rows once, as each round reads them again."""
    termed = with_terms(rows, text)
    vocabulary = Vocabulary.learn(termed, features)
    sparse = keep(entries(vocabulary.vectors(termed)).select(*columns, "_ids", "_weights"))
    directions, _ = singular_directions(sparse, max(1, len(vocabulary.terms)), vocabulary.rows, dimensions)
    return project(sparse, directions, columns)


# ---- classifier -----------------------------------------------------------------------------------------------
def weak_labels(rows: DataFrame, cause: str, text: str, out: str = "rotulo") -> DataFrame:
    """ML14: ``rows`` with the canonical human label, or the class of the text where there is none; never null."""
    labelled = rows.withColumn("_label", tax.canonical_label(F.col(cause)))
    scored = tax.classify(labelled.withColumn("_t", F.when(F.col("_label").isNull(), F.col(text)).otherwise("")), "_t")
    return scored.withColumn(out, F.coalesce(F.nullif("_label", F.lit("")), "classe", F.lit("indefinido"))).select(*rows.columns, out)


def expanding_folds(rows: DataFrame, date: str, splits: int | None = None) -> DataFrame:
    """ML12/ML15: ``rows`` with ``fold``: 0 is only learned from, fold k is tested after learning from all before it.

    There are min(3, max(2, n // 3)) tests of n // (tests + 1) rows, the first part takes the rest. The cuts are exact positions in the order
    of the dates; rows of one instant stay together, in the fold that starts with it, so nothing is tested at an instant it was learned at. Null dates come first.
    """
    timed = rows.withColumn("_at", F.coalesce(F.unix_micros(F.col(date).cast("timestamp")).cast("double"), F.lit(float(-(1 << 62)))))
    tests = splits or "least(3, greatest(2, floor(n / 3)))"
    first = f"(n - ({tests}) * floor(n / (({tests}) + 1)))"
    most = splits or 3
    positions = {f"c{k}": f"CASE WHEN {k} < {tests} THEN {first} + {k} * floor(n / (({tests}) + 1)) END" for k in range(most)}
    cuts = order_statistics(timed, [], "_at", positions).select(F.array(*positions).alias("c")).select("c").scalar()
    held = timed.withColumn("_cuts", cuts)
    return held.withColumn("fold", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.lit(0))).drop("_cuts", "_at")


def macro_f1(rows: DataFrame, groups: list[str], label: str, predicted: str, out: str = "macro_f1") -> DataFrame:
    """Mean over the classes that occur as label or prediction of 2 tp / (labelled + predicted), from pair counts. Null predictions count as wrong."""
    pairs = rows.groupBy(*groups, F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(*groups, "n", (F.col("_y") == F.col("_p")).alias("_hit"), F.explode(F.array("_y", "_p")).alias("_c")).filter("_c IS NOT NULL")
    per = sides.groupBy(*groups, "_c").agg((F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("_f"))
    return per.groupBy(*groups).agg(F.avg("_f").alias(out), F.count(F.lit(1)).alias("classes"))


def balanced(rows: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    """``rows`` with a label, and ``out``: rows / (classes x rows of the class). The weights travel as one map, so no row moves to its class."""
    classes = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    mean = F.sum("_n") / F.count(F.lit(1))
    entry = F.struct(F.col(label).alias("k"), F.col("_n").alias("v"))
    found = classes.agg(F.struct(mean.alias("mean"), F.map_from_entries(F.collect_list(entry)).alias("n")).alias("_c")).select("_c").scalar()
    return rows.filter(F.col(label).isNotNull()).withColumn("_c", found).withColumn(out, F.col("_c.mean") / F.try_element_at(F.col("_c.n"), F.col(label))).drop("_c")


@dataclass
class TextClassifier:
    """ML15: balanced multinomial regression over text embeddings."""

    classes: list[str]
    model: object

    @staticmethod
    def _learner() -> LogisticRegression:
        return LogisticRegression(labelCol="_y", featuresCol="_v", weightCol="_weight", maxIter=100, regParam=0.001)

    @classmethod
    def fit(cls, rows: DataFrame, label: str) -> TextClassifier:
        """From (embedding, label). Only classes of ``rows`` are ever predicted; a single class is predicted always."""
        indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
        placed = indexer.transform(balanced(rows, label)).select("_y", "_weight", array_to_vector("embedding").alias("_v"))
        return cls(list(indexer.labels), cls._learner().fit(placed) if len(indexer.labels) > 1 else None)

    def predict(self, rows: DataFrame, out: str = "classe", best: int = 3) -> DataFrame:
        """``rows`` with the likeliest class, its probability and the ``best`` first (class, probability)."""
        names = F.array(*[F.lit(c) for c in self.classes])
        if self.model is None:
            chances = F.array(F.lit(1.0))
            scored = rows
        else:
            scored = self.model.transform(rows.withColumn("_v", array_to_vector("embedding")))
            chances = vector_to_array("probability")
        ranked = F.slice(F.array_sort(F.zip_with(names, chances, lambda c, p: F.struct((-p).alias("k"), c.alias("classe")))), 1, best)
        top = scored.withColumn("top3", F.transform(ranked, lambda e: F.struct(e["classe"].alias("classe"), (-e["k"]).alias("probabilidade"))))
        return top.withColumns({out: F.col("top3")[0]["classe"], "probabilidade": F.col("top3")[0]["probabilidade"]}).select(*rows.columns, out, "probabilidade", "top3")


def fold_predictions(rows: DataFrame, label: str, tests: int = 3) -> DataFrame:
    """Rows of the tested folds with ``classe``, predicted from all earlier folds. ``rows`` (fold, embedding, label) is a written table.

    A fold without earlier rows, or without rows, gives none.
    """
    out = None
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most four rows
    for k in range(1, tests + 1):
        if not sizes.get(k) or not sum(n for f, n in sizes.items() if f < k):
            continue
        found = TextClassifier.fit(rows.filter(F.col("fold") < k), label).predict(rows.filter(F.col("fold") == k))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.limit(0).withColumn("classe", F.lit(None).cast("string"))


def fold_sizes(rows: DataFrame, label: str) -> DataFrame:
    """(fold, treino, teste, classes): how many rows each test learns from and is made on, and the classes it holds."""
    per = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("teste"), F.count_distinct(label).alias("classes"))
    before = per.select(F.col("fold").alias("_f"), F.col("teste").alias("_n"))
    joined = per.filter("fold > 0").join(before, F.col("_f") < F.col("fold"), "left")  # at most four rows a side
    return joined.groupBy("fold", "teste", "classes").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("treino"))


def fold_scores(rows: DataFrame, label: str) -> DataFrame:
    """ML15: macro-F1 of every tested fold next to its sizes."""
    return fold_sizes(rows, label).join(macro_f1(fold_predictions(rows, label), ["fold"], label, "classe").drop("classes"), "fold", "left")


# ---- topics ---------------------------------------------------------------------------------------------------
def topic_count(rows: int, smallest: int = 20, most: int = 8) -> int:
    """How many topics so many rows have: one for every ``smallest`` rows, at most ``most``, at least one."""
    return max(1, min(most, rows, max(1, rows // max(smallest, 1))))


def centres(rows: DataFrame, group: str, ids: str = "_ids", weights: str = "_weights") -> DataFrame:
    """(group, size, at, peso): mean of every component of a group's rows, over all its rows; components never used are absent."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    sums = rows.select(group, F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(weights).alias("w"))).alias("_e")).groupBy(group, F.col("_e.i").alias("at")).agg(F.sum("_e.w").alias("_s"))
    return sizes.join(sums, group).select(group, "size", "at", (F.col("_s") / F.col("size")).alias("peso"))


def exemplars(rows: DataFrame, group: str, key: str, middle: DataFrame, k: int = 3) -> DataFrame:
    """(group, rank, key, distancia): the ``k`` rows of a group nearest to its centre, by key on ties.

    A centre travels as one array a group, as long as its last component; tasks keep k rows of a group before the shuffle, so a group may hold any share of the rows.
    """
    mapped = middle.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "peso"))).alias("_m"), F.max("at").cast("int").alias("_last"),
        F.sum(F.col("peso") * F.col("peso")).alias("_norm"),
    )
    # By position: a map would be searched from its start for every component of every row.
    dense = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    mapped = mapped.select(group, dense.alias("_centre"), "_norm")
    near = rows.join(mapped, group)
    cross = F.aggregate(
        F.zip_with("_ids", "_weights", lambda i, w: w * (w - 2 * F.coalesce(F.get("_centre", i), F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x
    )
    measured = near.select(group, key, F.sqrt(F.greatest(F.col("_norm") + cross, F.lit(0.0))).alias("distancia"))
    return top_per_group(measured, [group], [F.asc("distancia"), F.asc(key)], k)


def topics(rows: DataFrame, key: str, text: str, keep, features: int = 2048, smallest: int = 20, most: int = 8, stop: tuple[str, ...] = TOPIC_STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """ML16: (assignments, taxonomy) of texts whose sensitive parts are masked.

    Assignments hold every row: ``key``, ``topic_id``. The taxonomy has a row per topic: its size, five leading terms, a name of the first three,
    and three masked examples, the rows nearest to the centre. The number of topics follows from the number of rows. ``keep(frame)`` writes the
    vectors once. Texts without a known term are all-zero rows of some topic.
    """
    plain = squeeze(F.regexp_replace(mask_sensitive(F.col(text)), r"\[[A-Z_]+\]", " "))
    words = with_words(rows.select(key, plain.alias("_plain")), "_plain", r"\b[a-zA-Z_][a-zA-Z_]{2,}\b", stop).drop("_plain")
    termed = keep(words).withColumn("_terms", words_and_pairs(F.col("_w"))).drop("_w")  # texts are masked and cut once
    vocabulary = Vocabulary.learn(termed, features)
    vectors = keep(vocabulary.vectors(termed.select(key, "_terms")))
    number = topic_count(vocabulary.rows, smallest, most)
    if number == 1:
        placed = vectors.withColumn("topic_id", F.lit(0))
    else:
        placed = KMeans(k=number, seed=42, maxIter=30, featuresCol="features", predictionCol="topic_id").fit(vectors).transform(vectors)
    held = keep(entries(placed).select(key, "topic_id", "_ids", "_weights"))
    middle = keep(centres(held, "topic_id"))
    names = F.array(*[F.lit(t) for t in vocabulary.terms]) if vocabulary.terms else F.array(F.lit(""))
    leading = top_per_group(middle.withColumn("termo", F.get(names, F.col("at"))), ["topic_id"], [F.desc("peso"), F.asc("termo")], 5)
    words = leading.filter("peso > 0").groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "termo"))).alias("_l")).select(
        "topic_id", F.transform("_l", lambda e: F.regexp_replace(e["termo"], " ", "_")).alias("_k")
    ).select("topic_id", F.filter("_k", lambda w: ~w.isin(*stop) if stop else F.lit(True)).alias("keywords"))
    nearest = exemplars(held, "topic_id", key, middle).join(rows.select(key, bounded_example(F.col(text)).alias("_text")), key)
    examples = nearest.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_text"))).alias("_l")).select("topic_id", F.col("_l._text").alias("examples"))
    sizes = held.groupBy("topic_id").agg(F.count(F.lit(1)).alias("topic_size"))
    some = F.array().cast("array<string>")
    taxonomy = sizes.join(words, "topic_id", "left").join(examples, "topic_id", "left").select(
        "topic_id", "topic_size", F.coalesce("keywords", some).alias("keywords"), F.coalesce("examples", some).alias("examples")
    )
    name = F.coalesce(F.nullif(F.concat_ws("_", F.slice("keywords", 1, 3)), F.lit("")), F.concat(F.lit("topico_"), F.col("topic_id")))
    return held.select(key, "topic_id"), taxonomy.withColumn("topic_name", name)
