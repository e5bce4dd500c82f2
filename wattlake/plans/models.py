"""Training, scoring and metrics with MLlib pipelines."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    Imputer,
    NGram,
    OneHotEncoder,
    RegexTokenizer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattlake.functions.text import fold
from wattlake.operators.grouping import top_per_group
from wattlake.plans.textmodels import balanced


def temporal_split(df: DataFrame, date_column: str, test_date: str) -> tuple[DataFrame, DataFrame]:
    """ML05: rows before the date and rows from it on; an empty side is an error."""
    cut = F.lit(test_date).cast("date")
    train, test = df.filter(F.col(date_column) < cut), df.filter(F.col(date_column) >= cut)
    if train.isEmpty() or test.isEmpty():
        raise ValueError(f"temporal split at {test_date} leaves an empty side")
    return train, test


def preprocessor(numeric: list[str], categorical: list[str]) -> list:
    """ML06: impute the median, standardise, index and one-hot encode."""
    stages = [
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_i" for c in numeric]),
        VectorAssembler(inputCols=[f"{c}_i" for c in numeric], outputCol="_num", handleInvalid="keep"),
        StandardScaler(inputCol="_num", outputCol="_std", withMean=True),
    ]
    encoded = []
    for c in categorical:
        stages += [
            StringIndexer(inputCol=c, outputCol=f"{c}_x", handleInvalid="keep"),
            OneHotEncoder(inputCol=f"{c}_x", outputCol=f"{c}_o", handleInvalid="keep"),
        ]
        encoded.append(f"{c}_o")
    return [*stages, VectorAssembler(inputCols=["_std", *encoded], outputCol="features", handleInvalid="keep")]


def _fit(stages: list, rows: DataFrame, columns: list[str]) -> PipelineModel:
    """Fit over the needed columns only, held in memory and on disk while the estimators pass over them."""
    held = rows.select(*dict.fromkeys(columns)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(held)
    finally:
        held.unpersist()


def train_delay(train: DataFrame, numeric: list[str], categorical: list[str], label: str) -> PipelineModel:
    """ML07: boosted trees for delays."""
    model = GBTClassifier(labelCol=label, featuresCol="features", maxDepth=5, maxIter=20, stepSize=0.05, seed=42)
    return _fit([*preprocessor(numeric, categorical), model], train, [*numeric, *categorical, label])


def train_default(train: DataFrame, numeric: list[str], categorical: list[str], label: str) -> PipelineModel:
    """ML07: forest with balanced class weights for defaults."""
    rate = F.avg(F.col(label).cast("double"))
    weights = train.agg(rate.alias("p")).select("p").scalar()
    weighted = train.withColumn(
        "_w", F.when(F.col(label) == 1, F.lit(0.5) / F.greatest(weights, F.lit(1e-6))).otherwise(0.5 / F.greatest(1 - weights, F.lit(1e-6)))
    )
    model = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="_w", numTrees=40, maxDepth=8, seed=42)
    return _fit([*preprocessor(numeric, categorical), model], weighted, [*numeric, *categorical, label, "_w"])


def train_targets(train: DataFrame, numeric: list[str]) -> PipelineModel:
    """ML07: regression of the percentage and a risk classifier over the same features."""
    return _fit(
        [
            *preprocessor(numeric, []),
            GBTRegressor(
                labelCol="target_pct_atingimento", featuresCol="features", predictionCol="pct_previsto", maxDepth=5, maxIter=20, seed=42
            ),
            LogisticRegression(
                labelCol="target_flag_risco", featuresCol="features", maxIter=100, predictionCol="_risk",
                probabilityCol="_risk_probability", rawPredictionCol="_risk_raw",
            ),
        ],
        train,
        [*numeric, "target_pct_atingimento", "target_flag_risco"],
    )


def project_targets(model: PipelineModel, df: DataFrame) -> DataFrame:
    """ML10/ML18: ensemble projection, its status, and the 0.6/0.4 score."""
    risk = vector_to_array("_risk_probability")[1]
    projection = F.col("pct_previsto") * 0.6 + 40.0 * (1 - risk)
    scored = model.transform(df).withColumn("risco", risk)
    return scored.withColumns(
        {
            "projecao_pct": F.round(projection, 1),
            "status_projecao": F.when(projection < 90.0, "EM_RISCO").otherwise("NO_CAMINHO"),
            "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pct_previsto") / 100 * 0.6 + F.col("risco") * 0.4)),
        }
    )


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """ML10: probability of the positive class as ``score``."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def min_max(df: DataFrame, column: str) -> DataFrame:
    """ML10: decision scores scaled to 0..1; the bounds are one aggregated scalar pair."""
    bounds = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("b")).select("b").scalar()
    spread = F.col("_b.hi") - F.col("_b.lo")
    return df.withColumn("_b", bounds).withColumn(
        "score", (F.col(column) - F.col("_b.lo")) / F.when(spread == 0, 1.0).otherwise(spread)
    ).drop("_b")


def anomaly_scores(df: DataFrame, columns: list[str], contamination: float = 0.1) -> DataFrame:
    """ML08: distance to the nearest centre; the farthest share is flagged."""
    stages = [
        VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="keep"),
        StandardScaler(inputCol="_v", outputCol="features", withMean=True),
        KMeans(k=3, seed=42, featuresCol="features", predictionCol="centro"),
    ]
    model = Pipeline(stages=stages).fit(df)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.stages[-1].clusterCenters()])
    own = F.element_at(centres, F.col("centro") + 1)
    squares = F.zip_with(vector_to_array("features"), own, lambda a, b: (a - b) * (a - b))
    scored = model.transform(df).withColumn("distancia", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)))
    cut = scored.agg(F.percentile_approx("distancia", 1 - contamination, 10000).alias("q")).select("q").scalar()
    return min_max(scored.withColumn("is_anomaly", F.col("distancia") > cut), "distancia").drop("_v", "features")


def binary_metrics(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """ML13: recall, precision, F1, accuracy, Brier score and exact AUC in SQL aggregates.

    The AUC is the rank-sum form over distinct scores: scores are first reduced to (score, positives, negatives).
    """
    y, p = F.col(label).cast("double"), F.col(score)
    hit = p >= 0.5
    base = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("pos"),
        F.sum(y * hit.cast("double")).alias("tp"),
        F.sum((1 - y) * hit.cast("double")).alias("fp"),
        F.avg((hit.cast("double") == y).cast("double")).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )
    bins = scored.groupBy(p.alias("s")).agg(F.sum(y).alias("a"), F.sum(1 - y).alias("b"))
    # Score ranges keep the running count distributed: a coarse range first, then inside the range.
    ranged = bins.withColumn("r", F.floor(F.col("s") * 1000))
    per_range = ranged.groupBy("r").agg(F.sum("b").alias("rb"))
    offset = per_range.withColumn("o", F.coalesce(F.sum("rb").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    inside = W.partitionBy("r").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    below = ranged.withColumn("i", F.coalesce(F.sum("b").over(inside), F.lit(0.0))).join(offset.select("r", "o"), "r")
    wins = below.agg(F.sum(F.col("a") * (F.col("o") + F.col("i") + F.col("b") / 2)).alias("w")).select("w").scalar()
    return base.withColumns(
        {
            "auc_roc": F.try_divide(wins, F.col("pos") * (F.col("n") - F.col("pos"))),
            "recall": F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0)),
            "precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)),
        }
    ).withColumn(
        "f1", F.coalesce(F.try_divide(F.col("recall") * F.col("precision") * 2, F.col("recall") + F.col("precision")), F.lit(0.0))
    )


def recall_at_share(scored: DataFrame, label: str, share: float = 0.2, score: str = "score", key: str = "entity_id") -> DataFrame:
    """ML13: share of all positives found in the best-scored rows."""
    from wattlake.plans.features import decile_position

    best = decile_position(scored, share, score, key)
    total = scored.agg(F.sum(F.col(label).cast("double")).alias("p")).select("p").scalar()
    return best.agg(F.sum(F.col(label).cast("double")).alias("hits")).select(
        (F.col("hits") / F.greatest(total, F.lit(1.0))).alias("recall_at_share")
    )


def temporal_folds(df: DataFrame, date_column: str, splits: int = 5) -> DataFrame:
    """ML12: fold index 0..splits by date quantiles; fold k trains on all earlier folds and tests on k.

    The cuts are approximate percentiles of the dates: a few numbers, no global ordered window.
    """
    day = F.datediff(date_column, F.lit("1970-01-01").cast("date"))
    cuts = df.agg(F.percentile_approx(day, [i / (splits + 1) for i in range(1, splits + 1)], 10000).alias("c")).select("c").scalar()
    return df.withColumn("_cuts", cuts).withColumn("fold", F.size(F.filter("_cuts", lambda c: c < day))).drop("_cuts")


def cross_validate(df: DataFrame, date_column: str, label: str, numeric: list[str], splits: int = 5) -> DataFrame:
    """ML12: one fit per expanding fold, metrics united."""
    folded = temporal_folds(df, date_column, splits).select("fold", label, *numeric).persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for k in range(1, splits + 1):
        model = train_default(folded.filter(F.col("fold") < k), numeric, [], label)
        scored = probability(model, folded.filter(F.col("fold") == k))
        row = binary_metrics(scored, label).select(F.lit(k).alias("fold"), "auc_roc", F.col("brier").alias("brier_score"))
        out = row if out is None else out.unionByName(row)
    return out


def text_stages(features: int = 4096) -> list:
    """ML15/TXT05: words and bigrams, hashed counts, inverse document frequency."""
    from pyspark.ml.feature import VectorAssembler as Assembler

    return [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+", minTokenLength=3),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        HashingTF(inputCol="_words", outputCol="_tf1", numFeatures=features),
        HashingTF(inputCol="_pairs", outputCol="_tf2", numFeatures=features),
        Assembler(inputCols=["_tf1", "_tf2"], outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="features", minDocFreq=2),
    ]


def text_counts(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """``columns`` of ``df`` with ``_tf``: the counted words and pairs of its text. Written once, it serves training and prediction."""
    out = df.withColumn("_text", fold(F.col(text)))
    for stage in text_stages()[:-1]:
        out = stage.transform(out)
    return out.select(*columns, "_tf")


def train_text(counts: DataFrame, label: str) -> PipelineModel:
    """ML15: balanced logistic regression over the TF-IDF of ``text_counts``."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep"),
            text_stages()[-1],
            LogisticRegression(labelCol="_label", featuresCol="features", weightCol="_w", maxIter=20),
        ]
    ).fit(balanced(counts, label, "_w"))


def topic_model(df: DataFrame, key: str, text: str, k: int, keep, buckets: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """ML16: hashed TF-IDF and k-means; assignments per key, and per topic its size and five leading terms.

    Every term counts: the hashing has no vocabulary to cut, and leading terms are aggregated over the terms themselves. ``keep(frame)`` writes
    the words, and then the terms of each topic: texts are folded and cut once, and counted once.
    """
    rows = df.withColumn("_text", fold(F.col(text))).filter("_text <> ''")
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+", minTokenLength=3).transform(rows)
    words = keep(words.select(key, "_words"))
    model = Pipeline(
        stages=[
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=buckets),
            IDF(inputCol="_tf", outputCol="features"),
            KMeans(k=k, seed=42, featuresCol="features", predictionCol="topic_id"),
        ]
    ).fit(words)
    placed = model.transform(words)
    assigned = placed.select(key, "topic_id")
    # The words travel once, dealt by key; a task counts those of its keys before terms meet.
    used = placed.repartition(key).select(key, "topic_id", F.explode("_words").alias("termo")).groupBy(key, "topic_id", "termo").agg(F.count(F.lit(1)).alias("tf"))
    used = keep(used.groupBy("topic_id", "termo").agg(F.sum("tf").alias("tf"), F.count(key).alias("df")))
    documents = words.count()
    frequency = used.groupBy("termo").agg(F.sum("df").alias("df"))
    weighed = used.drop("df").join(frequency, "termo").withColumn("peso", F.col("tf") * F.log((documents + 1) / (F.col("df") + 1)))
    top = top_per_group(weighed, ["topic_id"], [F.desc("peso"), F.asc("termo")], 5)
    names = top.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("peso")).alias("p"), "termo"))), lambda x: x["termo"]).alias("keywords"))
    sizes = assigned.groupBy("topic_id").agg(F.count(F.lit(1)).alias("registros"))
    taxonomy = names.join(sizes, "topic_id", "left").withColumn(
        "topic_name", F.concat_ws(" / ", F.slice("keywords", 1, 3))
    )
    return assigned, taxonomy
