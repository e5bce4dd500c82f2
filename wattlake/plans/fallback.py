"""Labels for rows that the rules leave undefined, learned from the rows they classify."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.functions.text import fold, tokens


def word_model(counts: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """PRJ26: multinomial model with add-one smoothing: (label, rows, words) per class and (termo, label, n) per word and class.

    ``counts`` has rows (key, termo, tf), ``labels`` (key, label). A word that most rows hold is summed in the tasks that read it.
    """
    used = counts.join(labels, key).groupBy("termo", label).agg(F.sum("tf").alias("n"))
    return class_sizes(labels, used, label), used


def class_sizes(labels: DataFrame, used: DataFrame, label: str) -> DataFrame:
    """(label, rows, words) per class; a class may have rows without a word."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("registros"))
    words = used.groupBy(label).agg(F.sum("n").alias("palavras"))
    return sizes.join(words, label, "left").na.fill(0, ["palavras"])


def word_scores(counts: DataFrame, rows: DataFrame, model: tuple[DataFrame, DataFrame], key: str, label: str) -> DataFrame:
    """(key, label, score): log-probability of every class for each row of ``rows`` (key, tamanho).

    Words a class never had contribute the same each, so only (word, class) pairs that were counted are joined. The classes are few: one array.
    """
    classes, used = model
    vocabulary = used.agg(F.count_distinct("termo").alias("v")).select("v").scalar()
    total = classes.agg(F.sum("registros").alias("t")).select("t").scalar()
    listed = classes.agg(F.sort_array(F.collect_list(F.struct(label, "registros", "palavras"))).alias("c")).select("c").scalar()
    every = rows.select(key, "tamanho", F.explode(listed).alias("_c"))
    base = F.log(F.col("_c.registros") / total) - F.col("tamanho") * F.log(F.col("_c.palavras") + vocabulary)
    found = counts.join(used, "termo").groupBy(key, label).agg(F.sum(F.col("tf") * F.log(F.col("n") + 1.0)).alias("_s"))
    open_ = every.select(key, F.col(f"_c.{label}").alias(label), base.alias("_b"))
    return open_.join(found, [key, label], "left").select(key, label, F.round(F.col("_b") + F.coalesce("_s", F.lit(0.0)), 6).alias("score"))


def best_label(scores: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, confianca): the likeliest class, the first by name on ties, and its share of the probability."""
    top = scores.groupBy(key).agg(F.max("score").alias("_m"))
    near = scores.join(top, key)
    return near.groupBy(key).agg(
        F.min(F.when(F.col("score") == F.col("_m"), F.col(label))).alias(label), (F.lit(1.0) / F.sum(F.exp(F.col("score") - F.col("_m")))).alias("confianca")
    )


def held_out(key: Column) -> Column:
    """A fifth of the rows, by key."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(5)) == 0


def counted(docs: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """Rows (key, label, termo, tf)."""
    words = docs.select(key, label, F.explode(tokens(F.col(text))).alias("termo"))
    return words.groupBy(key, label, "termo").agg(F.count(F.lit(1)).alias("tf"))


def fallback_labels(
    rows: DataFrame, key: str, text: str, label: str, undefined: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> DataFrame:
    """PRJ26: per row the class of the rules, and for every row they leave undefined the likeliest class with its confidence.

    The model learns from the classified rows that are not held out, and is also asked about those that are, so that its agreement with the rules can be
    measured (``conferido``, ``previsto``). Rows without a word take the commonest class; null text has no word. Keys are unique.

    ``keep`` may write an intermediate under a name and read it back: the model, the sizes and the scores all read the word counts, which are otherwise counted
    anew for each. Rows are dealt by key before their words are counted, so a row's words lie together and its sums need no shuffle of words.
    """
    folded = rows.select(key, F.col(label).alias("classe"), F.col(text).alias("_t")).repartition(key)
    folded = folded.withColumn("_t", fold(F.coalesce("_t", F.lit(""))))
    counts = keep(counted(folded, key, "classe", "_t"), "counts")
    lengths = counts.groupBy(key).agg(F.sum("tf").alias("tamanho"))
    sized = keep(rows.select(key, F.col(label).alias("classe")).join(lengths, key, "left").na.fill(0, ["tamanho"]), "sizes")
    known, test = F.col("classe") != undefined, held_out(F.col(key))
    learned = known & ~test
    used = keep(counts.filter(learned).groupBy("termo", F.col("classe").alias("rotulo")).agg(F.sum("tf").alias("n")), "model")
    model = class_sizes(sized.filter(learned).select(key, F.col("classe").alias("rotulo")), used, "rotulo"), used
    asked = ~known | test
    scores = word_scores(counts.filter(asked).select(key, "termo", "tf"), sized.filter(asked).select(key, "tamanho"), model, key, "rotulo")
    found = best_label(keep(scores, "scores"), key, "rotulo")
    out = sized.select(key, "classe").join(found, key, "left")
    return out.select(
        key, "classe", F.when(known, F.col("classe")).otherwise(F.coalesce("rotulo", F.lit(undefined))).alias("rotulo"),
        F.when(known, 1.0).otherwise(F.coalesce("confianca", F.lit(0.0))).alias("confianca"),
        F.when(known & test, F.col("rotulo") == F.col("classe")).alias("conferido"), F.when(known & test, F.col("rotulo")).alias("previsto"),
    )


def coverage(labelled: DataFrame, undefined: str) -> DataFrame:
    """SNK16: undefined rows before and after, and how often the model agrees with the rules on rows it did not learn from."""
    return labelled.agg(
        F.count(F.lit(1)).alias("registros"), F.count_if(F.col("classe") == undefined).alias("indefinidos_antes"),
        F.count_if(F.col("rotulo") == undefined).alias("indefinidos_depois"), F.count("conferido").alias("conferidos"),
        F.count_if("conferido").alias("concordantes"),
    )
