"""Telemetry and feedback mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.functions.tables import any_of
from wattlake.operators.dedup import latest_wins
from wattlake.operators.grouping import top_by
from wattlake.operators.quantiles import linear_percentiles, lower_percentiles

# Words of invoice and meter questions.
INVOICE_TERMS = (
    "fatura", "medidor", "leitura", "digital", "analógic", "analogic", "ciclom", "consumo", "refatur", "valor",
)
SCHEMA = (
    "ts timestamp, provider string, model string, question_hash string, question_preview string, intent_class string, "
    "n_passages int, prompt_tokens int, completion_tokens int, cache_hit boolean, latency_first_token_ms double, "
    "latency_total_ms double, region_detected string, region_of_passages array<string>, out_of_regional_scope boolean, "
    "golden_case_id string, cost_usd_estimated double, feedback string, extra map<string,string>"
)


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """SRC21: last up or down rating per question."""
    rows = feedback.withColumn("rating", F.lower(F.trim("rating"))).filter(
        F.col("rating").isin("up", "down") & (F.coalesce("question_hash", F.lit("")) != "")
    )
    return rows.groupBy("question_hash").agg(F.max_by("rating", F.struct("timestamp", "rating")).alias("rating"))


def last_events(events: DataFrame) -> DataFrame:
    """SRC22: last event per question."""
    return latest_wins(events.filter("question_hash IS NOT NULL"), ["question_hash"], [F.col("ts")])


def misses(events: DataFrame) -> DataFrame:
    return events.filter(~F.coalesce("cache_hit", F.lit(False)) & (F.coalesce("provider", F.lit("")) != "stub"))


def about_invoices(events: DataFrame) -> DataFrame:
    return events.filter(F.lower(F.coalesce("question_preview", F.lit(""))).rlike(any_of(INVOICE_TERMS)))


def overview(events: DataFrame) -> DataFrame:
    """TL01: turns, unique questions, hit rate, misses, and the invoice share of misses."""
    lost = ~F.coalesce("cache_hit", F.lit(False)) & (F.coalesce("provider", F.lit("")) != "stub")
    topic = F.lower(F.coalesce("question_preview", F.lit(""))).rlike(any_of(INVOICE_TERMS))
    return events.agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct("question_hash").alias("unique_hashes"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.round(F.count_if("cache_hit") / F.count(F.lit(1)), 4).alias("cache_hit_rate"),
        F.count_if(lost).alias("miss_count"), F.count_if(topic).alias("invoice_total"),
        F.count_if(topic & lost).alias("invoice_misses"),
        F.round(F.count_if(topic & lost) / F.greatest(F.count_if(lost), F.lit(1)), 3).alias("invoice_share_of_misses"),
    )


def latency(events: DataFrame, group: str) -> DataFrame:
    """TL01: median and lower-index p95/p99 with the maximum of the misses per group."""
    rows = misses(events).withColumn("latency_total_ms", F.coalesce("latency_total_ms", F.lit(0.0)))
    base = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("latency_total_ms"), 2).alias("max"))
    median = linear_percentiles(rows, [group], "latency_total_ms", {"p50": 0.5})
    tail = lower_percentiles(rows, [group], "latency_total_ms", {"p95": 0.95, "p99": 0.99})
    return base.join(median, group).join(tail, group).withColumns({c: F.round(c, 2) for c in ("p50", "p95", "p99")})


def slowest(events: DataFrame, limit: int = 10) -> DataFrame:
    """TL01."""
    return (
        events.orderBy(F.desc("latency_total_ms"), "question_hash", "ts").limit(limit)
        .select(
            F.substring("question_preview", 1, 80).alias("preview"), F.round("latency_total_ms", 0).alias("latency_ms"),
            F.col("intent_class").alias("intent"), F.col("region_detected").alias("region"),
        )
    )


def candidates(events: DataFrame, feedback: DataFrame, min_repeats: int = 3) -> DataFrame:
    """TL02/JN20: repeated questions without a down vote, with their newest event."""
    rows = events.filter((F.coalesce("provider", F.lit("")) != "stub") & (F.char_length(F.trim("question_preview")) >= 20))
    voted = rows.join(valid_feedback(feedback), "question_hash", "left")
    return (
        voted.groupBy(F.trim("question_preview").alias("preview"))
        .agg(
            F.count(F.lit(1)).alias("repeticoes"),
            F.max(F.coalesce(F.col("rating") == "down", F.lit(False))).alias("_down"),
            F.max_by(F.struct("intent_class", "region_detected"), F.struct("ts", "question_hash")).alias("s"),
        )
        .filter(~F.col("_down") & (F.col("repeticoes") >= min_repeats))
        .select("preview", "repeticoes", "s.intent_class", "s.region_detected")
    )


def bottlenecks(events: DataFrame) -> DataFrame:
    """TL03: one row per recommendation that applies."""
    stats = overview(events)
    p95 = lower_percentiles(misses(events), [], "latency_total_ms", {"p95": 0.95}).select("p95").scalar()
    checks = F.array(
        F.when(F.col("cache_hit_rate") < 0.30, "low_cache_hit_rate"),
        F.when(F.coalesce(p95, F.lit(0.0)) > 60_000, "slow_misses"),
        F.when(F.col("invoice_share_of_misses") >= 0.20, "invoice_questions_dominate"),
    )
    return stats.select(F.explode(F.array_compact(checks)).alias("recomendacao"), "turns")


def gaps(events: DataFrame, feedback: DataFrame, limit: int = 10) -> DataFrame:
    """TL05: most frequent uncached questions that were not voted down."""
    down = valid_feedback(feedback).filter("rating = 'down'").select("question_hash")
    rows = last_events(events).filter(~F.coalesce("cache_hit", F.lit(False))).join(down, "question_hash", "left_anti")
    return top_by(rows.groupBy("question_preview").agg(F.count(F.lit(1)).alias("n")), limit, "n", "question_preview")


def new_cache_entries(events: DataFrame, existing: DataFrame, min_tokens: int = 20) -> DataFrame:
    """TL05: uncached questions with a usable answer that the dynamic cache lacks."""
    rows = last_events(events).filter(
        ~F.coalesce("cache_hit", F.lit(False)) & (F.col("completion_tokens") > min_tokens) & (F.col("question_preview") != "")
    )
    fresh = rows.join(existing.select("question_preview").distinct(), "question_preview", "left_anti")
    return fresh.groupBy("question_preview").agg(
        F.max_by(F.struct("intent_class", "region_detected"), F.struct("ts", "question_hash")).alias("s")
    ).select("question_preview", "s.intent_class", "s.region_detected")


def triplets(events: DataFrame, feedback: DataFrame, anchors: DataFrame) -> DataFrame:
    """TL04: positive and negative anchor text per question with a weight by rating.

    The other anchor is picked by a seeded hash among the numbered anchors, so no question meets all anchors.
    ``anchors`` has (anchor, texto, numero) with numbers 0..n-1.
    """
    total = anchors.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    rated = last_events(events).join(valid_feedback(feedback), "question_hash", "left")
    own = rated.join(anchors.select("anchor", "numero", F.col("texto").alias("_own")), "anchor")
    step = F.pmod(F.xxhash64("question_hash", F.lit(42)), F.greatest(total - 1, F.lit(1))) + 1
    other = anchors.select(F.col("numero").alias("_o"), F.col("texto").alias("_other"))
    joined = own.withColumn("_o", F.pmod(F.col("numero") + step, total)).join(other, "_o")
    down = F.coalesce(F.col("rating") == "down", F.lit(False))
    return joined.select(
        F.col("question_preview").alias("query"),
        F.substring(F.when(down, F.col("_other")).otherwise(F.col("_own")), 1, 800).alias("positive"),
        F.substring(F.when(down, F.col("_own")).otherwise(F.col("_other")), 1, 800).alias("negative"),
        F.when(down | (F.col("rating") == "up") | F.col("cache_hit"), 1.0).otherwise(0.5).alias("weight"),
    )


def positive_cache(critiques: DataFrame, questions: DataFrame, min_rounds: int = 1) -> DataFrame:
    """TL06/JN21: questions judged fine in enough rounds."""
    text = F.trim(F.regexp_replace(F.lower("question"), r"\s+", " "))
    ok = critiques.filter("verdict = 'ok'").join(questions.select("id", "question", "gold_answer"), "id")
    keyed = ok.withColumn("normalized_question", text).withColumn("hash", F.sha2("normalized_question", 256))
    return (
        keyed.groupBy("hash", "normalized_question")
        .agg(F.countDistinct("round").alias("rounds"), F.max_by("gold_answer", F.struct("round", "id")).alias("answer"))
        .filter(F.col("rounds") >= min_rounds)
    )


def cache_lookup(questions: DataFrame, cache: DataFrame, qkey: str, text: str) -> DataFrame:
    """TXT13: first of three digests found in the cache, by equi-join."""
    from wattlake.functions.questions import candidate_digests

    tried = questions.select(qkey, F.posexplode(candidate_digests(F.col(text))).alias("tentativa", "digest"))
    keys = cache.select("entry_id", F.explode(F.array("token_hash", "hash")).alias("digest")).distinct()
    return tried.join(keys, "digest").groupBy(qkey).agg(F.min(F.struct("tentativa", "entry_id")).alias("m")).select(
        qkey, "m.tentativa", "m.entry_id"
    )
