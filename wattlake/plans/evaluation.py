"""Retrieval and answer metrics over case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.operators.quantiles import linear_percentiles

CITATION = r"(?i)\[fonte:\s*([^\]]+)\]"
REFUSAL = (
    r"(?iu)(apenas sobre as regionais|somente ce e sp|não encontrei essa informação|não há dados indexados)"
)


def _lower(x: Column) -> Column:
    return F.transform(x, lambda v: F.lower(v))


def recall_at(retrieved: Column, expected: Column, k: int) -> Column:
    """EV01."""
    want = F.array_distinct(_lower(expected))
    hits = F.size(F.array_intersect(want, F.slice(_lower(retrieved), 1, max(k, 1))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.greatest(F.size(want), F.lit(1)))


def mrr(retrieved: Column, expected: Column) -> Column:
    """EV02."""
    want = _lower(expected)
    marked = F.transform(_lower(retrieved), lambda v, i: F.when(F.array_contains(want, v), i + 1))
    first = F.array_min(F.array_compact(marked))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.coalesce(F.lit(1.0) / first, F.lit(0.0)))


def ndcg_at(retrieved: Column, expected: Column, k: int) -> Column:
    """EV03."""
    want = F.array_distinct(_lower(expected))
    window = F.slice(_lower(retrieved), 1, max(k, 1))
    gains = F.transform(window, lambda v, i: F.when(F.array_contains(want, v), 1.0).otherwise(0.0) / F.log2(i + 2.0))
    ideal = F.least(F.size(want), F.size(window))
    best = F.aggregate(F.when(ideal > 0, F.sequence(F.lit(1), ideal)).otherwise(F.array()), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    total = F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)
    return F.when(F.size(expected) == 0, 1.0).when(best == 0, 0.0).otherwise(total / best)


def citation_accuracy(answer: Column, expected: Column) -> Column:
    """EV04: share of expected sources found in the citations, substring either way."""
    cites = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda c: F.lower(F.trim(c)))
    hits = F.filter(expected, lambda e: F.exists(cites, lambda c: F.contains(c, F.lower(F.trim(e))) | F.contains(F.lower(F.trim(e)), c)))
    return (
        F.when(F.size(expected) == 0, F.when(F.size(cites) == 0, 1.0).otherwise(0.0))
        .when(F.size(cites) == 0, 0.0)
        .otherwise(F.size(hits) / F.size(expected))
    )


def refused(answer: Column) -> Column:
    return answer.rlike(REFUSAL)


def exactness(answer: Column, expected: Column, forbidden: Column) -> Column:
    """EV07: expected words present and forbidden words absent."""
    text = F.lower(answer)
    share = lambda ws, empty: F.when(F.size(ws) == 0, empty).otherwise(
        F.size(F.filter(ws, lambda w: F.contains(text, F.lower(w)))) / F.greatest(F.size(ws), F.lit(1))
    )
    return (share(expected, 1.0) + 1.0 - share(forbidden, 0.0)) / 2.0


def compliant(regions: Column, allowed: tuple[str, ...] = ("CE", "SP", "CE+SP")) -> Column:
    """EV06."""
    return F.forall(regions, lambda r: r.isin(*allowed))


def pair_metrics(ranked: DataFrame, expected: DataFrame, key: str, source: str, position: str = "posicao") -> DataFrame:
    """EV01-EV03, EV08 from rows: recall at 5, reciprocal rank and gain at 10 of every case of ``ranked`` (key, source, position from 1).

    ``expected`` (key, source) may hold any number of sources for a case: it is joined and counted, never gathered, and repeated pairs count once. A case without expected sources scores 1 everywhere.
    """
    pairs = expected.select(key, source).distinct()
    hits = ranked.select(key, source, position).join(pairs, [key, source], "left_semi")
    at = F.col(position)
    found = hits.filter(at <= 10).groupBy(key).agg(
        F.count_if(at <= 5).alias("_h"), F.min(position).alias("_first"), F.sum(F.lit(1.0) / F.log2(at + 1.0)).alias("_gain")
    )
    shown = ranked.groupBy(key).agg(F.count_if(at <= 10).alias("_shown"))
    cases = shown.join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("esperados")), key, "left").join(found, key, "left").na.fill(0, ["esperados", "_h", "_gain"])
    steps = F.array(*[F.lit(1.0) / F.log2(F.lit(i + 1.0)) for i in range(1, 11)])
    ideal = F.least(F.col("esperados"), F.col("_shown")).cast("int")
    best = F.aggregate(F.slice(steps, F.lit(1), ideal), F.lit(0.0), lambda a, x: a + x)
    none = F.col("esperados") == 0
    return cases.select(
        key, "esperados", F.when(none, 1.0).otherwise(F.round(F.col("_h") / F.greatest("esperados", F.lit(1)), 4)).alias("recall_5"),
        F.when(none, 1.0).otherwise(F.round(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)), 4)).alias("mrr_10"),
        F.when(none, 1.0).when(best == 0, 0.0).otherwise(F.round(F.try_divide("_gain", best), 4)).alias("ndcg_10"),
    )


def score_cases(cases: DataFrame) -> DataFrame:
    """EV08: one row per case with every metric."""
    return cases.withColumns(
        {
            "recall_5": F.round(recall_at(F.col("retrieved"), F.col("expected"), 5), 4),
            "mrr_10": F.round(mrr(F.slice("retrieved", 1, 10), F.col("expected")), 4),
            "ndcg_10": F.round(ndcg_at(F.col("retrieved"), F.col("expected"), 10), 4),
        }
    )


def answer_summary(cases: DataFrame) -> DataFrame:
    """EV05: correct refusals, and share of answerable cases that were not refused."""
    said = F.coalesce(refused(F.col("answer")), F.lit(False))
    must = F.col("must_refuse")
    return cases.agg(
        F.count(F.lit(1)).alias("casos"),
        F.coalesce(F.avg((said == must).cast("double")), F.lit(0.0)).alias("refusal_rate"),
        F.coalesce(F.avg(F.when(~must, (~said).cast("double"))), F.lit(1.0)).alias("fallback_guardrail_success"),
    )


def latency_summary(rows: DataFrame, group: str, latency: str) -> DataFrame:
    """EV09: rows, mean, median and 95th percentile per group, exact and without gathering a group."""
    base = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(latency), 3).alias("media"))
    quantiles = linear_percentiles(rows, [group], latency, {"p50": 0.5, "p95": 0.95})
    return base.join(quantiles, group).withColumns({c: F.round(c, 3) for c in ("p50", "p95")})


def critique(answers: DataFrame) -> DataFrame:
    """EV10: rule verdict of an answer with recommended boosts."""
    q, a = F.lower("question"), F.lower("answer")
    private = q.contains("telefone") | q.contains("cpf") | q.contains("endereço")
    refusal = a.contains("sinto muito") | a.contains("não posso") | a.contains("anonimizados")
    region = F.when(q.contains("sp"), "sp").when(q.contains("ce"), "ce")
    sourced = F.exists("sources", lambda s: F.contains(F.lower(s), F.concat(region, F.lit("-"))) | F.contains(F.lower(s), F.concat(region, F.lit("_"))))
    partial = region.isNotNull() & ~F.coalesce(sourced, F.lit(False))
    kind = "array<struct<card_id:string,delta:double>>"
    boost = lambda *pairs: F.array(*[F.struct(F.lit(c).alias("card_id"), F.lit(d).alias("delta")) for c, d in pairs])
    return answers.withColumns(
        {
            "verdict": F.when(partial, "parcial").when(private & refusal, "recusa_correta").when(private, "falha").otherwise("ok"),
            "factual_correctness": F.when(partial, 0.6).when(private & ~refusal, 0.0).otherwise(1.0),
            "recommended_boosts": F.when(
                partial & (region == "sp"), boost(("sp-n1-assuntos", 0.15), ("sp-n1-causas", 0.10))
            ).when(
                partial, boost(("ce-reclamacoes-totais-assuntos", 0.15), ("ce-reclamacoes-totais-causas", 0.10))
            ).otherwise(F.array().cast(kind)),
        }
    )
