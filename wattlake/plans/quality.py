"""Expectations, reconciliation, alerts and fingerprints."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """One rule; ``kind`` is row_count, not_null, in_set, between or unique."""

    kind: str
    column: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    critical: bool = False

    @property
    def label(self) -> str:
        return self.kind if self.column is None else f"{self.kind}:{self.column}"

    def failures(self) -> Column:
        """Aggregate that counts violations (for row_count: rows short of the bound)."""
        o = self.options
        if self.kind == "row_count":
            return F.greatest(F.lit(o["greater_than"] + 1) - F.count(F.lit(1)), F.lit(0))
        c = F.col(self.column)
        if self.kind == "not_null":
            return F.count_if(c.isNull())
        if self.kind == "in_set":
            return F.count_if(~c.isin(*o["values"]))
        if self.kind == "between":
            low = c < o["min"] if "min" in o else F.lit(False)
            high = c > o["max"] if "max" in o else F.lit(False)
            return F.count_if(low | high)
        if self.kind == "unique":
            return F.count(c) - F.countDistinct(c)
        raise ValueError(f"unknown expectation: {self.kind}")


# Suites per table.
SUITES: dict[str, tuple[Expectation, ...]] = {
    "bronze_notas_operacionais": (
        Expectation("row_count", options={"greater_than": 100}, critical=True),
        Expectation("not_null", "_run_id", critical=True),
        Expectation("not_null", "_ingested_at", critical=True),
    ),
    "bronze_entregas_fatura": (
        Expectation("row_count", options={"greater_than": 100}, critical=True),
        Expectation("not_null", "cod_entrega", critical=True),
    ),
    "bronze_pagamentos": (
        Expectation("row_count", options={"greater_than": 100}, critical=True),
        Expectation("not_null", "cod_pagamento", critical=True),
    ),
    "silver_notas_operacionais": (
        Expectation("not_null", "cod_nota", critical=True),
        Expectation("not_null", "classificacao_acf_asf", critical=True),
        Expectation(
            "in_set", "classificacao_acf_asf",
            {"values": ["ACF_A", "ACF_B", "ACF_C", "ASF_RISCO", "ASF_FORA_RISCO"]}, True,
        ),
        Expectation(
            "in_set", "status_atraso",
            {"values": ["NO_PRAZO", "ATRASADO", "PENDENTE_NO_PRAZO", "PENDENTE_FORA_PRAZO", "SEM_PREVISAO"]}, True,
        ),
    ),
    "silver_entregas_fatura": (
        Expectation("between", "distancia_metros", {"min": 0, "max": 50000}),
        Expectation("not_null", "cod_entrega", critical=True),
    ),
    "silver_pagamentos": (
        Expectation("not_null", "cod_pagamento", critical=True),
        Expectation("between", "valor_fatura", {"min": 0.01}, True),
    ),
}


def evaluate(df: DataFrame, suite: str, expectations: tuple[Expectation, ...]) -> DataFrame:
    """DQ01-DQ05, DQ09, DQ11: all rules of a table in one aggregation, one row per rule."""
    aggregates = [e.failures().cast("long").alias(f"e{i}") for i, e in enumerate(expectations)]
    rows = F.array(
        *[
            F.struct(
                F.lit(suite).alias("suite"), F.lit(e.label).alias("expectation"), F.lit(e.critical).alias("critical"),
                F.col(f"e{i}").alias("failures"), (F.col(f"e{i}") == 0).alias("success"),
            )
            for i, e in enumerate(expectations)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """JN01/DQ10: child keys without a parent, reduced to (key, rows) before the anti join."""
    keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("chave")).agg(F.count(F.lit(1)).alias("linhas"))
    return keys.join(parent.select(F.col(pk).alias("chave")), "chave", "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return orphans(child, parent, fk, pk).agg(F.coalesce(F.sum("linhas"), F.lit(0)).alias("orfaos"))


# Tolerated relative difference per layer pair.
LAYER_THRESHOLDS = {"bronze_to_silver": 0.05, "silver_to_gold": 0.10}


def reconcile(source: DataFrame, target: DataFrame, layer_pair: str, table: str) -> DataFrame:
    """DQ06: both counts, difference and status in one lazy row."""
    threshold = LAYER_THRESHOLDS[layer_pair]
    counts = source.agg(F.count(F.lit(1)).alias("source_count")).withColumn(
        "target_count", target.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    )
    delta = F.abs(F.col("delta_count")) / F.greatest("source_count", F.lit(1))
    return (
        counts.withColumn("delta_count", F.col("source_count") - F.col("target_count"))
        .withColumn("_d", delta)
        .select(
            F.lit(layer_pair).alias("layer_pair"), F.lit(table).alias("table_name"), "source_count", "target_count",
            "delta_count", F.round(F.col("_d") * 100, 2).alias("delta_pct"),
            F.when(F.col("_d") <= threshold, "OK").when(F.col("_d") <= 2 * threshold, "WARNING").otherwise("FAIL").alias("status"),
            F.lit(threshold * 100).alias("threshold_pct"),
        )
    )


def reconcile_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """DQ06, key level: rows per side for keys whose counts differ."""
    a = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"))
    b = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("target_rows"))
    return a.join(b, keys, "full_outer").na.fill(0, ["source_rows", "target_rows"]).filter("source_rows <> target_rows")


def alerts(checks: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """DQ07: alert rows for failed checks and for reconciliations that are not OK."""
    failed = checks.filter(~F.col("success")).select(
        F.lit("HIGH").alias("severity"), F.col("suite").alias("table_name"), "expectation",
        F.to_json(F.struct("failures", "critical")).alias("details"),
    )
    off = reconciliations.filter("status <> 'OK'").select(
        F.when(F.col("status") == "FAIL", "HIGH").otherwise("MEDIUM").alias("severity"), "table_name",
        F.lit("reconciliation").alias("expectation"), F.to_json(F.struct("delta_pct", "threshold_pct")).alias("details"),
    )
    return failed.unionByName(off)


def fingerprint(df: DataFrame) -> DataFrame:
    """DQ13: order-free fingerprint of all rows and columns."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("soma"))


def validate_scores(scores: DataFrame) -> DataFrame:
    """DQ12: scores must be present and inside 0..1."""
    return scores.agg(
        F.count_if(F.col("score").isNull()).alias("nulos"),
        F.count_if(~F.col("score").between(0.0, 1.0)).alias("fora_do_intervalo"),
    ).withColumn("valido", (F.col("nulos") == 0) & (F.col("fora_do_intervalo") == 0))
