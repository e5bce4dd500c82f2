"""Registered queries against their SQL twins on the smallest tables.

By default a spread of queries runs; set ORACLE_ALL=1 to run every one.
"""

from __future__ import annotations

import os

import pytest
from check import compare
from conftest import SF

from wattlake.catalog import load

QUERIES, ORACLES = load()
SPREAD = (
    "wide_frame", "by_region", "radar_causes_by_region", "mis_monthly_mis", "sp_severidade_alta_ranking", "sp_severidade_alta_descricoes",
    "ce_group_radar", "category_tree_nodes", "service_orders_silver", "contract_rejects", "expectations", "dim_time", "fact_service_orders",
    "incremental_upsert", "customer_status_history", "target_projection", "default_features", "unpaid_runs", "psi_drift",
    "classification_metrics", "document_entities", "chunk_documents", "bm25_topk", "retrieval_metrics", "telemetry_latency", "stream_upsert",
)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ORACLE_ALL") else SPREAD)
def test_query_matches_twin(spark, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note
