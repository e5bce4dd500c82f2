"""File streams in slices: restart from checkpoint, late rows, rejects and upserts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattlake.sources.contracts import Column, Contract
from wattlake.sources.versioned import VersionedTable
from wattlake.streaming import jobs

SCHEMA = "id int, ts timestamp, v string"


def put(spark, path, name, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}")


def run(query):
    query.awaitTermination()


def test_incremental_restart(spark, tmp_path):
    src, out, chk = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/chk"
    t = dt.datetime(2026, 1, 1)
    put(spark, src, "a", [(1, t, "x")])
    run(jobs.append_bronze(jobs.read_files(spark, src, SCHEMA), out, chk))
    put(spark, src, "b", [(2, t, "y")])
    run(jobs.append_bronze(jobs.read_files(spark, src, SCHEMA), out, chk))
    run(jobs.append_bronze(jobs.read_files(spark, src, SCHEMA), out, chk))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_upsert_across_batches(spark, tmp_path):
    src, out, chk = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/chk"
    for hour, value in ((1, "old"), (3, "new"), (2, "late")):
        put(spark, src, value, [(7, dt.datetime(2026, 1, 1, hour), value), (hour, dt.datetime(2026, 1, 1, hour), "own")])
        stream = jobs.read_files(spark, src, SCHEMA).withColumn("b", F.pmod("id", F.lit(4)))
        run(jobs.upsert(stream, out, chk, ["id"], "ts", "b"))
    got = {r["id"]: r["v"] for r in VersionedTable(spark, out, stream.schema, "b").read().collect()}
    assert got == {7: "new", 1: "own", 2: "own", 3: "own"}


def test_late_rows_are_kept_aside(spark, tmp_path):
    src, on, late, chk = (f"{tmp_path}/{n}" for n in ("in", "on", "late", "chk"))
    put(spark, src, "a", [(1, dt.datetime(2026, 1, 10), "x")])
    run(jobs.split_late(jobs.read_files(spark, src, SCHEMA), "ts", "1 day", on, late, str(tmp_path / "marks"), chk))
    put(spark, src, "b", [(2, dt.datetime(2026, 1, 1), "y"), (3, dt.datetime(2026, 1, 10), "z")])
    run(jobs.split_late(jobs.read_files(spark, src, SCHEMA), "ts", "1 day", on, late, str(tmp_path / "marks"), chk))
    assert sorted(r["id"] for r in spark.read.parquet(on).collect()) == [1, 3]
    assert [r["id"] for r in spark.read.parquet(late).collect()] == [2]


def test_rejects(spark, tmp_path):
    contract = Contract("c", (Column("cod", "bigint", False), Column("uf", allowed_values=("SP", "CE"))))
    put(spark, f"{tmp_path}/in", "a", [("1", "SP"), ("x", "SP"), ("2", "RJ"), (None, "CE")], "cod string, uf string")
    stream = jobs.read_files(spark, f"{tmp_path}/in", "cod string, uf string")
    run(jobs.split_rejects(stream, contract, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/chk"))
    assert [r["cod"] for r in spark.read.parquet(f"{tmp_path}/ok").collect()] == ["1"]
    reasons = sorted(r["_reasons"][0] for r in spark.read.parquet(f"{tmp_path}/bad").collect())
    assert reasons == ["cod: missing", "cod: not bigint", "uf: not allowed"]


def test_a_version_shows_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    kinds = "k long, v string, b int"
    first = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", None)], kinds)
    second = spark.createDataFrame([(1, "A", 0), (4, "d", 0)], kinds)
    table = VersionedTable(spark, str(tmp_path / "t"), first.schema, "b")
    merge = lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new)
    rows = lambda: sorted((r.k, r.v) for r in table.read().collect())
    assert rows() == [] and table.commit(first, 0, merge)
    # A writer that stops between its data and the switch leaves the version before.
    stopped = monkeypatch.setattr(VersionedTable, "_switch", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        table.commit(second, 1, merge)
    assert stopped is None and rows() == [(1, "a"), (2, "b"), (3, "c")]
    monkeypatch.undo()
    assert table.commit(second, 1, merge) and not table.commit(second, 1, merge)
    assert rows() == [(1, "A"), (2, "b"), (3, "c"), (4, "d")]
    version, last, folders = table.manifest()
    assert (version, last) == (2, 1) and sum("v1" in f for f in folders.values()) == 2
    assert table.commit(first.limit(0), 2, merge) and rows() == [(1, "A"), (2, "b"), (3, "c"), (4, "d")]
