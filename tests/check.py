"""Run registered queries next to their SQL twins: ``python tests/check.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(round(value, 6) + 0.0)
    if hasattr(value, "as_tuple"):
        return repr(round(float(value), 6) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{cell(v)}" for k, v in value.items()) + "}"
    return str(value)


def normalise(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf)
    sc, sr = normalise(*spark_rows(df))
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(sr)} rows {t1 - t0:.1f}s"
    dc, dr = normalise(*duck_rows(con, sql))
    t2 = time.time()
    note = f"{len(sr)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sc != dc:
        return False, f"columns differ spark={sc} duck={dc}"
    if sr == dr:
        return True, note
    only_s = [r for r in sr if r not in set(dr)][:3]
    only_d = [r for r in dr if r not in set(sr)][:3]
    return False, f"{note} duckrows={len(dr)}\n   cols {sc}\n   spark-only {only_s}\n   duck-only {only_d}"


def main() -> int:
    import __spark_entry__ as entry
    from wattlake.session import build_session

    sf = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "10g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, name, queries[name], oracle.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:500]}"
            con = duck(sf)
        print(("ok   " if ok else "FAIL ") + name + "  " + note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
