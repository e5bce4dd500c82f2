"""Roll-ups over hierarchy and calendar: exact units without a row per (cell, unit)."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import defaultdict

from wattlake.plans import metrics

PERIOD_OF = {
    "ano": lambda d: d.year, "trimestre": lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1), "mes": lambda d: d.replace(day=1),
    "semana": lambda d: d - dt.timedelta(days=d.weekday()), "dia": lambda d: d,
}
SCHEMA = "base string, lote int, cod_uc long, status_atraso string, dias_atraso int, t timestamp"


def _rows(n: int) -> list[tuple]:
    rng = random.Random(7)
    # Days around a turn of month, quarter and year, where a week lies in two of them.
    days = [dt.datetime(2025, 12, 20) + dt.timedelta(days=i, hours=i % 24) for i in range(25)] + [None]
    return [
        (rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["ATRASADO", "NO_PRAZO", None]),
         rng.choice([0, 3, None]), rng.choice(days))
        for _ in range(n)
    ]


def _expected(rows, levels, periods):
    cells = defaultdict(list)
    for r in rows:
        day = r[5].date() if r[5] else None
        cal = [PERIOD_OF[p](day) if day else None for p in periods]
        for i in range(len(levels) + 1):
            for k in range(len(periods) + 1):
                key = (*[r[j] if j < i else None for j in range(len(levels))], *[c if j < k else None for j, c in enumerate(cal)], len(levels) - i, len(periods) - k)
                cells[key].append(r)
    total = lambda v: sum(v) if v else None
    return {
        key: (len(rs), sum(r[3] == "ATRASADO" for r in rs), total([r[4] for r in rs if r[4] is not None]), len({r[2] for r in rs} - {None}))
        for key, rs in cells.items()
    }


def test_every_cell_is_counted_exactly(spark):
    rows, levels = _rows(300), ["base", "lote"]
    notes = spark.createDataFrame(rows, SCHEMA)
    for periods in (metrics.PERIODS, ("ano",)):
        got = metrics.rollup(notes, levels, "t", periods).select(
            *levels, *periods, "nivel", "periodo", "total", "atrasadas", "dias_atraso", "unidades"
        ).collect()
        n = len(levels) + len(periods) + 2
        assert {tuple(r)[:n]: tuple(r)[n:] for r in got} == _expected(rows, levels, periods)
        assert len(got) == len({tuple(r)[:n] for r in got})


def test_no_pair_of_cell_and_unit_travels(spark):
    notes = spark.createDataFrame(_rows(20), SCHEMA)
    plan = metrics.rollup(notes, ["base", "lote"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    # Two shuffles, by unit bucket and by place, whose partitions are not merged.
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*REPARTITION_BY_NUM", plan)) == 2
    assert plan.count("Exchange ") == 2
