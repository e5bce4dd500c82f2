"""The stored index and the pruned neighbour search against all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattlake.operators import postings
from wattlake.plans import retrieval


def bm25(queries, docs, k):
    words = {d: [w for w in (t or "").lower().split() if len(w) > 2] for d, t in docs if d is not None}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, t in queries:
        asked = Counter(w for w in t.lower().split() if len(w) > 2)
        scores = []
        for d, ws in words.items():
            tf = Counter(ws)
            found = [w for w in asked if tf[w]]
            s = sum(asked[w] * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / max(mean, 1))) for w in found)
            if found:
                scores.append((-round(s, 6), d))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, lot, shard_docs", [(128, 256, 16_384), (4, 2, 40)])
def test_index_search_against_all_pairs(spark, monkeypatch, block, lot, shard_docs):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "QUERY_LOT", lot)
    rng = random.Random(8)
    vocabulary = [f"wort{i}" for i in range(60)]
    word = lambda: vocabulary[min(int(rng.expovariate(0.08)), 59)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(400)]
    docs += [(500 + i, "wort1 wort2 wort3") for i in range(30)] + [(600, None), (601, ""), (602, "ab c"), (None, "wort1")]
    queries = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(7)] + [(90, "nirgends"), (91, "wort1 wort1 wort59")]
    d = spark.createDataFrame(docs, "d long, t string").repartition(3)
    q = spark.createDataFrame(queries, "q long, t string")
    index = postings.build(d, "d", "t", retrieval.tokens, shard_docs=shard_docs)
    got = retrieval.bm25_topk(index, q, "q", "d", "t", 5).select("q", "d", "bm25", "rank").collect()
    want = bm25(queries, docs, 5)
    assert sorted((r.q, r.d, r["rank"]) for r in got) == sorted((a, b, r) for a, b, _, r in want)
    assert all(abs(a.bm25 - b[2]) < 2e-6 for a, b in zip(sorted(got, key=lambda r: (r.q, r.d)), want, strict=True))


def test_blocks_are_skipped(spark):
    """A frequent term after a rare one: only blocks that hold a leading document are scored."""
    docs = [(i, "selten " * 6 + "immer" if i < 20 else "immer " + "fuell " * (i % 7)) for i in range(3_000)]
    rows = postings.build(spark.createDataFrame(docs, "d long, t string"), "d", "t", retrieval.tokens, shard_docs=10_000)
    held = rows.filter(F.col("termo").isin("selten", "immer")).toPandas()
    for _, part in held.groupby("shard"):
        if (part["termo"] == "selten").any() and len(part) > 3:
            shard = postings._Shard(part, 5.0)
            shard.best([("selten", 5.0), ("immer", 0.01)], 2, 6)
            assert shard.skipped > 0
            return
    raise AssertionError("no shard with both terms")


def test_pages_walk_every_row_once(spark, tmp_path):
    from wattlake.operators import pages

    rng = random.Random(4)
    rows = [(f"k{i:03d}", rng.choice([0.1, 0.5, 0.5, 0.9]), i % 3) for i in range(97)] + [("none", None, 1), (None, 0.5, 1)]
    pages.sorted_layout(spark.createDataFrame(rows, "k string, s double, g int").repartition(5), "s", "k", "g").write.parquet(str(tmp_path / "l"))
    held = spark.read.parquet(str(tmp_path / "l"))
    where = pages.conditions(equal={"g": 1, "k": None}, at_least={"s": 0.2})
    got = [[(r.s, r.k, r.pagina) for r in p.collect()] for p in pages.pages(held, "s", "k", 7, where)]
    want = sorted([(-s, k) for k, s, g in rows if g == 1 and k and s and s >= 0.2])
    assert [(-s, k) for p in got for s, k, _ in sorted(p, key=lambda x: (-x[0], x[1]))] == want
    assert all(n == i for i, p in enumerate(got, 1) for _, _, n in p) and all(len(p) == 7 for p in got[:-1])
    assert list(pages.pages(held, "s", "k", 7, pages.conditions(at_least={"s": 2.0}))) == []


def test_neighbours_across_slices(spark):
    from wattlake.operators.runs import neighbours

    rows = [("hot", i, f"v{i}") for i in range(60)] + [("b", 3, "x"), ("b", 40, "y"), (None, 1, "n"), (None, 2, "m")]
    for width in (1, 7, 1000):
        df = spark.createDataFrame(rows, "k string, t int, v string")
        got = neighbours(df, ["k"], "t", F.floor(F.col("t") / width), before={"prev": "v"}, after={"next": "v", "at": "t"})
        for key in ("hot", "b", None):
            mine = sorted((r.t, r.v, r.prev, r.next, r["at"]) for r in got.collect() if r.k == key)
            values = [v for _, v, *_ in mine]
            assert [p for _, _, p, _, _ in mine] == [None, *values[:-1]] and [n for *_, n, _ in mine] == [*values[1:], None]
            assert [a for *_, a in mine] == [*[t for t, *_ in mine[1:]], None]


def test_unusual_rows_are_flagged(spark):
    from wattlake.plans.features import decile_position, flag_unusual

    df = spark.createDataFrame([(i, 10.0 + i % 3, 0.1 * (i % 2)) for i in range(50)] + [(99, 80.0, 2.0)], "i int, n double, z double")
    got = {r.i: r for r in flag_unusual(df, ["n", "z"], "z", 3.0, 0.05).collect()}
    assert got[99].is_anomaly and got[99].anomaly_score > 0 and sum(r.is_anomaly for r in got.values()) <= 3
    few = flag_unusual(df.limit(3), ["n", "z"], "z", 3.0, 0.05).collect()
    assert not any(r.is_anomaly for r in few)
    scores = spark.createDataFrame([(f"e{i:02d}", [0.9, 0.5, 0.5, 0.1][i % 4]) for i in range(40)], "entity_id string, score double")
    best = sorted(r.entity_id for r in decile_position(scores, 0.4).collect())
    want = sorted(((-s, e) for e, s in ((f"e{i:02d}", [0.9, 0.5, 0.5, 0.1][i % 4]) for i in range(40))))[:16]
    assert best == sorted(e for _, e in want)
