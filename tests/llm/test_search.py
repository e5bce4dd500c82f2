"""Ranked search, token alignment and nearest neighbours on awkward rows and against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from wattlake.llm import alignment, lexical, neighbours
from wattlake.llm.common import documents, table
from wattlake.llm.queries import tokenizer_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASHING = ("score", "rank", "class", "n", "row", "kept", "members")


def terms(text: str | None) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    found = [(i, terms(t)) for i, t in docs]
    many, whole = sum(bool(ts) for _, ts in found), sum(len(ts) for _, ts in found)
    df = Counter(t for _, ts in found for t in set(ts))
    asked: dict[int, set] = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, ts in found:
            tf, m = Counter(ts), 50 + (50 * len(ts) * many) // max(whole, 1)
            score = sum(
                math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "délta", "Ünder", "x1", "straße", "ÉTÉ", "日本"]) + rng.choice(["", "s", "2"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(120)]
    # Copies by the dozen, the same bag in another order, a bag twice as long, nulls, repeated and very long rows.
    docs += [(200 + i, "alpha beta, gamma!") for i in range(60)] + [(300, "gamma beta alpha"), (301, "alpha beta gamma " * 2), (5, "alpha"), (5, "alpha")]
    docs += [(None, "alpha beta gamma"), (400, None), (401, ""), (402, "--- !!!"), (403, "beta " * 20_000 + "alpha"), (404, "z" * 50_000 + " alpha")]
    items = [(1, "Alpha beta"), (2, "gamma"), (2, "délta"), (3, None), (4, "?!"), (None, "alpha"), (5, "nowhere"), (6, "alpha ALPHA été x1 日本2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHING])
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    for k, postings in ((7, 1_000_000), (50, 3)):
        got = lexical.ranked_search(d, i, k=k, block_postings=postings).collect()
        assert sorted(map(tuple, got), key=str) == ranked(docs, items, k)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).collect() == []
    assert lexical.ranked_search(docs, items.limit(0)).collect() == []


def test_terms_of_a_stretch(monkeypatch):
    text = ("ab cd,Éf " * 50 + "q" * 300 + " end").encode()
    whole = lexical.term_counts(text)
    for size in (7, 64, 301):
        monkeypatch.setattr(lexical, "STRETCH", size)
        assert lexical.term_counts(text) == whole
    assert lexical.term_counts(None) == (0, Counter())


AWKWARD = [
    "a  b c", "\n\nfoo\n\n bar\nbaz  \n ", "", None, " ", "<|endoftext|> <s> x </s>", "ﬁ é é x", " lead", "x" * 5000, "日本語 テキスト です　全角 空白 " * 40,
    "a\xa0b c d  e", "▁ x", "tab\tx \r\n y ; \r z", "привет мир как дела " * 300, "a b\x1c c d\x85 e f", "a " * 3000, "same words here", "same words here",
]


def aligned_by_hand(texts: list[str | None]) -> list[tuple]:
    """Every token of both whole texts by its end; groups and links from the ends alone."""
    tools = alignment.Tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    done, counts = [], Counter()
    for text in texts:
        ids = tools.encode(text) if text else None
        if ids is None:
            done.append(None)
            continue
        ends = [np.cumsum([len(names[i]) for i in side]).tolist() for side, names in zip(ids, (tools.bytes_a, tools.bytes_b), strict=True)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, low = [], [], 0
        for high in common:
            part = [[i for i, e in zip(side.tolist(), at, strict=True) if low < e <= high] for side, at in zip(ids, ends, strict=True)]
            groups.append("|".join(",".join(map(str, p)) for p in part))
            links += [(x, y) for x, e in zip(ids[0].tolist(), ends[0], strict=True) if e == high for y, f in zip(ids[1].tolist(), ends[1], strict=True) if f == high]
            low = high
        counts.update(links)
        done.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top: dict[int, int] = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if d is None else (*d[:3], len(d[3]), sum(counts[p] == top[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) for d in done]


@pytest.mark.parametrize("chunk_bytes", [65_536, 97])
def test_alignment_against_whole_texts(spark, chunk_bytes):
    given = [r.text[:1500] for r in documents(spark, SF).select("text").filter("text IS NOT NULL").orderBy("doc_id").take(25)]  # a fixture
    texts = AWKWARD + given
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHING])
    got = alignment.align_documents(
        rows, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), chunk_bytes=chunk_bytes
    ).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == aligned_by_hand(texts)


def test_alignment_of_nothing_and_without_ids(spark):
    files = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(None, "one two"), (None, "one two three " * 40)], "doc_id long, text string")
    assert alignment.align_documents(rows.limit(0), *files).collect() == []
    got = alignment.align_documents(rows, *files, chunk_bytes=64).collect()
    assert [r.doc_id for r in got] == [None, None] and all(r.n_links for r in got)


def test_fragments_compose_associatively():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 30)
        ends = [sorted({*rng.sample(range(1, 60), rng.randint(0, 30)), 60}) for _ in range(2)]
        ids = [np.arange(len(e)) + 100 * s for s, e in enumerate(ends)]
        whole = alignment.aligned(ids[0], np.array(ends[0]), ids[1], np.array(ends[1])).fragment
        cuts = [0, *sorted(rng.sample(range(1, 60), min(n, 10))), 60]
        parts = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            pick = [(np.array(e) > low) & (np.array(e) <= high) for e in ends]
            parts.append(alignment.aligned(ids[0][pick[0]], np.array(ends[0])[pick[0]], ids[1][pick[1]], np.array(ends[1])[pick[1]]).fragment)
        while len(parts) > 1:  # any order of pairings
            at = rng.randrange(len(parts) - 1)
            parts[at : at + 2] = [parts[at].compose(parts[at + 1])]
        assert parts[0] == whole and alignment.NOTHING.compose(whole) == whole == whole.compose(alignment.NOTHING)


def test_windows_cover_every_byte_once():
    rng = random.Random(2)
    for size in (5, 40, 1000):
        data = b" " + "".join(rng.choice(["ab", " ", "é", "\n", "x" * 30, "　"]) for _ in range(400)).encode()
        found = alignment.windows(data, size)
        assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(start <= low < high <= stop for low, high, start, stop in found)
        assert sum(stop - start for _, _, start, stop in found) < 4 * len(data) + 400 * 60


def by_brute_force(rows: list[tuple], k: int, every: int) -> dict[int, list[tuple[float, int]]]:
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = [(-float((np.array(y) * np.array(x)).sum()), v) for v, y in rows if v != q and len(y) == len(x)]
            out[q] = sorted(near)[:k]
    return out


def vectors(seed: int, n: int, dim: int, scale: bool) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = [(i, (centres[i % 12] + 0.7 * rng.standard_normal(dim)) * (rng.uniform(0.2, 3) if scale else 1)) for i in range(n)]
    hot = rng.standard_normal(dim)
    rows += [(n + i, hot) for i in range(90)]  # a common vector, queries among its rows
    return [(i, x.tolist()) for i, x in rows]


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_against_brute_force(spark, scale):
    rows = vectors(4, 2_500, 16, scale)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in CLASHING]).repartition(4)
    got = neighbours.nearest(d, k=20, part_rows=200, query_rows=16, sample_rows=400).collect()
    want, hit, total = by_brute_force(rows, 20, 20), 0, 0
    lists: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        lists.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert lists.keys() == want.keys()
    held = dict(rows)
    for q, found in lists.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(v != q for _, v, _ in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(s == float((np.array(held[v]) * np.array(held[q])).sum()) for _, v, s in found)
        hit += len({v for _, v, _ in found} & {v for _, v in want[q]})
        total += 20
    assert hit / total >= 0.9
    twin = neighbours.nearest(d.repartition(3), k=20, part_rows=200, query_rows=16, sample_rows=400).collect()
    assert len(twin) == len(got)


def test_neighbours_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, nan]), (120, [inf, 1.0]), (140, [1.0, None]),
        (None, [1.0, 0.0]), (160, [1.0, 2.0, 3.0]), (5, [1e200, 1e200]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0]), (180, [2.0, 0.0]), (180, [1.0, 0.0]),
    ]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = {}
    for r in neighbours.nearest(d, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    got = {q: [v for _, v, _ in sorted(found)] for q, found in got.items()}
    # 180 counts with its smallest vector; 160 has no partner of its length.
    assert got == {0: [5, 20, 180, 3, 7], 20: [5, 0, 180, 3, 7], 180: [5, 0, 20, 3, 7]}
    assert neighbours.nearest(d.limit(0)).collect() == []


def test_neighbours_recall_on_the_given_table(spark):
    got = neighbours.nearest(table(spark, SF, "embeddings"))
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, SF, "embeddings").collect()]
    want = by_brute_force(rows, 20, 20)
    found: dict[int, set] = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found[q] & {v for _, v in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_chi_square_quantile():
    rng = np.random.default_rng(1)
    for freedom in (2, 8):
        x = neighbours.chi_square_quantile(0.95, freedom)
        assert abs((rng.chisquare(freedom, 200_000) < x).mean() - 0.95) < 0.005
    with pytest.raises(ValueError):
        neighbours.chi_square_quantile(0.95, 3)
