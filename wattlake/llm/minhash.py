"""Near-duplicate documents by b-bit MinHash: band candidates, packed signatures, confirmation on full shingle sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import Forest, components, each_group, hashed, meetings, saved

_BREAK = re.compile(rb"[\x20\x09-\x0D]")
STRETCH = 1 << 20
BITS = 2  # kept of each minimum
LANES = np.uint64(0x5555555555555555)  # the lower bit of each two-bit lane
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word of the text, A-Z lowered, a stretch of the text at a time."""
    import xxhash

    data, out, at = (text or "").encode().lower(), [], 0
    while at < len(data):
        stop = at + STRETCH
        if stop < len(data):
            found = _BREAK.search(data, stop)
            stop = found.start() if found else len(data)
        words = data[at:stop].split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run, and one without words has none."""
    h = word_hashes(text)
    n = min(words, len(h))
    if not n:
        return h
    runs = mixed(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(runs)


class Signer:
    """Minima of a shingle set under random multiply-add functions, as band keys and as packed low bits."""

    def __init__(self, bands: int, rows: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.factor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            part = self.factor[:, None] * shingles[None, at : at + 2048] + self.shift[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return least

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One key a band, of the whole minima: (documents, bands)."""
        grid = minima.reshape(len(minima), self.bands, self.rows)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64) + np.uint64(1), grid.shape[:2]).copy()
        for r in range(self.rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, r])
        return key

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of a scrambled minimum, 32 to a word: (documents, words)."""
        low = mixed(minima) & np.uint64((1 << BITS) - 1)
        lanes = low.reshape(len(low), -1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
        return np.bitwise_or.reduce(lanes, axis=2)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, low): set_a and set_b name the set, low holds the packed low bits."""
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, low array<long>"

    def column(grid: np.ndarray) -> pa.Array:
        offsets = np.arange(len(grid) + 1, dtype=np.int32) * grid.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(grid.reshape(-1).view(np.int64)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            n = batch.num_rows
            size, names = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            minima = np.zeros((n, bands * rows), np.uint64)
            for k, text in enumerate(batch.column(1)):
                found = shingle_set(text.as_py(), words)
                size[k] = len(found)
                names[k] = mixed(found).sum(dtype=np.uint64), mixed(found ^ _MIX[1]).sum(dtype=np.uint64)
                minima[k] = signer.minima(found)
            named = [pa.array(names[:, k].copy().view(np.int64)) for k in (0, 1)]
            columns = [batch.column(0), pa.array(size), *named, column(signer.keys(minima)), column(signer.packed(minima))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "low"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, schema)


def alike(low: np.ndarray, other: np.ndarray, functions: int) -> np.ndarray:
    """Similarity of every row to every other row from packed signatures: the share of equal lanes, less what chance makes equal."""
    different = np.zeros((len(low), len(other)), np.uint16)
    for k in range(low.shape[1]):
        x = low[:, k][:, None] ^ other[:, k][None, :]
        different += np.bitwise_count((x | (x >> np.uint64(1))) & LANES)
    chance = 0.5**BITS
    return (1 - different / functions - chance) / (1 - chance)


def _lows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).view(np.uint64)


TILE = 512


def linked(n: int, mine: np.ndarray, same: bool, near, check) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of ``n`` rows that pass ``near`` (a matrix for two ranges of rows) and ``check`` (for one pair).

    Pairs of one chunk are left to its own meeting unless ``same``. First a row is compared with the first one, then any two that are not
    yet tied, so that a group of near copies costs about one check a row.
    """
    forest = Forest(n)
    for first in {0, int(np.argmax(mine != mine[0]))} if n else ():
        close = near(slice(first, first + 1), slice(0, n))[0]
        close &= same | (mine != mine[first])
        for k in np.flatnonzero(close).tolist():
            if k != first and forest.root(first) != forest.root(k) and check(first, k):
                forest.tie(first, k)
                yield first, k
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            label = forest.labels()
            x, y = slice(i, i + TILE), slice(j, j + TILE)
            some = near(x, y) & (label[x][:, None] != label[y][None, :])
            if not same:
                some &= mine[x][:, None] != mine[y][None, :]
            for p, q in zip(*(v.tolist() for v in np.nonzero(some)), strict=True):
                if p + i < q + j and forest.root(p + i) != forest.root(q + j) and check(p + i, q + j):
                    forest.tie(p + i, q + j)
                    yield p + i, q + j


def band_links(members: DataFrame, lows: DataFrame, functions: int, least: float, chunk_rows: int) -> DataFrame:
    """(a, b): ties between documents that share a band and whose packed signatures are ``least`` alike, as spanning forests of the buckets.

    Most buckets hold the same documents as another band's; of those one is looked at.
    """
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y"), F.bit_xor(hashed("id", seed=6)).alias("all")
    )
    one = sizes.filter("n > 1").groupBy("n", "x", "y", "all").agg(F.min("key").alias("key")).select("key", "n")
    chosen = members.join(saved(one, "buckets"), "key").join(lows, "id")
    dealt = meetings(chosen.select("key", "id", "low", "n"), "key", F.ceil(F.col("n") / chunk_rows))

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for rows in each_group(batches, ["key", "a", "b"]):
            ids, low = rows["id"].to_numpy(), _lows(rows["low"])
            same = bool(rows["a"].iat[0] == rows["b"].iat[0])
            near = lambda x, y: alike(low[x], low[y], functions) >= least  # noqa: E731, B023
            out += [(ids[p], ids[q]) for p, q in linked(len(ids), rows["mine"].to_numpy(), same, near, lambda p, q: True)]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"])

    return saved(dealt.select("key", "a", "b", "mine", "id", "low").mapInPandas(tie, "a long, b long"), "ties")


def confirmed(clusters: DataFrame, docs: DataFrame, words: int, percent: int, functions: int, least: float, chunk_rows: int, chunk_shingles: int) -> DataFrame:
    """(a, b): spanning forests of the true links inside clusters (cluster, id, n, low), each checked on the full shingle sets.

    A document's set is made once and goes to the meetings of its chunk. Signatures and set sizes rule out most pairs before.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"))
    chunks = F.greatest(F.ceil(F.col("rows") / chunk_rows), F.ceil(F.col("all") / chunk_shingles))
    clusters = clusters.join(sizes, "cluster").withColumn("chunks", F.least(chunks, F.col("rows")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(shingles=[shingle_set(text, words).tobytes() for text in batch["text"]])

    wanted = texts.join(clusters.select("cluster", "id", "chunks"), "id")
    known = saved(wanted.select("cluster", "id", "chunks", "text").mapInPandas(sets, "cluster long, id long, chunks int, shingles binary"), "sets")
    lows = clusters.select(F.col("id").alias("_id"), "low")
    dealt = meetings(known.join(lows, F.col("id") == F.col("_id")).drop("_id"), "cluster", F.col("chunks"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in each_group(batches, ["cluster", "a", "b"]):
            ids, low = rows["id"].to_numpy(), _lows(rows["low"])
            found = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
            n = np.array([len(f) for f in found])
            same = bool(rows["a"].iat[0] == rows["b"].iat[0])

            def near(x: slice, y: slice) -> np.ndarray:
                small, large = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])  # noqa: B023
                return (100 * small >= percent * large) & (alike(low[x], low[y], functions) >= least)  # noqa: B023

            def true(p: int, q: int) -> bool:
                if ids[p] == ids[q]:  # noqa: B023
                    return False
                x, y = (found[p], found[q]) if n[p] <= n[q] else (found[q], found[p])  # noqa: B023
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                return 100 * both >= percent * (len(x) + len(y) - both)

            links = list(linked(len(ids), rows["mine"].to_numpy(), same, near, true))
            yield pd.DataFrame([(ids[p], ids[q]) for p, q in links], columns=["a", "b"]).astype("int64")

    return saved(dealt.select("cluster", "a", "b", "mine", "id", "low", "shingles").mapInPandas(check, "a long, b long"), "links")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    slack: float = 0.17,
    chunk_rows: int = 1_024,
    chunk_shingles: int = 1_000_000,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept.

    1. Equal shingle sets form a class that acts as one document.
    2. Documents that share a band, and whose packed signatures are at most ``slack`` (four standard deviations) below the threshold, are
       tied; ties make clusters. Two documents of 80 % share one of the 32 bands of 4 but with probability 5e-8.
    3. Inside a cluster any two documents not yet linked are compared on their full sets, unless signatures or set sizes rule it out.
    Tasks give back spanning forests, never pairs, and clusters and buckets above a chunk are dealt to several tasks.

    A text without words (empty, null) links with nothing. A null doc_id takes no part: its component is null and it is kept. Rows that
    share a doc_id are one document, linked if any of its texts is, with one decision. Other columns are ignored.
    """
    functions, least = bands * rows, percent / 100 - slack
    signed = saved(signatures(docs, words, bands, rows), "signed")
    able = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    one = saved(able.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")), "classes")
    leaders = able.join(one, ["set_a", "set_b"]).filter(F.col("doc_id") == F.col("id"))
    members = leaders.select("id", F.explode("bands").alias("key")).distinct()
    lows = leaders.select("id", "n_shingles", "low")
    ties = band_links(members, lows.select("id", "low"), functions, least, 2 * chunk_rows)
    clusters = components(ties, name="ties").select(F.col("component").alias("cluster"), F.col("node").alias("id"))
    clusters = saved(clusters.join(lows, "id").select("cluster", "id", F.col("n_shingles").alias("n"), "low"), "clusters")
    links = confirmed(clusters, docs, words, percent, functions, least, chunk_rows, chunk_shingles)

    # A document with several texts belongs to several classes; its id ties them.
    several = able.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).filter("x < y").select(F.col("doc_id").alias("a"))
    tied = able.join(one, ["set_a", "set_b"]).filter("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = links.union(tied.join(several, "a", "left_semi"))
    final = components(links, name="links")
    classed = signed.drop("bands", "low").join(one, ["set_a", "set_b"], "left").withColumn("id", F.when(F.col("n_shingles") > 0, F.col("id")))
    out = classed.join(final, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents without the later members of each group of near duplicates, with their own columns."""
    gone = near_duplicates(docs, **how).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(saved(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) = 1 THEN [words[1]]
    ELSE [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r),
final AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, f.component_id, d.doc_id = f.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN final f ON f.d = d.doc_id
"""
