"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import components, hashed, saved

TILE = 1024  # rows of a distance matrix held at once
TURNS = 3  # the cells of a block are filled and joined one part after the other, so their copies never lie on disk together
ROUND_ROWS = 1 << 18  # rows that a round may move whatever the size of the table
SLACK = 1e-6  # above any rounding of rotated single-precision parts, far below a budget


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, by way of their largest part so that no square overflows or vanishes."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def blocks_of(dim: int, blocks: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def usable(column: str = "embedding"):
    """Whether a vector can link: not null or empty, every component a finite number, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def _places(vectors: DataFrame, blocks: int, budget: float, block: int | None = None, turn: int = 0) -> DataFrame:
    """Rows (dim, block, x, y, home, id, copies, vector): each vector in its own cell of a block and, as a guest, in half of the cells around.

    A cell is a square of the first two parts of a block, as wide as the distance two vectors may have there; so two vectors within that
    distance meet in one cell, where at least one of them is at home. Of the cells of ``block`` those of ``turn`` are given, or, without a block, only the
    number of rows of every cell in each batch: (dim, block, x, y, homes, guests).
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby(batch["embedding"].map(len)):
                raw = np.stack(rows["embedding"].to_numpy())
                turned = unit_rows(raw) @ rotation(dim)
                parts = blocks_of(dim, blocks)
                for number, part in enumerate(parts):
                    if block not in (None, number):
                        continue
                    width = np.sqrt(budget * (part.stop - part.start) / dim) + SLACK
                    first = np.floor(turned[:, part.start] / width).astype(np.int64)
                    second = np.floor(turned[:, min(part.start + 1, part.stop - 1)] / width).astype(np.int64)
                    for dx, dy in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)):
                        x, y, home = first + dx, second + dy, dx == 0 and dy == 0
                        if block is None:
                            cells, n = np.unique(np.stack([x, y], axis=1), axis=0, return_counts=True)
                            yield pd.DataFrame({"dim": dim, "block": number, "x": cells[:, 0], "y": cells[:, 1], "homes": n * home, "guests": n * (not home)})
                            continue
                        at = np.flatnonzero((x + 2 * y) % TURNS == turn)
                        yield pd.DataFrame(
                            {
                                "dim": dim, "block": number, "x": x[at], "y": y[at], "home": home,
                                "id": rows["id"].to_numpy()[at], "copies": rows["copies"].to_numpy()[at], "vector": [raw[i].tobytes() for i in at],
                            }
                        )

    kinds = "homes long, guests long" if block is None else "home boolean, id long, copies long, vector binary"
    return vectors.mapInPandas(place, f"dim int, block int, x long, y long, {kinds}")


def links_between(a: dict, b: dict | None, dim: int, block: int, blocks: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (of ``a`` alone if ``b`` is None) that link and whose first close block is this one."""
    parts = blocks_of(dim, blocks)
    budgets = [2 * (1 - threshold) * (p.stop - p.start) / dim + SLACK for p in parts]
    other = b or a
    left, right = [], []
    for i in range(0, len(a["unit"]), TILE):
        for j in range(i if b is None else 0, len(other["unit"]), TILE):
            x, y = a["turned"][i : i + TILE, parts[block]], other["turned"][j : j + TILE, parts[block]]
            apart = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
            p, q = np.nonzero(apart <= budgets[block])
            p, q = p + i, q + j
            if b is None:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 65_536):
                u, v = p[s : s + 65_536], q[s : s + 65_536]
                close = (a["unit"][u] * other["unit"][v]).sum(1) >= threshold
                u, v = u[close], v[close]
                first = np.ones(len(u), bool)
                for earlier in range(block):
                    gap = a["turned"][u, parts[earlier]] - other["turned"][v, parts[earlier]]
                    first &= (gap * gap).sum(1) > budgets[earlier]
                left.append(u[first])
                right.append(v[first])
    empty = np.empty(0, np.int64)
    return (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty)


def forest(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links: as many as tie the same ids together, one fewer than ids at most."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        if (p := root(p)) != (q := root(q)):
            parent[max(p, q)] = min(p, q)
            yield p, q


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, blocks: int = 4, chunk_rows: int = 4_096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. Vectors of cosine ``threshold`` or more link; no pair is missed.

    Unit vectors that link are at most sqrt(2 - 2 threshold) apart. A rotation keeps that, and of its blocks at least one holds no more of the
    squared distance than its share. So each block is joined by itself, within its share of the budget, over cells that rows of a
    crowded place fill in chunks of ``chunk_rows``; a task sees two chunks. There a pair within budget is verified in double precision, and
    counted in the first block that finds it. Tasks give back link counts and a spanning forest, not pairs. The meetings go in rounds, each about as
    large as the table, so that the disk grows with the table while the comparisons may grow faster.

    Equal vectors are joined once and count as that many. Null, empty, zero vectors and those with a null or non-finite component
    have no links; vectors of different length are not compared. A null id has a null component, is kept, and its links count for others.
    Rows that share an id are one node; each counts its own links. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    exact = vectors.schema[vector_col].dataType.elementType.simpleString() if hasattr(vectors.schema[vector_col].dataType, "elementType") else ""
    if exact == "double":
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    item = np.float64 if exact == "double" else np.float32
    spark = vectors.sparkSession
    able = rows.filter(usable())
    # Equal vectors as one; the id of the group is its own, for a row may lack one.
    groups = able.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    groups = saved(groups.withColumn("id", F.monotonically_increasing_id()), "vectors")
    members = saved(able.join(groups, "embedding").select("vec_id", "id"), "vector-groups")
    held = groups.select("id", "copies", "embedding")
    budget = 2 * (1 - threshold)

    key = ["dim", "block", "x", "y"]
    sizes = _places(held, blocks, budget).groupBy(*key).agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests"))
    sizes = saved(sizes.filter("homes > 0 AND homes + guests > 1"), "cells")
    home_chunks = F.ceil(F.col("homes") / chunk_rows).cast("int")
    guest_chunks = F.ceil(F.col("guests") / chunk_rows).cast("int")
    mine = F.when(F.col("home"), F.pmod(hashed("id"), home_chunks)).otherwise(F.pmod(hashed("id"), guest_chunks)).cast("int")
    # A home chunk meets itself, the later home chunks and every guest chunk; each meeting is one group.
    pair = lambda a, b, kind: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(kind).alias("kind"))
    own = F.col("mine")
    with_homes = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: pair(F.least(own, k), F.greatest(own, k), 0))
    with_guests = F.when(F.col("g") > 0, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: pair(own, k, 1)))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: pair(k, own, 1))
    none = F.array().cast("array<struct<a:int,b:int,kind:int>>")
    meetings = F.when(F.col("home"), F.concat(with_homes, F.coalesce(with_guests, none))).otherwise(as_guest)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(rows["dim"].iat[0]), int(rows["block"].iat[0])
        a, b, kind = int(rows["a"].iat[0]), int(rows["b"].iat[0]), int(rows["kind"].iat[0])

        def side(some: pd.DataFrame) -> dict:
            unit = unit_rows(np.frombuffer(b"".join(some["vector"]), item).reshape(-1, dim))
            return {"unit": unit, "turned": unit @ rotation(dim), "id": some["id"].to_numpy(), "copies": some["copies"].to_numpy()}

        empty = pd.DataFrame({"id": [], "n": [], "other": []}).astype("int64")
        if kind == 0 and a == b:
            left, right = side(rows), None
        else:
            first = rows["home"].to_numpy() if kind else (rows["mine"] == a).to_numpy()
            if first.all() or not first.any():
                return empty
            left, right = side(rows[first]), side(rows[~first])
        p, q = links_between(left, right, dim, block, blocks, threshold)
        other = right or left
        if not len(p):
            return empty
        counts: dict[int, int] = {}
        for ids, weights in ((left["id"][p], other["copies"][q]), (other["id"][q], left["copies"][p])):
            found, at = np.unique(ids, return_inverse=True)
            for v, n in zip(found.tolist(), np.bincount(at, weights).astype(np.int64).tolist(), strict=True):
                counts[v] = counts.get(v, 0) + n
        out = [(v, n, None) for v, n in counts.items()] + [(x, 0, y) for x, y in forest(left["id"][p], other["id"][q])]
        return pd.DataFrame(out, columns=["id", "n", "other"]).astype({"other": "Int64"})

    # A crowded cell sends its rows to many meetings: those of a part of the cells go in as many rounds as keep a round about as large as the table.
    met_rows = sizes.select("block", F.pmod(F.col("x") + 2 * F.col("y"), F.lit(TURNS)).alias("turn"), (F.col("homes") * (home_chunks + guest_chunks) + F.col("guests") * home_chunks).alias("n"))
    totals = met_rows.groupBy("block", "turn").agg(F.sum("n").alias("n")).collect()  # at most blocks times TURNS rows
    most = max(ROUND_ROWS, 2 * groups.count())
    found = [saved(spark.createDataFrame([], "id long, n long, other long"), "met")]
    for r in sorted(totals):
        dealt = _places(held, blocks, budget, r["block"], r["turn"]).join(sizes.filter(F.col("block") == r["block"]), key)
        dealt = dealt.withColumns({"mine": mine, "h": home_chunks, "g": guest_chunks})
        dealt = dealt.select(*key, "home", "id", "copies", "vector", "mine", F.explode(meetings).alias("m")).select("*", "m.a", "m.b", "m.kind").drop("m")
        rounds = -(-r["n"] // most)
        for k in range(rounds):
            some = dealt.filter(F.pmod(hashed(*key, "a", "b", "kind", seed=7), F.lit(rounds)) == k) if rounds > 1 else dealt
            found.append(saved(some.groupBy(*key, "a", "b", "kind").applyInPandas(meet, "id long, n long, other long"), "met"))
    met = reduce(DataFrame.unionByName, found)
    counted = met.groupBy("id").agg(F.sum("n").alias("n"))
    known = groups.select("id", "least", "copies").join(counted, "id", "left")
    known = known.select("id", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Tie groups to each other, and rows to their group, by group number; then each component takes its smallest row id.
    tied = components(met.filter("other IS NOT NULL"), "id", "other", "vectors")
    known = known.join(tied, known.id == tied.node, "left").select("id", "n_links", "least", F.coalesce("component", "id").alias("part"))
    smallest = known.groupBy("part").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "part").select("id", "n_links", "component_id")
    out = members.join(known, "id").select("vec_id", "n_links", "component_id")
    rest = rows.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = out.unionByName(rest).withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.col("component_id")))
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum([x * x for x in e])) AS n FROM v
  WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r),
final AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT f.d AS vec_id, coalesce(n.n_links, 0) AS n_links, f.component_id, f.d = f.component_id AS kept
FROM final f LEFT JOIN n ON n.a = f.d
"""
