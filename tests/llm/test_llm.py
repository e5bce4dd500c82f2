"""The training-data operators on awkward rows and against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from check import compare
from conftest import SF
from pyspark.sql import functions as F

from wattlake.llm import embeddings, exact, langid, licences, lines, minhash, mixing, packing, quality, suffix
from wattlake.llm.common import components, documents, prefix_sums, table
from wattlake.llm.queries import ORACLES, QUERIES, tokenizer_path

random.seed(3)
LETTERS = "abcdefgh"


def words(n: int) -> str:
    return " ".join("".join(random.choices(LETTERS, k=random.randint(2, 7))) for _ in range(n))


PASSAGE, STORY = words(60), words(120)
ROWS = [
    (1, PASSAGE, "en", "a"),
    (2, "x " + PASSAGE + " y", "en", "a"),
    (3, STORY, "fr", None),
    (4, STORY[:300] + " changed " + STORY[300:], "fr", "b"),
    (5, None, None, None),
    (6, "", "en", "b"),
    (7, "a" * 900, None, "b"),
    (8, STORY, "fr", "b"),
    (9, STORY, "fr", "c"),
    (9, STORY, "fr", "c"),
    (None, "k " + STORY, "en", "c"),
    (10, "1234 !!", "en", "c"),
    (11, "one", "en", "a"),
    (12, "\n \n" + PASSAGE + "\n" + words(9) + "\n\n" + PASSAGE.upper() + "!", "en", "a"),
    (13, words(5_000), "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with nulls, repeats, ties, a long text and columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ROWS, COLUMNS)
    extra = {"kept": F.lit("x"), "component_id": F.lit(1), "score": F.lit("s"), "lang_pred": F.lit(0), "size": F.lit(2.5), "id": F.lit(9)}
    return rows.withColumns(extra).select(*extra, *rows.columns)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def test_components_and_prefix_sums(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 1 for i in [*range(1, 41), 100]} | {200: 200, 201: 200}
    rows = spark.createDataFrame([(i % 2 or None, i, i) for i in range(50)], "g int, k int, v long")
    got = {(r.g, r.k): r.s for r in prefix_sums(rows, ["g"], ["k"], {"s": "v"}, "t").collect()}
    assert got == {(i % 2 or None, i): sum(range(i % 2, i, 2)) for i in range(50)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_exact_dedup(spark, docs, nothing, tmp_path):
    got = exact.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].keep_id == 3 and by_id[9].group_size == 4 and not by_id[9].kept and by_id[3].kept
    assert by_id[5].keep_id == 5 and not by_id[6].kept  # null and empty are one text
    assert exact.exact_dedup(nothing).count() == 0
    first = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    digests = exact.text_digests(docs)
    first.ingest(digests.filter("doc_id > 8"))
    again = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    again.ingest(digests)
    again.ingest(digests)
    assert again.table().count() == digests.select("digest").distinct().count()
    assert {r.keep_id for r in again.decide(digests.filter("doc_id = 3")).collect()} == {9}  # seen first, so it stays


def test_language_id(spark, docs, nothing):
    given = documents(spark, SF)
    found = langid.predict_languages(given).join(given.select("doc_id", "lang"), "doc_id").toPandas()
    assert found.score.between(0, 1).all() and (found[found.held_out].lang == found[found.held_out].lang_pred).mean() > 0.95
    model = langid.train(docs, usable=F.lit(True))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (5, 6, 10)] == ["und"] * 3 and got[3].lang_pred == "fr" and got[5].bits is None
    assert langid.known_language(nothing).count() == 0 and langid.predict_languages(nothing).count() == 0
    kept = {r.doc_id for r in langid.known_language(docs).collect()}
    assert {1, 3, 8, 13} <= kept and not kept & {5, 6, 10}


def test_code_lengths_by_hand(spark):
    rows = spark.createDataFrame([(1, "abab", "x")], "doc_id long, text string, lang string")
    model = langid.train(rows, order=1, usable=F.lit(True))
    # a: 2 of 4 with 2 symbols; b after a: 2 of 2 with 1 symbol; then c: escape from b, escape from the empty context, one of 256.
    want = -np.log2(2 / 6) - np.log2(2 / 3) - np.log2(1 / 2) - np.log2(2 / 6) + 8
    assert model.code_lengths([b"abc"])[0, 0] == pytest.approx(want, rel=1e-6)
    whole = model.code_lengths([b"ab" * 1000])
    old, langid.STRETCH = langid.STRETCH, 64
    assert model.code_lengths([b"ab" * 1000]) == pytest.approx(whole, rel=1e-6)
    langid.STRETCH = old


def test_long_texts_are_learned_in_pieces(spark):
    rows = spark.createDataFrame([(1, "abcé" * 50, "x"), (2, "kurz", "y"), (3, None, "z"), (4, "1" * 500, "w")], "doc_id long, text string, lang string")
    model = langid.train(rows, row_bytes=64, usable=F.lit(True))
    assert model.languages == ["x", "y"]  # the whole of the long text is within the bound of pieces
    found = {r.doc_id: r.lang_pred for r in langid.identify(rows, model).collect()}
    assert found[1] == "x" and found[2] == "y" and found[3] == found[4] == "und"
    one = langid.train(rows, row_bytes=64, rows_per_language=1, usable=F.lit(True))
    all_ = model.code_lengths(["abcé".encode() * 50])[0, 0]
    assert one.languages == ["x", "y"] and one.code_lengths(["abcé".encode() * 50])[0, 0] > all_


def test_mixing(spark, docs, nothing):
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    given = documents(spark, SF)
    found = mixing.mix_report(given).join(given.select("doc_id", "source"), "doc_id").toPandas()
    sources = sorted(found.source.unique())
    size = found.groupby("source")["size"].sum()
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    level, full = 0.0, set()
    while True:
        level = (1.5 * size.sum() - sum(2 * size[s] for s in full)) / sum(weights[s] for s in sources if s not in full)
        now = {s for s in sources if 2 * size[s] <= weights[s] * level}
        if now == full:
            break
        full = now
    target, taken = found.groupby("source").target.first(), found.groupby("source").taken.sum()
    for s in sources:
        assert target[s] == pytest.approx(min(2 * size[s], weights[s] * level)) and abs(taken[s] - target[s]) < 0.03 * target[s]
    assert mixing.mix_report(given).toPandas().sort_values("doc_id").taken.tolist() == found.sort_values("doc_id").taken.tolist()


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 3), (2, 77)], "source_no long, quota long")
    leaves = mixing.split_quotas(quotas, 100).toPandas()
    assert leaves.groupby("source_no").n.sum().tolist() == [1000, 3, 77]
    assert set(leaves.groupby("shard").n.sum()) <= {10, 11} and leaves.shard.nunique() == 100


def test_packing_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0
    plain = Tokenizer.from_file(tokenizer_path())
    texts = [*ROWS, (20, "Ünï ÀÉ ñ ²½ it's I'LL <|endoftext|> <|STARTOFTEXT|> ΣΑΣ \u0085 ́ 中文 \x00", "", "")]
    rows = packing.pack_documents(docs.select("doc_id", "text").union(spark.createDataFrame(texts[-1:], COLUMNS).select("doc_id", "text")), tokenizer_path()).toPandas()
    want = Counter()
    for doc_id, text, *_ in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    rows["doc_id"] = rows.doc_id.astype(object).where(rows.doc_id.notna(), None)
    assert Counter(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))) == want
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 4096


def test_sum_of_squares_follows_its_rule():
    lengths = np.array(random.choices(range(1, 40), k=300))
    where, offset, bins = packing.sum_of_squares(lengths, 40)
    used = [0] * bins
    for b, o, n in zip(where, offset, lengths, strict=True):
        counts = Counter(u for u in used if 0 < u < 40)
        cost = {}
        for u in {0, *(u for u in counts if u + n <= 40)}:
            after = counts.copy()
            if u:
                after[u] -= 1
            if u + n < 40:
                after[u + n] += 1
            cost[u] = sum(c * c for c in after.values())
        assert used[b] == o and cost[o] == min(cost.values())
        used[b] += n


def repeated(rows, length=200):
    seen, out = Counter(), []
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[k : k + length] for k in range(len(data) - length + 1))
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_rows", [4_000, 1])
def test_repeated_strings(spark, docs, nothing, group_rows, monkeypatch):
    spans = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda d, n=200: spans(d, n, group_rows=group_rows))
    more = [(100 + k, words(3) + PASSAGE[:230] + words(30), "", "") for k in range(8)]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(more, COLUMNS).select("doc_id", "text"))
    got = sorted((tuple(r) for r in suffix.remove_repeats(given).collect()), key=repr)
    assert got == repeated([(r[0], r[1]) for r in [*ROWS, *more]])
    if group_rows > 1:
        assert suffix.remove_repeats(nothing).count() == 0


def test_suffix_order():
    data = np.frombuffer(b"abracadabra abracadabra banana", np.uint8)
    rank = suffix.suffix_ranks(data, 5)
    text = bytes(data)
    order = sorted({text[k : k + 5] for k in range(len(text))})
    assert rank.tolist() == [order.index(text[k : k + 5]) for k in range(len(text))]
    starts = np.arange(len(text) - 4)
    source = suffix.previous_factors(rank, starts)
    for k in starts:
        earlier = [j for j in range(k) if text[j : j + 5] == text[k : k + 5]]
        assert (source[k] >= 0) == bool(earlier) and (source[k] < 0 or source[k] in earlier)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 64)).astype("f4")
    rows = [(k, base[k % 12] + (0.3 * rng.standard_normal(64)).astype("f4") * (k > 40)) for k in range(90)]
    rows = [(k, [float(x) for x in v]) for k, v in rows]
    rows += [(90, None), (91, []), (92, [0.0] * 64), (93, [float("nan")] * 64), (94, [None] + [1.0] * 63), (95, [1.0, 2.0]), (96, [2.0, 4.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(0), "n_links": F.lit("x")})
    good = [(k, np.array(v, "f4").astype(float)) for k, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = Counter()
    parent = {k: k for k, _ in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, (a, x) in enumerate(good):
        for j, (b, y) in enumerate(good):
            if i < j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)), key=lambda v: (v is None, v))
                parent[q] = p
    want = sorted(((k, links[k], None if k is None else root(k), k is None or root(k) == k) for k, _ in rows), key=repr)
    for chunk in (4_096, 5):
        got = sorted((tuple(r) for r in embeddings.near_vectors(frame, chunk_rows=chunk).collect()), key=repr)
        assert got == want
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_minhash(spark, docs, nothing):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=2).collect()}
    assert got[8].component_id == got[9].component_id == got[4].component_id == 3 and got[2].component_id == 1
    assert got[5].n_shingles == got[6].n_shingles == 0 and got[6].kept and got[5].kept and got[11].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(nothing).count() == 0
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {1, 3, 5, 6, None}
    many = [(k, words(1) + " " + STORY + " " + words(random.randint(1, 40)), "", "") for k in range(60)]
    frame = spark.createDataFrame(many, COLUMNS)
    sets = {k: minhash.shingle_set(t, 2) for k, t, *_ in many}
    parent = {k: k for k in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in sets:
        for b in range(a + 1, 60):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for chunk in (1_024, 7):
        found = minhash.near_duplicates(frame, words=2, chunk_rows=chunk).collect()
        assert {r.doc_id: r.component_id for r in found} == {k: root(k) for k in sets}


def test_lines(spark, docs, nothing):
    long = " ".join(f"longer{k}word" for k in range(80))
    near = long[:200] + "z" + long[200:]
    rows = [(1, long + "\nshort line\n" + words(8)), (2, "short line\n" + near), (3, long.upper() + "!\n\nother words that stay here now"), (4, long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))
    table_ = {(r.doc_id, r.at): r for r in lines.line_table(frame, 5).collect()}
    close = bin((table_[1, 0].simhash ^ table_[2, 1].simhash) & (2**64 - 1)).count("1") <= 3
    got = {r.doc_id: r.removed_lines for r in lines.line_report(frame).collect()}
    assert got == {1: [], 2: [1] if close else [], 3: [0], 4: [0]}
    left = {r.doc_id: r.text for r in lines.without_repeated_lines(frame).collect()}
    assert 4 not in left and left[3] == "\nother words that stay here now" and left[1] == rows[0][1]
    assert lines.line_report(docs).count() == len(ROWS) and lines.without_repeated_lines(docs).columns == docs.columns
    assert lines.line_report(nothing).count() == 0 and lines.without_repeated_lines(nothing).count() == 0


def test_simhash(spark):
    texts = [(n, "of the " + " ".join(f"word{n * j % 97}x{j // 50}" for j in range(n))) for n in (2, 5, 6, 127, 128, 400, 600)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in frame.select("doc_id", F.transform(F.filter(F.split(lines.normalised("text"), " "), lambda w: F.length(w) >= 5), lambda w: F.xxhash64(w)).alias("h")).collect()}
    for r in lines.line_table(frame, 1).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes[r.doc_id]) > len(hashes[r.doc_id]))
        assert (r.simhash is None) if r.doc_id in (2, 600) else (r.simhash % 2**64 == want)  # too few telling words, too long a line


def test_quality(spark, docs, nothing):
    labels = table(spark, SF, "labels")
    found = quality.quality(documents(spark, SF), labels).join(labels, "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.95 and found[found.quality == 0].kept.mean() < 0.7  # few documents: thresholds are loose
    none = labels.limit(0)
    got = {r.doc_id: r for r in quality.quality(docs, none).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and all(r.perplexity is None for r in got.values())
    assert quality.quality(nothing, none).count() == 0


def test_kneser_ney_sums_to_one(spark):
    sample = spark.createDataFrame([("x", words(400)), ("x", "abcabd " * 30)], "lang string, text string")
    model = quality.kneser_ney(sample, 2)
    for context in (b"", b"a", b"ab", b"zz", b"q"):
        bits = [model.code_lengths([context + bytes([b])])[0, 0] - model.code_lengths([context])[0, 0] for b in range(256)]
        assert sum(2.0**-x for x in bits) == pytest.approx(1, abs=1e-4)


def test_licences(spark, docs, nothing):
    mit = "Permission is hereby granted,\nfree of charge" + licences.TEMPLATES[6][1][44:]
    rows = [(1, "Text here.\nreleased UNDER the mit licence\nReleased under the MIT License.\n\n" + mit), (2, None), (3, ""), (4, "license")]
    got = [(r.doc_id, r.kind, r.at, r.license) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (1, "line", 2, "MIT") in got and (1, "paragraph", 1, "MIT") in got and {r[0] for r in got} == {1}
    assert licences.licence_scan(nothing).count() == 0 and licences.licence_scan(docs).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    given = documents(spark, SF)
    rows = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == given.columns, name
        if name == "near_dedup":
            assert rows.count() == rows.select("doc_id").distinct().count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert packed.count() > 0
