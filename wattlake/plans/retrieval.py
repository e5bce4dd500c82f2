"""Corpus chunking, embeddings, lexical and hybrid retrieval as joins and aggregations."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wattlake.functions.questions import normal_question
from wattlake.functions.text import slug, tokens
from wattlake.operators import postings
from wattlake.operators.grouping import top_per_group
from wattlake.operators.pairing import with_queries

HEADER = r"(?m)^(?=#{1,4}\s+\S)"
HEADER_TEXT = r"^#{1,4}\s+(.+?)\s*(?:\n|$)"
CHARS_PER_TOKEN = 4

# Document type per folder name.
DOC_TYPES = {
    "sprints": "sprint", "business-rules": "business", "architecture": "architecture", "ml": "ml", "api": "api",
    "viz": "viz", "implementation": "implementation",
}


def path_metadata(path: Column) -> dict[str, Column]:
    """TXT02: document type and sprint id from a path."""
    parts = F.split(F.lower(path), "/")
    kind = F.when(F.lit(False), "")
    for folder, name in DOC_TYPES.items():
        kind = kind.when(F.array_contains(parts, folder), name)
    file = F.element_at(parts, -1)
    number = F.regexp_extract(file, r"sprint[-_ ]?(\d+)", 1)
    return {
        "doc_type": kind.when(file.isin("readme.md", "claude.md"), "root").otherwise("misc"),
        "sprint_id": F.when(number != "", F.concat(F.lit("sprint-"), F.lpad(F.regexp_replace(number, "^0+(?=.)", ""), 2, "0"))).otherwise(""),
    }


def chunk(docs: DataFrame, key: str, text: str, size_tokens: int = 400, overlap_tokens: int = 60) -> DataFrame:
    """TXT01/UDF06: header blocks, then fixed windows with overlap; pieces under 40 characters are dropped.

    Text before the first header belongs to no block when headers exist.
    """
    width = size_tokens * CHARS_PER_TOKEN
    stride = max(1, width - overlap_tokens * CHARS_PER_TOKEN)
    blocks = F.split(F.col(text), HEADER)
    headed = F.filter(blocks, lambda b: b.rlike(r"^#{1,4}\s+\S"))
    chosen = F.when(F.size(headed) > 0, F.transform(headed, lambda b: F.trim(b))).otherwise(F.array(F.col(text)))
    sections = docs.select(key, F.explode(chosen).alias("_b")).withColumn("_h", F.trim(F.regexp_extract("_b", HEADER_TEXT, 1)))
    starts = F.when(F.char_length("_b") <= width, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.char_length("_b") - 1, F.lit(stride))
    )
    pieces = sections.select(key, "_h", "_b", F.posexplode(starts).alias("indice", "_s")).select(
        key, "_h", "indice", F.trim(F.col("_b").substr(F.col("_s") + 1, F.lit(width))).alias("texto")
    )
    kept = pieces.filter(F.char_length("texto") >= 40)
    anchor = F.when(F.col("_h") != "", slug(F.col("_h"))).otherwise(F.concat(F.lit("c"), F.col("indice").cast("string")))
    named = kept.withColumn("anchor", anchor)
    ident = F.concat_ws("::", F.col(key).cast("string"), "anchor", F.col("indice").cast("string"), F.substring("texto", 1, 120))
    return named.select(
        F.substring(F.sha2(ident, 256), 1, 16).alias("chunk_id"), key, "anchor",
        F.when(F.col("_h") != "", F.col("_h")).otherwise("(sem título)").alias("section"), "indice", "texto",
        F.greatest(F.lit(1), F.floor(F.char_length("texto") / CHARS_PER_TOKEN)).cast("int").alias("token_count"),
    )


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, term, tf, length). Counting happens map-side right after the explode."""
    words = docs.select(key, tokens(F.col(text)).alias("_w")).withColumn("tamanho", F.size("_w"))
    return words.select(key, "tamanho", F.explode("_w").alias("termo")).groupBy(key, "tamanho", "termo").agg(
        F.count(F.lit(1)).alias("tf")
    )


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """TXT06: stored postings of the corpus; write it once and search it any number of times."""
    return postings.build(docs, key, text, tokens)


def hash_embedding(docs: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """TXT04/UDF07: signed hashed term counts, unit length, as sparse rows (key, bucket, peso)."""
    return hashed_terms(terms(docs, key, text), key, dim)


def hashed_terms(counts: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """The same from rows (key, termo, tf), which a stored index has already."""
    hashed = F.conv(F.substring(F.md5("termo"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.pmod(F.conv(F.substring(F.md5("termo"), 9, 2), 16, 10).cast("long"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cells = counts.select(key, F.pmod(hashed, F.lit(dim)).alias("bucket"), (sign * F.col("tf")).alias("w"))
    sums = cells.groupBy(key, "bucket").agg(F.sum("w").alias("w"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return sums.join(norms, key).filter("w <> 0 AND _n > 0").select(key, "bucket", (F.col("w") / F.col("_n")).alias("peso"))


@F.pandas_udf(ArrayType(DoubleType()))
def _fill(buckets: pd.Series, weights: pd.Series, dim: pd.Series) -> pd.Series:
    out = []
    for b, w, n in zip(buckets, weights, dim):
        row = np.zeros(int(n))
        row[np.asarray(b, dtype=int)] = w
        out.append(row)
    return pd.Series(out)


def dense(sparse: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """Sparse rows to one array of ``dim`` values per key (a group holds at most ``dim`` rows)."""
    cells = sparse.groupBy(key).agg(F.collect_list(F.struct("bucket", "peso")).alias("_c"))
    return cells.select(key, _fill(F.col("_c.bucket"), F.col("_c.peso"), F.lit(dim)).alias("vetor"))


def unit(x: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    values = F.transform(x, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.transform(values, lambda v: v / F.when(length == 0, 1.0).otherwise(length))


def _units(values) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype="float64") for v in values])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def cosine_topk(
    queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, qvec: str, cvec: str, k: int, block: int = 256, part: int = 8192
) -> DataFrame:
    """TXT08: exact nearest neighbours of every query, for any number of queries.

    Queries are dealt to blocks of about ``block`` and the corpus to parts of about ``part`` rows; each block meets each part in one task
    as a matrix product, and only the k best rows per query leave it.
    """
    blocks = max(1, -(-queries.count() // block))
    parts = max(1, -(-corpus.count() // part))
    at = ["_block", "_part"]
    asked = queries.select(
        F.col(qkey), F.col(qvec).alias("_v"), F.pmod(F.xxhash64(qkey), F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"),
    )
    rows = corpus.select(
        F.col(ckey), F.col(cvec).alias("_v"), F.pmod(F.xxhash64(ckey), F.lit(parts)).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    )

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            scores = np.round(_units(c["_v"]) @ _units(q["_v"]).T, 9)
            ids = c[ckey].to_numpy()
            for j, name in enumerate(q[qkey]):
                top = np.lexsort((ids, -scores[:, j]))[:k]
                out.append(pd.DataFrame({qkey: [name] * len(top), ckey: ids[top], "cosseno": scores[top, j]}))
        return pd.concat(out) if out else pd.DataFrame({qkey: [], ckey: [], "cosseno": []})

    schema = f"{qkey} {dict(queries.dtypes)[qkey]}, {ckey} {dict(corpus.dtypes)[ckey]}, cosseno double"
    found = asked.groupBy(*at).cogroup(rows.groupBy(*at)).applyInPandas(best, schema)
    return top_per_group(found, [qkey], [F.desc("cosseno"), F.asc(ckey)], k)


def bm25_topk(index: DataFrame, queries: DataFrame, qkey: str, dkey: str, qtext: str, k: int) -> DataFrame:
    """TXT06: the k documents of highest BM25 for each query, from a stored index; repeated query terms count again."""
    wanted = terms(queries, qkey, qtext).select(qkey, "termo", F.col("tf").alias("qtf"))
    return postings.search(index, wanted, qkey, dkey, k)


def _bm25(tf: Column, length: Column, average: Column, n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0) * postings.weight(tf, length, F.greatest(average, F.lit(1.0)))


def jaccard(a: Column, b: Column) -> Column:
    """SET06: shared over all distinct words."""
    left, right = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))


def lexical_in_candidates(candidates: DataFrame, qkey: str, dkey: str, qtext: str, dtext: str) -> DataFrame:
    """TXT07: BM25 inside each query's candidate list, scaled by the best candidate.

    Candidate lists hold k rows per query, so every group here is bounded.
    """
    words = candidates.select(qkey, dkey, tokens(F.col(dtext)).alias("_w"), tokens(F.col(qtext)).alias("_q"))
    stats = words.groupBy(qkey).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_w")).alias("avg"))
    asked = words.select(qkey, dkey, F.size("_w").alias("tamanho"), "_w", F.explode("_q").alias("termo"))
    tf = asked.withColumn("tf", F.size(F.filter("_w", lambda w: w == F.col("termo")))).drop("_w").filter("tf > 0")
    df = tf.select(qkey, dkey, "termo").distinct().groupBy(qkey, "termo").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, [qkey, "termo"]).join(stats, qkey)
    sums = scored.groupBy(qkey, dkey).agg(
        F.sum(_bm25(F.col("tf"), F.col("tamanho"), F.col("avg"), F.col("n"), F.col("df"))).alias("_l")
    )
    peak = sums.groupBy(qkey).agg(F.max("_l").alias("_p"))
    return candidates.join(sums, [qkey, dkey], "left").join(peak, qkey, "left").withColumn(
        "lexico", F.coalesce(F.col("_l") / F.when(F.col("_p") == 0, 1.0).otherwise(F.col("_p")), F.lit(0.0))
    ).drop("_l", "_p")


def lexical_by_jaccard(candidates: DataFrame, qtext: str, dtext: str) -> DataFrame:
    """TXT07: the fallback signal, shared over all distinct words, where no index or word statistics are at hand; it needs no scaling."""
    return candidates.withColumn("lexico", jaccard(F.col(qtext), F.col(dtext)))


def anchor_bonus(question: Column, anchor: Column, region: Column) -> Column:
    """TXT08: intent, region and structure bonuses of an anchor."""
    q, a = F.lower(question), F.lower(F.coalesce(anchor, F.lit("")))
    has = lambda *ts: q.rlike("|".join(ts))
    add = lambda cond, value: F.when(cond, value).otherwise(0.0)
    shared = a.startswith("ce-vs-sp-") | a.isin("instalacoes-por-regional", "sazonalidade-ce-sp", "motivos-taxonomia-ce-sp")
    return (
        add(has("instala") & a.contains("instal"), 0.08)
        + add(has("assunto", "tema") & a.contains("assunto"), 0.06)
        + add(has("causa", "motivo") & a.rlike("causa|observacoes"), 0.06)
        + add(has("sazon", "mensal") & a.rlike("mensal|sazon"), 0.05)
        + add(has("reincid") & a.contains("reincid"), 0.06)
        + add(has("medidor", "fatura", "perfil") & a.contains("perfil"), 0.06)
        + add(
            F.coalesce((region == "SP") & a.startswith("sp-") | (region == "CE") & a.startswith("ce-"), F.lit(False)), 0.06
        )
        + add(F.coalesce((region == "CE+SP") & shared, F.lit(False)), 0.05)
        + add(q.contains("refaturamento produtos") & a.contains("ce-reclamacoes-totais"), 0.07)
        + add(has("motivo", "causa") & q.contains("medidor") & a.contains("sp-causas-por-tipo-medidor"), 0.08)
        + add(has("taxonomia", "motivo consolidado") & a.contains("motivos-taxonomia"), 0.06)
    )


def hybrid(candidates: DataFrame, bonus: Column | None = None) -> DataFrame:
    """TXT08: 0.60 cosine + 0.40 lexical + bonuses."""
    base = F.greatest(F.col("cosseno"), F.lit(0.0)) * 0.60 + F.col("lexico") * 0.40
    return candidates.withColumn("score", base + bonus if bonus is not None else base)


def rescore(passages: DataFrame, qkey: str, second: str) -> DataFrame:
    """TXT10: 0.35 first score + 0.65 second score scaled by its peak per query."""
    peak = passages.groupBy(qkey).agg(F.max(second).alias("_p"))
    scaled = F.greatest(F.lit(0.0), F.col(second) / F.when(F.coalesce("_p", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_p")))
    return passages.join(peak, qkey).withColumn("score", F.col("score") * 0.35 + scaled * 0.65).drop("_p")


def region_scope(passages: DataFrame, region: str | None) -> DataFrame:
    """Metadata filter of a regional question."""
    scopes = {"CE": ("CE", "CE+SP"), "SP": ("SP", "CE+SP"), "CE+SP": ("CE", "SP", "CE+SP")}
    return passages.filter(F.col("region").isin(*scopes[region])) if region in scopes else passages


def by_anchors(passages: DataFrame, requests: DataFrame, qkey: str) -> DataFrame:
    """TXT09: one passage per requested anchor, in request order."""
    wanted = requests.select(qkey, F.posexplode("anchors").alias("posicao", "anchor"))
    one = passages.groupBy("anchor").agg(F.max_by(F.struct("chunk_id", "texto"), F.struct("dataset_version", "chunk_id")).alias("p"))
    return wanted.join(one, "anchor").select(qkey, "posicao", "anchor", "p.chunk_id", "p.texto", F.lit(0.99).alias("score"))


def within_budget(passages: DataFrame, qkey: str, budget: int, order: list[Column]) -> DataFrame:
    """TXT11: passages kept while their running token count fits; candidate lists are bounded per query."""
    from pyspark.sql import Window as W

    running = W.partitionBy(qkey).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    need = F.greatest(F.lit(1), F.floor((F.char_length("texto") + 2) / 3))
    return passages.withColumn("tokens_acumulados", F.sum(need).over(running)).filter(F.col("tokens_acumulados") <= budget)


def merge_ranked(primary: DataFrame, secondary: DataFrame, qkey: str, limit: int) -> DataFrame:
    """SET07: union of two lists keeping the best score per passage."""
    both = primary.select(qkey, "chunk_id", "score").unionByName(secondary.select(qkey, "chunk_id", "score"))
    best = both.groupBy(qkey, "chunk_id").agg(F.max("score").alias("score"))
    return top_per_group(best, [qkey], [F.desc("score"), F.asc("chunk_id")], limit)


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series, floor: pd.Series) -> pd.Series:
    """UDF08: matching-blocks ratio of two texts; cheap upper bounds settle pairs that cannot reach the floor."""
    out = []
    for x, y, low in zip(a, b, floor):
        m = SequenceMatcher(None, x, y)
        out.append(m.ratio() if m.real_quick_ratio() >= low and m.quick_ratio() >= low else 0.0)
    return pd.Series(out, dtype="float64")


def known_questions(questions: DataFrame, seeds: DataFrame, min_ratio: float = 0.92) -> DataFrame:
    """TXT12: exact match on the normal form, else the best seed whose ratio reaches the minimum.

    Every question without an exact match meets every seed in bounded blocks. Pairs whose lengths already rule the
    ratio out are dropped by an exact bound before the comparison.
    """
    q = questions.select("question_id", normal_question(F.col("question")).alias("_n"))
    s = seeds.select("seed_id", normal_question(F.col("question")).alias("_m"))
    exact = (
        q.join(s, F.col("_n") == F.col("_m")).groupBy("question_id").agg(F.min("seed_id").alias("seed_id"))
        .withColumn("ratio", F.lit(1.0))
    )
    rest = q.join(exact.select("question_id"), "question_id", "left_anti")
    pairs = with_queries(rest, s, F.struct("seed_id", "_m"), "question_id", "seed_id")
    a, z = F.char_length("_n"), F.char_length("_q._m")
    possible = pairs.filter(F.least(a, z) * 2.0 >= F.lit(min_ratio) * (a + z))
    close = possible.withColumn("ratio", match_ratio("_n", F.col("_q._m"), F.lit(min_ratio))).filter(F.col("ratio") >= min_ratio)
    best = close.groupBy("question_id").agg(
        F.max_by(F.struct(F.col("_q.seed_id").alias("seed_id"), "ratio"), F.struct("ratio", F.col("_q.seed_id"))).alias("b")
    ).select("question_id", "b.seed_id", "b.ratio")
    return exact.unionByName(best)


def cluster_corpus(rows: DataFrame, cluster: str, order: str, text: str, min_rows: int = 5, limit: int = 6) -> DataFrame:
    """TXT03: clusters with enough rows and up to six distinct redacted exemplars of 80 to 1200 characters."""
    from wattlake.functions.text import CPF, PHONE, squeeze

    clean = squeeze(F.regexp_replace(F.regexp_replace(text, PHONE + r"\b", "[TELEFONE]"), CPF, "[CPF]"))
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("registros")).filter(F.col("registros") >= min_rows)
    texts = (
        rows.select(cluster, order, clean.alias("_t")).filter(F.char_length("_t").between(80, 1200))
        .groupBy(cluster, "_t").agg(F.min(order).alias("_o"))
    )
    kept = top_per_group(texts, [cluster], [F.asc("_o")], limit, "posicao")
    return kept.join(sizes, cluster).select(cluster, "registros", "posicao", F.col("_t").alias("exemplo"))
