"""Text cleaning, classification, retrieval, evaluation and telemetry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattlake import bindings as b
from wattlake import runtime
from wattlake.catalog.base import add
from wattlake.catalog.operation_queries import q
from wattlake.catalog.sqlparts import COMPLAINTS, classifier_ctes, clean, in_list, lit, theme
from wattlake.catalog.sqlparts import fold as fold_sql
from wattlake.functions import questions as qs
from wattlake.functions import taxonomy as tax
from wattlake.functions import text as tx
from wattlake.functions import themes as th
from wattlake.operators import postings
from wattlake.plans import evaluation as ev
from wattlake.plans import fallback as fb
from wattlake.plans import retrieval as rt
from wattlake.plans import telemetry as tm
from wattlake.plans import textmodels
from wattlake.plans.surfaces import apply_boosts


def docs(spark, sf):
    return runtime.spread(b.table(spark, sf, "documents"))


# ---- cleaning and masks ---------------------------------------------------------------------------------------
q(
    "clean_documents", lambda s, d: docs(s, d).select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("md5")),
    f"SELECT doc_id, md5({clean('text')}) AS md5 FROM documents",
)
q(
    "clean_pages",
    lambda s, d: runtime.spread(b.table(s, d, "pages")).select("page_id", F.md5(tx.clean_text(F.col("html"))).alias("md5")),
    f"SELECT page_id, md5({clean('html')}) AS md5 FROM pages",
)


def _joined(x: str, pattern: str, group: int) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({x}, {lit(pattern)}, {group}))), '|')"


q(
    "document_entities",
    lambda s, d: docs(s, d).withColumn("t", tx.clean_text(F.col("text"))).select(
        "doc_id", *[F.concat_ws("|", v).alias(k) for k, v in tx.extract_entities(F.col("t")).items()]
    ),
    f"""WITH c AS (SELECT doc_id, {clean("text")} AS t FROM documents) SELECT doc_id, {_joined("t", tx.PHONE, 0)} AS telefones_extraidos,
{_joined("t", tx.CEP, 0)} AS ceps_extraidos, {_joined("t", tx.PROTOCOL, 1)} AS protocolos_extraidos, {_joined("t", tx.DAY_TEXT, 0)}
AS datas_extraidas, {_joined("t", tx.INSTALLATION, 1)} AS instalacoes_mencionadas FROM c""",
)


def _masked(steps) -> str:
    out = "text"
    for pattern, label in steps:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(label)}, 'g')"
    return out


_M7 = [(tx.CPF, "[CPF]"), (tx.CNPJ, "[CNPJ]"), (tx.PHONE_WORD, "[TELEFONE]")]
_M8 = [(tx.CPF, "[CPF]"), (tx.CNPJ, "[CNPJ]"), (tx.EMAIL, "[EMAIL]"), (tx.PHONE_WORD, "[TELEFONE]")]
_M9 = [
    (r"\d{3}\.\d{3}\.\d{3}-\d{2}", "[CPF_REDACTED]"), (r"\b\d{11}\b", "[CPF_REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\(?\d{2}\)?\s?\d{4,5}-?\d{4}", "[PHONE_REDACTED]"),
]
q(
    "pii_masks",
    lambda s, d: docs(s, d).select(
        "doc_id", F.md5(tx.mask_registry_numbers(F.col("text"))).alias("m7"), F.md5(tx.mask_pii(F.col("text"))).alias("m8"),
        F.md5(tx.redact_pii(F.col("text"))).alias("m9"),
    ),
    f"SELECT doc_id, md5(trim({_masked(_M7)})) AS m7, md5({_masked(_M8)}) AS m8, md5({_masked(_M9)}) AS m9 FROM documents",
)
add(
    "sensitive_masks",
    lambda s, d: docs(s, d).select("doc_id", F.md5(tx.mask_sensitive(F.col("text"))).alias("md5"), tx.bounded_example(F.col("text")).alias("exemplo")),
)
q(
    "document_excerpts",
    lambda s, d: docs(s, d).select(
        "doc_id", tx.pseudonym(F.col("source")).alias("id"), tx.excerpt(F.col("text")).alias("resumo"), tx.slug(F.col("text")).alias("slug"),
        tx.upper_trim(F.col("source")).alias("fonte"),
    ),
    """WITH t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, substr(sha256(source), 1, 12) AS id, CASE WHEN length(s) <= 220 THEN s ELSE regexp_replace(substr(s, 1, 219), ' [^ ]*$', '') || '…' END
AS resumo, substr(regexp_replace(trim(regexp_replace(lower(text), '[^\\pL\\pN\\pM_\\s-]', '', 'g')), '[\\s_]+', '-', 'g'), 1, 64) AS slug,
upper(source) AS fonte FROM t""",
)

# ---- classification -------------------------------------------------------------------------------------------
_CLS_OUT = "SELECT doc_id, classe, confidence, round(probabilidade, 4) AS probabilidade, score_bruto, top3 FROM documents JOIN cls ON txt = text"
q(
    "taxonomy_classify",
    lambda s, d: tax.classify(docs(s, d), "text", full=True).select(
        "doc_id", "classe", "confidence", "probabilidade", "score_bruto", F.concat_ws("|", F.col("top3.classe")).alias("top3")
    ),
    "src AS (SELECT text AS txt FROM documents)", classifier_ctes("src"), _CLS_OUT,
)
q(
    "classify_distinct_answers",
    lambda s, d: tax.classify_distinct(b.complaints(s, d).select("ordem", "linha", "devolutiva"), "devolutiva").groupBy("classe", "confidence").agg(
        F.count(F.lit(1)).alias("n")
    ),
    COMPLAINTS,
    "src AS (SELECT devolutiva AS txt FROM complaints)", classifier_ctes("src"),
    "SELECT classe, confidence, count(*) AS n FROM complaints JOIN cls ON txt = devolutiva GROUP BY 1, 2",
)


def _fallback(spark, sf):
    rows = tax.classify(docs(spark, sf), "text").select("doc_id", "text", "classe")
    version = runtime.dataset_version(spark, [f"{sf}/documents.parquet"])
    keep = lambda df, name: runtime.materialise(spark, lambda: df, f"fallback_{name}", version)
    # Classified once: the rows are read by the word counts and by the labels.
    kept = runtime.materialise(spark, lambda: rows, "classified_documents", version)
    return fb.fallback_labels(kept, "doc_id", "text", "classe", UNDEFINED, keep)


UNDEFINED = "indefinido"
_FB = """
fo AS MATERIALIZED (SELECT doc_id, classe, regexp_extract_all(lower({t}), '[\\pL\\pM\\pN_]{{3,}}') AS ws, {h} AS te FROM documents JOIN cls ON txt = text),
ft AS MATERIALIZED (SELECT doc_id, classe, te, t, count(*) AS tf FROM (SELECT doc_id, classe, te, unnest(ws) AS t FROM fo) GROUP BY ALL),
us AS MATERIALIZED (SELECT t, classe AS rotulo, sum(tf)::DOUBLE AS n FROM ft WHERE classe <> 'indefinido' AND NOT te GROUP BY 1, 2),
cl AS MATERIALIZED (SELECT classe AS rotulo, count(*)::DOUBLE AS k, coalesce((SELECT sum(n) FROM us WHERE us.rotulo = fo.classe), 0) AS w FROM fo
  WHERE classe <> 'indefinido' AND NOT te GROUP BY classe),
aq AS (SELECT doc_id, len(ws) AS m FROM fo WHERE classe = 'indefinido' OR te),
sw AS (SELECT ft.doc_id, us.rotulo, sum(tf * ln(n + 1)) AS s FROM ft JOIN us USING (t) GROUP BY 1, 2),
sc AS MATERIALIZED (SELECT aq.doc_id, cl.rotulo, round(ln(k / (SELECT sum(k) FROM cl)) - m * ln(w + (SELECT count(DISTINCT t) FROM us)) + coalesce(s, 0), 6) AS s
  FROM aq CROSS JOIN cl LEFT JOIN sw ON sw.doc_id = aq.doc_id AND sw.rotulo = cl.rotulo),
mx AS (SELECT doc_id, max(s) AS x FROM sc GROUP BY 1),
fl AS (SELECT doc_id, min(rotulo) FILTER (s = x) AS r, 1 / sum(exp(s - x)) AS c FROM sc JOIN mx USING (doc_id) GROUP BY 1),
fb AS MATERIALIZED (SELECT doc_id, classe, CASE WHEN classe <> 'indefinido' THEN classe ELSE coalesce(r, 'indefinido') END AS rotulo,
  CASE WHEN classe <> 'indefinido' THEN 1 ELSE coalesce(c, 0) END AS confianca, CASE WHEN classe <> 'indefinido' AND te THEN r = classe END AS conferido
  FROM fo LEFT JOIN fl USING (doc_id))""".format(t=fold_sql("text"), h="('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT % 5 = 0")
q("fallback_labels", lambda s, d: _fallback(s, d).drop("previsto"), "src AS (SELECT text AS txt FROM documents)", classifier_ctes("src"), _FB, "SELECT * FROM fb")
q(
    "fallback_coverage", lambda s, d: fb.coverage(_fallback(s, d), UNDEFINED), "src AS (SELECT text AS txt FROM documents)", classifier_ctes("src"), _FB,
    "SELECT count(*) AS registros, count(*) FILTER (classe = 'indefinido') AS indefinidos_antes, count(*) FILTER (rotulo = 'indefinido') AS indefinidos_depois, "
    "count(conferido) AS conferidos, count(*) FILTER (conferido) AS concordantes FROM fb",
)
q(
    "fallback_macro_f1",
    lambda s, d: textmodels.macro_f1(_fallback(s, d).filter("conferido IS NOT NULL"), [], "classe", "previsto"),
    "src AS (SELECT text AS txt FROM documents)", classifier_ctes("src"), _FB,
    "h AS (SELECT classe AS y, r AS p FROM fo JOIN fl USING (doc_id) WHERE classe <> 'indefinido' AND te)",
    "k AS (SELECT y AS c FROM h UNION SELECT p FROM h)",
    """SELECT round(avg(f), 6) AS macro_f1, count(*) AS classes FROM (SELECT c, (SELECT 2.0 * count(*) FILTER (y = c AND p = c)
/ (count(*) FILTER (y = c) + count(*) FILTER (p = c)) FROM h) AS f FROM k)""",
)
q(
    "page_themes",
    lambda s, d: runtime.spread(b.table(s, d, "pages")).groupBy(th.theme_of(tx.clean_text(F.col("html"))).alias("tema")).agg(F.count(F.lit(1)).alias("n")),
    f"WITH p AS (SELECT {clean('html')} AS t FROM pages) SELECT {theme('t')} AS tema, "
    "count(*) AS n FROM p GROUP BY 1",
)

# ---- chunks, embeddings, lexical and hybrid retrieval ---------------------------------------------------------
q(
    "chunk_documents", lambda s, d: rt.chunk(docs(s, d), "doc_id", "text").drop("texto").withColumn("section", F.col("section")),
    r"""WITH m AS (SELECT doc_id, text, string_split(regexp_replace(text, '(^|\n)(#{1,4}\s+\S)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents),
h AS (SELECT doc_id, text, list_filter(parts, lambda p: regexp_matches(p, '^#{1,4}\s+\S')) AS hd FROM m),
s AS (SELECT doc_id, unnest(CASE WHEN len(hd) > 0 THEN list_transform(hd, lambda p: trim(p)) ELSE [text] END) AS b FROM h),
s2 AS MATERIALIZED (SELECT doc_id, b, trim(regexp_extract(b, '^#{1,4}\s+(.+?)\s*(?:\n|$)', 1)) AS hx, length(b) AS n FROM s),
w AS (SELECT doc_id, hx, r.i AS indice, trim(substr(b, CAST(r.i * 1360 + 1 AS BIGINT), 1600)) AS texto FROM s2 JOIN range(0, 2000) r(i)
  ON r.i = 0 OR (n > 1600 AND r.i * 1360 < n)),
k AS (SELECT *, CASE WHEN hx <> '' THEN substr(regexp_replace(trim(regexp_replace(lower(hx), '[^\pL\pN\pM_\s-]', '', 'g')), '[\s_]+', '-', 'g'), 1, 64)
  ELSE 'c' || indice END AS anchor FROM w WHERE length(texto) >= 40)
SELECT substr(sha256(doc_id || '::' || anchor || '::' || indice || '::' || substr(texto, 1, 120)), 1, 16) AS chunk_id, doc_id, anchor,
CASE WHEN hx <> '' THEN hx ELSE '(sem título)' END AS section, CAST(indice AS INTEGER) AS indice,
CAST(greatest(1, length(texto) // 4) AS INTEGER) AS token_count FROM k""",
)
_TOK = "regexp_extract_all(lower({x}), '[\\pL\\pM\\pN_]{{3,}}')"


def _terms(name: str, table: str, key: str, text: str) -> str:
    return (
        f"{name}0 AS MATERIALIZED (SELECT {key}, {_TOK.format(x=text)} AS ws FROM {table}), "
        f"{name}1 AS MATERIALIZED (SELECT {key}, len(ws) AS len, unnest(ws) AS t FROM {name}0), "
        f"{name} AS MATERIALIZED (SELECT {key}, len, t, count(*) AS tf FROM {name}1 GROUP BY ALL)"
    )


def _embed(name: str, terms: str, key: str) -> str:
    sign = "CASE WHEN ('0x' || substr(md5(t), 9, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END"
    return (
        f"{name}0 AS (SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8))::UBIGINT % 256 AS BIGINT) AS bucket, sum({sign} * tf)::DOUBLE AS w FROM {terms} GROUP BY ALL), "
        f"{name} AS MATERIALIZED (SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS p FROM {name}0 WHERE w <> 0)"
    )


q(
    "hash_embeddings",
    lambda s, d: rt.hash_embedding(b.table(s, d, "benchmark"), "item_id", "text").withColumn("peso", F.round("peso", 6)),
    _terms("bt", "benchmark", "item_id", "text"), _embed("be", "bt", "item_id"),
    "SELECT item_id, bucket, round(p, 6) AS peso FROM be",
)


def _index(spark, sf):
    """The corpus index, tokenised and written once per dataset version."""
    version = runtime.dataset_version(spark, [f"{sf}/documents.parquet"])
    return runtime.materialise(spark, lambda: rt.index(docs(spark, sf), "doc_id", "text"), "postings", version)


_BM = """
st AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM dt0), fr AS (SELECT t, count(*) AS df FROM dt GROUP BY 1),
bm AS MATERIALIZED (SELECT item_id, doc_id, sum(bt.tf * ln((n - df + 0.5) / (df + 0.5) + 1) * dt.tf * 2.5 / (dt.tf + 1.5 * (0.25 + 0.75 * dt.len / av))) AS s
  FROM dt JOIN bt USING (t) JOIN fr USING (t), st GROUP BY 1, 2)"""
q(
    "bm25_topk",
    lambda s, d: rt.bm25_topk(_index(s, d), b.table(s, d, "benchmark"), "item_id", "doc_id", "text", 10),
    _terms("dt", "documents", "doc_id", "text"), _terms("bt", "benchmark", "item_id", "text"), _BM,
    "SELECT item_id, doc_id, bm25, CAST(rn AS INTEGER) AS rank FROM (SELECT item_id, doc_id, round(s, 6) AS bm25, row_number() OVER "
    "(PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS rn FROM bm) WHERE rn <= 10",
)


def _centroids(spark, sf):
    """One query vector per topic label: the mean of its embeddings, aggregated per (label, position)."""
    e = b.table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centro"))


q(
    "cosine_topk",
    lambda s, d: rt.cosine_topk(_centroids(s, d), b.table(s, d, "embeddings"), "label", "vec_id", "centro", "embedding", 5).withColumn(
        "cosseno", F.round("cosseno", 6)
    ).drop("rank"),
    """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1),
un AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM u GROUP BY 1),
s AS (SELECT c.label, u.vec_id, sum(u.v * c.m) / any_value(cn.n) / any_value(un.n) AS s FROM u JOIN c USING (i) JOIN cn ON cn.label = c.label
  JOIN un ON un.vec_id = u.vec_id GROUP BY 1, 2)
SELECT label, vec_id, round(s, 6) AS cosseno FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rn FROM s) WHERE rn <= 5""",
)


def _candidates(spark, sf):
    """Candidate lists are short and read several times by the lexical step, so they are written once per version."""
    version = runtime.dataset_version(spark, [f"{sf}/documents.parquet", f"{sf}/benchmark.parquet"])
    return runtime.materialise(spark, lambda: _build_candidates(spark, sf), "candidates", version)


def _build_candidates(spark, sf, k: int = 10):
    """Cosine candidates of every benchmark passage over the hashed document vectors, with both texts."""
    corpus, bench = docs(spark, sf), b.table(spark, sf, "benchmark")
    dv = rt.dense(rt.hashed_terms(postings.postings(_index(spark, sf), "doc_id"), "doc_id"), "doc_id")
    qv = rt.dense(rt.hash_embedding(bench, "item_id", "text"), "item_id")
    near = rt.cosine_topk(qv, dv, "item_id", "doc_id", "vetor", "vetor", k)
    return near.join(corpus.select("doc_id", F.col("text").alias("passagem"), "lang"), "doc_id").join(
        bench.select("item_id", F.col("text").alias("pergunta")), "item_id"
    )


def _hybrid(spark, sf):
    cand = _candidates(spark, sf)
    lex = rt.lexical_in_candidates(cand, "item_id", "doc_id", "pergunta", "passagem")
    bonus = rt.anchor_bonus(F.col("pergunta"), F.concat(F.lit("ce-"), "lang"), F.lit("CE"))
    return rt.hybrid(lex, bonus)


_CAND = """
co AS (SELECT be.item_id, de.doc_id, round(sum(be.p * de.p), 9) AS c FROM de JOIN be USING (bucket) GROUP BY 1, 2),
nn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS rn FROM co) WHERE rn <= 10),
cs AS (SELECT item_id, count(*) AS n, avg(len(ws)) AS av FROM nn JOIN dt0 USING (doc_id) GROUP BY 1),
ct AS MATERIALIZED (SELECT nn.item_id, nn.doc_id, dt.len, dt.t, dt.tf, bt.tf AS qtf FROM nn JOIN dt ON dt.doc_id = nn.doc_id JOIN bt ON bt.item_id = nn.item_id AND bt.t = dt.t),
cf AS (SELECT item_id, t, count(DISTINCT doc_id) AS df FROM ct GROUP BY 1, 2),
cl AS (SELECT ct.item_id, ct.doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) AS l
  FROM ct JOIN cf ON cf.item_id = ct.item_id AND cf.t = ct.t JOIN cs ON cs.item_id = ct.item_id GROUP BY 1, 2),
hy AS MATERIALIZED (SELECT nn.item_id, nn.doc_id, c, coalesce(l / max(l) OVER (PARTITION BY nn.item_id), 0) AS x FROM nn LEFT JOIN cl
  ON cl.item_id = nn.item_id AND cl.doc_id = nn.doc_id),
hs AS MATERIALIZED (SELECT *, greatest(c, 0) * 0.6 + x * 0.4 + 0.06 AS s FROM hy)"""
_HYB = [
    _terms("dt", "documents", "doc_id", "text"), _terms("bt", "benchmark", "item_id", "text"), _embed("de", "dt", "doc_id"),
    _embed("be", "bt", "item_id"), _CAND,
]
q(
    "hybrid_topk",
    lambda s, d: _hybrid(s, d).select(
        "item_id", "doc_id", F.round("cosseno", 6).alias("cosseno"), F.round("lexico", 6).alias("lexico"), F.round("score", 6).alias("score")
    ),
    *_HYB,
    "SELECT item_id, doc_id, round(c, 6) AS cosseno, round(x, 6) AS lexico, round(s, 6) AS score FROM hs",
)
q(
    "hybrid_jaccard_topk",
    lambda s, d: rt.hybrid(rt.lexical_by_jaccard(_candidates(s, d), "pergunta", "passagem")).select(
        "item_id", "doc_id", F.round("lexico", 6).alias("lexico"), F.round("score", 6).alias("score")
    ),
    *_HYB,
    ", jc AS (SELECT item_id, doc_id, c, len(list_intersect(list_distinct(a.ws), list_distinct(z.ws))) / len(list_distinct(list_concat(a.ws, z.ws))) AS x "
    "FROM nn JOIN bt0 a USING (item_id) JOIN dt0 z USING (doc_id)) SELECT item_id, doc_id, round(x, 6) AS lexico, round(greatest(c, 0) * 0.6 + x * 0.4, 6) AS score FROM jc",
)
q(
    "rescored_passages",
    lambda s, d: rt.rescore(_hybrid(s, d).withColumn("segundo", F.char_length("passagem").cast("double")), "item_id", "segundo").select(
        "item_id", "doc_id", F.round("score", 6).alias("score")
    ),
    *_HYB,
    "SELECT item_id, doc_id, round(s * 0.35 + 0.65 * length(text) / max(length(text)) OVER (PARTITION BY item_id), 6) AS score FROM hs JOIN documents USING (doc_id)",
)
q(
    "context_budget",
    lambda s, d: rt.within_budget(
        _hybrid(s, d).withColumn("texto", F.col("passagem")).withColumn("r", F.round("score", 6)), "item_id", 3000, [F.desc("r"), F.asc("doc_id")]
    ).select("item_id", "doc_id", "tokens_acumulados"),
    *_HYB,
    "SELECT * FROM (SELECT item_id, doc_id, CAST(sum(greatest(1, (length(text) + 2) // 3)) OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id "
    "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_acumulados FROM hs JOIN documents USING (doc_id)) WHERE tokens_acumulados <= 3000",
)
q(
    "passage_jaccard",
    lambda s, d: _candidates(s, d).select("item_id", "doc_id", F.round(rt.jaccard(F.col("pergunta"), F.col("passagem")), 6).alias("jaccard")),
    *_HYB,
    "SELECT item_id, doc_id, round(len(list_intersect(list_distinct(a.ws), list_distinct(z.ws))) / len(list_distinct(list_concat(a.ws, z.ws))), 6) AS jaccard "
    "FROM nn JOIN bt0 a USING (item_id) JOIN dt0 z USING (doc_id)",
)


def _eval_metrics(spark, sf):
    """Metrics of the ranked documents of each passage against the documents that hold the whole passage, word for word.

    Documents and passages meet on hashed windows of up to eight opening words, an equi-join over text that grows with the corpus; of
    those that meet the whole passage is compared.
    """
    nth = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("s"), "doc_id"))  # a passage has at most k candidates
    ranked = _hybrid(spark, sf).select("item_id", "doc_id", F.round("score", 6).alias("s")).withColumn("posicao", nth)
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0))
    opening = 8
    bench = b.table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("p")).filter("size(p) > 0").select(
        "item_id", F.array_join("p", " ").alias("passagem"), F.least(F.size("p"), F.lit(opening)).alias("n"),
        F.array_join(F.slice("p", 1, opening), " ").alias("janela"),
    )
    lengths = F.array(*[F.lit(r["n"]) for r in bench.select("n").distinct().collect()]).cast("array<int>")  # at most eight numbers
    rows = docs(spark, sf).select("doc_id", words(F.col("text")).alias("w"))
    sized = rows.select("doc_id", "w", F.explode(lengths).alias("n")).filter(F.size("w") >= F.col("n"))
    windows = sized.select(
        "doc_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("janela")
    )
    met = windows.join(bench.select("n", "janela").distinct(), ["n", "janela"], "left_semi").distinct().join(bench, ["n", "janela"])
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    held = met.join(rows.select("doc_id", spaced(F.array_join("w", " ")).alias("texto")), "doc_id").filter(F.contains("texto", spaced(F.col("passagem"))))
    return ev.pair_metrics(ranked, held, "item_id", "doc_id")


_EVAL = """
bw AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\pL\\pM\\pN_]+'), ' ') || ' ' AS j FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\pL\\pM\\pN_]+'), ' ') || ' ' AS t FROM documents),
ex AS MATERIALIZED (SELECT item_id, doc_id FROM bw JOIN dw ON contains(t, j)),
rk AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS r FROM hs),
en AS (SELECT item_id, count(*) AS n FROM ex GROUP BY 1),
ht AS (SELECT rk.item_id, r FROM rk JOIN ex ON ex.item_id = rk.item_id AND ex.doc_id = rk.doc_id),
mt AS MATERIALIZED (SELECT i.item_id, coalesce(n, 0) AS n, coalesce((SELECT count(*) FROM ht WHERE ht.item_id = i.item_id AND r <= 5), 0) AS h5,
  (SELECT min(r) FROM ht WHERE ht.item_id = i.item_id AND r <= 10) AS fr,
  coalesce((SELECT sum(1 / log2(r + 1)) FROM ht WHERE ht.item_id = i.item_id AND r <= 10), 0) AS dcg,
  (SELECT sum(1 / log2(g + 1)) FROM range(1, 11) x(g) WHERE g <= least(coalesce(n, 0), 10)) AS idcg
  FROM (SELECT DISTINCT item_id FROM rk) i LEFT JOIN en ON en.item_id = i.item_id)"""
q(
    "retrieval_metrics",
    _eval_metrics,
    *_HYB, _EVAL,
    "SELECT item_id, n AS esperados, CASE WHEN n = 0 THEN 1 ELSE round(h5 / n, 4) END AS recall_5, CASE WHEN n = 0 THEN 1 ELSE round(coalesce(1 / fr, 0), 4) "
    "END AS mrr_10, CASE WHEN n = 0 THEN 1 ELSE round(dcg / idcg, 4) END AS ndcg_10 FROM mt",
)
q(
    "retrieval_summary",
    lambda s, d: _eval_metrics(s, d).agg(
        F.count(F.lit(1)).alias("casos"), F.round(F.avg("recall_5"), 4).alias("recall_5"), F.round(F.avg("mrr_10"), 4).alias("mrr_10"),
        F.round(F.avg("ndcg_10"), 4).alias("ndcg_10")),
    *_HYB, _EVAL,
    "SELECT count(*) AS casos, round(avg(CASE WHEN n = 0 THEN 1 ELSE round(h5 / n, 4) END), 4) AS recall_5, round(avg(CASE WHEN n = 0 THEN 1 ELSE "
    "round(coalesce(1 / fr, 0), 4) END), 4) AS mrr_10, round(avg(CASE WHEN n = 0 THEN 1 ELSE round(dcg / idcg, 4) END), 4) AS ndcg_10 FROM mt",
)
q(
    "cluster_exemplars",
    lambda s, d: rt.cluster_corpus(docs(s, d), "source", "doc_id", "text").select("source", "registros", "posicao", F.md5("exemplo").alias("md5")),
    f"""WITH t AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, {lit(tx.PHONE + chr(92) + "b")}, '[TELEFONE]', 'g'),
{lit(tx.CPF)}, '[CPF]', 'g'), '\\s+', ' ', 'g')) AS x FROM documents), n AS (SELECT source, count(*) AS registros FROM documents GROUP BY 1 HAVING count(*) >= 5),
g AS (SELECT source, x, min(doc_id) AS o FROM t WHERE length(x) BETWEEN 80 AND 1200 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY o) AS INTEGER) AS posicao FROM g)
SELECT source, registros, posicao, md5(x) AS md5 FROM r JOIN n USING (source) WHERE posicao <= 6""",
)

# ---- questions ------------------------------------------------------------------------------------------------


def _questions(spark, sf):
    return b.table(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question")
    )


_QU = "qu AS (SELECT conv_id || '-' || turn AS question_id, text AS question FROM conversations WHERE role = 'user')"
_CANON = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(question)), '[''\"][^''\"]{0,200}[''\"]', '§', 'g'), "
    "'\\[[^\\]]{0,80}\\]', '§', 'g'), '\\b\\d{2,}\\b', '§', 'g'), '[\\.,;:!\\?\\(\\)\\[\\]\\{\\}\"''\\-_/\\\\]+', ' ', 'g'), '\\s+', ' ', 'g'))"
)
q(
    "question_canonical",
    lambda s, d: _questions(s, d).select(
        "question_id", F.md5(qs.canonical_question(F.col("question"))).alias("canonica"), F.md5(qs.token_set(F.col("question"))).alias("termos")
    ),
    _QU,
    f", c AS (SELECT question_id, {_CANON} AS c FROM qu) SELECT question_id, md5(c) AS canonica, md5(array_to_string(list_sort(list_distinct(list_filter("
    f"string_split(c, ' '), lambda w: w <> '' AND w NOT IN {in_list(qs.STOPWORDS)}))), ' ')) AS termos FROM c",
)


def _any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


q(
    "question_routing",
    lambda s, d: _questions(s, d).select(
        "question_id", qs.intent(F.col("question")).alias("intencao"), qs.input_check(F.col("question"))["reason"].alias("bloqueio"),
        F.md5(qs.expand_query(F.col("question"))).alias("expandida"),
    ),
    _QU,
    f", l AS (SELECT *, trim(lower(question)) AS t FROM qu) SELECT question_id, CASE WHEN regexp_matches(t, {lit(qs.GREETING)}) THEN 'saudacao' "
    + " ".join(f"WHEN {_any('t', terms)} THEN {lit(name)}" for name, terms in qs.INTENT_TERMS)
    + f" ELSE 'glossario' END AS intencao, CASE WHEN t = '' THEN 'empty' WHEN length(trim(question)) > 2000 THEN 'too_long' WHEN "
    + f"{_any('t', qs.INJECTION_PHRASES)} THEN 'injection' ELSE '' END AS bloqueio, md5(concat_ws(' ', trim(question)"
    + "".join(f", CASE WHEN contains(t, {lit(k)}) THEN {lit(' '.join(w))} END" for k, w in qs.EXPANSIONS)
    + ")) AS expandida FROM l",
)
add(
    "question_scope",
    lambda s, d: _questions(s, d).select(
        "question_id", qs.region_of(F.col("question")).alias("regiao"), qs.out_of_region(F.col("question")).alias("fora"),
        F.concat_ws(",", qs.route(F.col("question"))).alias("tipos"), F.concat_ws(",", qs.card_boosts(F.col("question"))).alias("cartoes"),
    ),
)
add(
    "known_question_matches",
    lambda s, d: rt.known_questions(
        _questions(s, d), _questions(s, d).filter("question_id LIKE '%-0'").select(F.col("question_id").alias("seed_id"), "question"), 0.6
    ),
)


def _answers(spark, sf):
    """User turns with the next assistant turn of the conversation, by equi-join on the following turn number."""
    c = b.table(spark, sf, "conversations")
    ask = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    say = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    words = tx.tokens(F.col("question"), 4)
    return ask.join(say, ["conv_id", "turn"]).withColumns(
        {"expected": F.slice(words, 1, 3), "forbidden": F.slice(F.reverse(words), 1, 2), "must_refuse": F.col("conv_id") % 2 == 0}
    )


_ANS = """
an AS MATERIALIZED (SELECT a.conv_id, s.turn, a.text AS question, s.text AS answer, regexp_extract_all(lower(a.text), '[\\pL\\pM\\pN_]{4,}') AS ws,
  a.conv_id % 2 = 0 AS must FROM conversations a JOIN conversations s ON s.conv_id = a.conv_id AND s.turn = a.turn + 1
  WHERE a.role = 'user' AND s.role = 'assistant')"""
q(
    "answer_exactness",
    lambda s, d: _answers(s, d).select(
        "conv_id", "turn", F.round(ev.exactness(F.col("answer"), F.col("expected"), F.col("forbidden")), 6).alias("exatidao"),
        F.round(ev.citation_accuracy(F.col("answer"), F.col("expected")), 6).alias("citacao"),
    ),
    _ANS,
    """, e AS (SELECT *, ws[1:3] AS ex, list_reverse(ws)[1:2] AS fb, lower(answer) AS t FROM an)
SELECT conv_id, turn, round((CASE WHEN len(ex) = 0 THEN 1 ELSE len(list_filter(ex, lambda w: contains(t, w))) / len(ex) END + 1 -
CASE WHEN len(fb) = 0 THEN 0 ELSE len(list_filter(fb, lambda w: contains(t, w))) / len(fb) END) / 2, 6) AS exatidao,
CASE WHEN len(ex) = 0 THEN 1.0 ELSE 0.0 END AS citacao FROM e""",
)
q(
    "refusal_summary", lambda s, d: ev.answer_summary(_answers(s, d)), _ANS,
    """, r AS (SELECT *, regexp_matches(lower(answer), 'apenas sobre as regionais|somente ce e sp|não encontrei essa informação|não há dados indexados') AS said FROM an)
SELECT count(*) AS casos, round(avg((said = must)::INT), 6) AS refusal_rate, round(avg((NOT said)::INT) FILTER (NOT must), 6)
AS fallback_guardrail_success FROM r""",
)


def _critiques(spark, sf):
    a = _answers(spark, sf).withColumn("sources", F.array(F.concat(F.lit("sp-"), (F.col("turn")).cast("string"))))
    return ev.critique(a)


q(
    "answer_critique",
    lambda s, d: _critiques(s, d).select("conv_id", "turn", "verdict", "factual_correctness", F.size("recommended_boosts").alias("reforcos")),
    _ANS,
    """, c AS (SELECT *, lower(question) AS q, lower(answer) AS a FROM an),
d AS (SELECT *, contains(q, 'telefone') OR contains(q, 'cpf') OR contains(q, 'endereço') AS pii, contains(a, 'sinto muito') OR contains(a, 'não posso')
  OR contains(a, 'anonimizados') AS ref, NOT contains(q, 'sp') AND contains(q, 'ce') AS par FROM c)
SELECT conv_id, turn, CASE WHEN par THEN 'parcial' WHEN pii AND ref THEN 'recusa_correta' WHEN pii THEN 'falha' ELSE 'ok' END AS verdict,
CASE WHEN par THEN 0.6 WHEN pii AND NOT ref THEN 0.0 ELSE 1.0 END::DOUBLE AS factual_correctness, CASE WHEN par THEN 2 ELSE 0 END AS reforcos FROM d""",
)
q(
    "boost_updates",
    lambda s, d: apply_boosts(
        _critiques(s, d), b.table(s, d, "region").select(
            F.when(F.col("r_regionkey") == 0, "ce-reclamacoes-totais-assuntos").otherwise(F.lower("r_name")).alias("target"), F.lit(0.8).alias("boost"))
    ),
    _ANS,
    """, n AS (SELECT count(*) AS k FROM an WHERE NOT contains(lower(question), 'sp') AND contains(lower(question), 'ce')),
r AS (SELECT CASE WHEN r_regionkey = 0 THEN 'ce-reclamacoes-totais-assuntos' ELSE lower(r_name) END AS target, 0.8 AS boost FROM region)
SELECT target, round(CASE WHEN target = 'ce-reclamacoes-totais-assuntos' AND k > 0 THEN least(2.0, 0.8 + 0.15 * k) ELSE boost END, 6)::DOUBLE AS boost FROM r, n
UNION ALL SELECT 'ce-reclamacoes-totais-causas', round(least(2.0, 1.0 + 0.1 * k), 6)::DOUBLE FROM n WHERE k > 0""",
)

# ---- telemetry ------------------------------------------------------------------------------------------------


def telemetry(spark, sf):
    e = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    subject = F.when(k < 40, " fatura").when(k < 70, " cadastro").otherwise(" medidor")
    return e.select(
        "ts", F.when(k >= 90, "stub").otherwise("local").alias("provider"), F.col("user_id").cast("string").alias("question_hash"),
        F.concat(F.lit("Quantas reclamacoes do cliente "), F.col("user_id").cast("string"), F.lit(" sobre"), subject).alias("question_preview"),
        F.col("event_type").alias("intent_class"), (k % 2 == 0).alias("cache_hit"), F.col("value").alias("latency_total_ms"),
        F.when(k < 30, "CE").when(k < 60, "SP").alias("region_detected"), k.alias("completion_tokens"),
    )


def feedback(spark, sf):
    e = b.table(spark, sf, "events").filter("event_type = 'signup'")
    return e.select(
        F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("question_hash"),
        F.when(F.col("value") < 5, " Down").when(F.col("value") < 60, "UP").otherwise("talvez").alias("rating"), F.lit("").alias("comment"),
    )


_TEL = """
tel AS MATERIALIZED (SELECT ts, CASE WHEN k >= 90 THEN 'stub' ELSE 'local' END AS provider, CAST(user_id AS VARCHAR) AS question_hash,
  'Quantas reclamacoes do cliente ' || user_id || ' sobre' || CASE WHEN k < 40 THEN ' fatura' WHEN k < 70 THEN ' cadastro' ELSE ' medidor' END AS question_preview,
  event_type AS intent_class, k % 2 = 0 AS cache_hit, value AS latency_total_ms, CASE WHEN k < 30 THEN 'CE' WHEN k < 60 THEN 'SP' END AS region_detected,
  k AS completion_tokens FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
fb AS MATERIALIZED (SELECT question_hash, rating FROM (SELECT CAST(user_id AS VARCHAR) AS question_hash, CASE WHEN value < 5 THEN 'down' WHEN value < 60 THEN 'up' END AS rating,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events WHERE event_type = 'signup' AND value < 60) WHERE rn = 1)"""
q(
    "telemetry_overview", lambda s, d: tm.overview(telemetry(s, d)), _TEL,
    """, m AS (SELECT *, NOT cache_hit AND provider <> 'stub' AS miss, NOT contains(question_preview, 'cadastro') AS inv FROM tel)
SELECT count(*) AS turns, count(DISTINCT question_hash) AS unique_hashes, count(*) FILTER (cache_hit) AS cache_hits,
round(count(*) FILTER (cache_hit) / count(*), 4) AS cache_hit_rate, count(*) FILTER (miss) AS miss_count, count(*) FILTER (inv) AS invoice_total,
count(*) FILTER (inv AND miss) AS invoice_misses, round(count(*) FILTER (inv AND miss) / count(*) FILTER (miss), 3) AS invoice_share_of_misses FROM m""",
)
q(
    "telemetry_latency", lambda s, d: tm.latency(telemetry(s, d), "intent_class"), _TEL,
    """, v AS (SELECT intent_class, list_sort(list(latency_total_ms)) AS a, count(*) AS n FROM tel WHERE NOT cache_hit AND provider <> 'stub' GROUP BY 1)
SELECT intent_class, n, round(a[-1], 2) AS max, round((a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2, 2) AS p50,
round(a[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1], 2) AS p95, round(a[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1], 2) AS p99 FROM v""",
)
q(
    "latency_by_backend", lambda s, d: ev.latency_summary(telemetry(s, d), "provider", "latency_total_ms"), _TEL,
    "SELECT provider, count(*) AS n, round(avg(latency_total_ms), 3) AS media, round(quantile_cont(latency_total_ms, 0.5), 3) AS p50, "
    "round(quantile_cont(latency_total_ms, 0.95), 3) AS p95 FROM tel GROUP BY 1",
)
q(
    "telemetry_slowest", lambda s, d: tm.slowest(telemetry(s, d)), _TEL,
    "SELECT substr(question_preview, 1, 80) AS preview, round(latency_total_ms, 0) AS latency_ms, intent_class AS intent, region_detected AS region FROM tel "
    "ORDER BY latency_total_ms DESC, question_hash, ts LIMIT 10",
)
q(
    "promotion_candidates", lambda s, d: tm.candidates(telemetry(s, d), feedback(s, d)), _TEL,
    """SELECT preview, repeticoes, intent_class, region_detected FROM (SELECT question_preview AS preview, count(*) AS repeticoes,
arg_max(intent_class, ts) AS intent_class, arg_max(coalesce(region_detected, '#'), ts) AS rd, nullif(arg_max(coalesce(region_detected, '#'), ts), '#')
AS region_detected, coalesce(bool_or(rating = 'down'), false) AS dn FROM tel LEFT JOIN fb USING (question_hash) WHERE provider <> 'stub' GROUP BY 1)
WHERE NOT dn AND repeticoes >= 3""",
)
q("telemetry_bottlenecks", lambda s, d: tm.bottlenecks(telemetry(s, d)), _TEL,
  "SELECT 'invoice_questions_dominate' AS recomendacao, count(*) AS turns FROM tel")
_LAST = ", la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_hash ORDER BY ts DESC) AS rn FROM tel) WHERE rn = 1)"
q(
    "uncached_gaps", lambda s, d: tm.gaps(telemetry(s, d), feedback(s, d)), _TEL,
    _LAST + """ SELECT question_preview, count(*) AS n FROM la WHERE NOT cache_hit AND question_hash NOT IN (SELECT question_hash FROM fb WHERE rating = 'down')
GROUP BY 1 ORDER BY n DESC, question_preview LIMIT 10""",
)
q(
    "new_cache_entries",
    lambda s, d: tm.new_cache_entries(telemetry(s, d), telemetry(s, d).filter("region_detected = 'CE'").select("question_preview")), _TEL,
    _LAST + """ SELECT question_preview, intent_class, region_detected FROM la WHERE NOT cache_hit AND completion_tokens > 20 AND question_preview NOT IN
(SELECT question_preview FROM tel WHERE region_detected = 'CE')""",
)
q(
    "feedback_last_rating", lambda s, d: tm.valid_feedback(feedback(s, d)), _TEL, "SELECT question_hash, rating FROM fb",
)


def _triplets(spark, sf):
    t = telemetry(spark, sf).withColumn("anchor", F.col("intent_class"))
    names = b.table(spark, sf, "events").select(F.col("event_type").alias("anchor")).distinct()
    numbered = names.withColumn("texto", F.concat(F.lit("cartao "), "anchor")).withColumn(
        "numero", F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("anchor")) - 1
    )
    return tm.triplets(t, feedback(spark, sf), numbered)


q(
    "training_triplets", lambda s, d: _triplets(s, d).groupBy("weight", "query").agg(F.count(F.lit(1)).alias("n")), _TEL,
    _LAST + """ SELECT CASE WHEN rating IS NOT NULL OR cache_hit THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, question_preview AS query, count(*) AS n
FROM la LEFT JOIN fb USING (question_hash) GROUP BY 1, 2""",
)
q(
    "positive_cache",
    lambda s, d: tm.positive_cache(
        _critiques(s, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("turn") % 3).alias("round"), "verdict"),
        _answers(s, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "question", F.col("answer").alias("gold_answer")),
    ).select("hash", "rounds"),
    _ANS,
    """SELECT sha256(trim(regexp_replace(lower(question), '\\s+', ' ', 'g'))) AS hash, count(DISTINCT turn % 3) AS rounds FROM an
WHERE (contains(lower(question), 'sp') OR NOT contains(lower(question), 'ce')) AND NOT (contains(lower(question), 'telefone')
OR contains(lower(question), 'cpf') OR contains(lower(question), 'endereço')) GROUP BY 1""",
)
q(
    "positive_cache_lookup",
    lambda s, d: tm.cache_lookup(
        _questions(s, d),
        _questions(s, d).filter("question_id LIKE '%-0'").select(
            F.col("question_id").alias("entry_id"), F.sha2(qs.token_set(F.col("question")), 256).alias("token_hash"),
            F.sha2(qs.canonical_question(F.col("question")), 256).alias("hash")),
        "question_id", "question",
    ).groupBy("tentativa").agg(F.count(F.lit(1)).alias("n")),
    _QU,
    f""", c AS (SELECT question_id, {_CANON} AS c FROM qu), k AS (SELECT DISTINCT c FROM c WHERE question_id LIKE '%-0')
SELECT 0 AS tentativa, count(*) AS n FROM c WHERE c IN (SELECT c FROM k)""",
)
