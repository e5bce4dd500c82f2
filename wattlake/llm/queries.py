"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattlake.llm import alignment, embeddings, exact, langid, lexical, licences, lines, minhash, mixing, neighbours, packing, quality, suffix
from wattlake.llm.common import documents, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(documents(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=2)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op11_ranked_search": op11_ranked_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_nearest_neighbours": op13_nearest_neighbours,
    "op7_quality_classifier": op7_quality_classifier,
    "op10_license_scan": op10_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op8_exact_dedup": op8_exact_dedup,
}
ORACLES = {
    "op11_ranked_search": lexical.SQL,
    "op10_license_scan": licences.SQL,
    "op5_embedding_dedup": embeddings.SQL,
    "op9_minhash_dedup": minhash.SQL,
    "op8_exact_dedup": exact.SQL,
}
