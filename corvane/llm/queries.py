"""The operators' registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import impact_bits, licences, main_text, maxscore, mixing, neardup, packing, pii, quality, repeats, token_store, toxicity, vector_codes
from .common import table


def op1_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(spark, table(spark, sf_dir, "documents"))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.replicate(spark, docs).select("doc_id", "source", "text", "copies", "copy", "shuffle_key")


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spark, table(spark, sf_dir, "documents")).drop("lang", "source")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(spark, table(spark, sf_dir, "embeddings"))


def op12_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op13_impact_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_bits.ranked(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_run_index_dedup,
        op2_token_orc,
        op3_poisson_mixing,
        op4_licence_sentences,
        op5_toxicity,
        op6_quality_outliers,
        op7_minhash_near_dedup,
        op8_maxscore_search,
        op9_best_fit_packing,
        op10_pii_spans,
        op11_vector_codes,
        op12_line_blocks,
        op13_impact_bits,
    )
}
#: The same rows in SQL, where it can say them.
ORACLES = {
    "op3_poisson_mixing": mixing.oracle(),
    "op4_licence_sentences": licences.oracle(),
    "op8_maxscore_search": maxscore.oracle(),
    "op11_vector_codes": vector_codes.oracle(),
    "op13_impact_bits": impact_bits.oracle(),
}
