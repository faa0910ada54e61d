"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrigenda.llm import html_text, lines, lz, neighbours, packing, pieces, prefixes, quality, simhash, spans, tokens, urls, variants
from corrigenda.tables import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one in fewer splits than there are cores is dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return spans.dedup_spans(docs.select("doc_id", "text")).select("doc_id", F.length("text").cast("long").alias("n_chars_kept"), "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edited_likeness(_read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"), urls.RULES)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_read(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    got = lines.dedup_lines(docs.select("doc_id", "text"))
    return got.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines_kept"), F.length("text").cast("long").alias("n_chars_kept"), "text")


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(_read(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_simhash_near_dedup, op3_substring_dedup, op4_quality_rules, op5_html_extraction,
        op6_document_fingerprints, op7_url_filters, op8_sentencepiece, op9_best_fit_packing, op10_line_dedup,
        op11_nn_descent, op12_prefix_trie, op13_spelling_variants,
    )
}

ORACLES: dict[str, str] = {}
