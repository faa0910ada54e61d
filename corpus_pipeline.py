"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrigenda.llm.common import KEY, cut, keyed, scratch, without_keys
from corrigenda.llm.lines import dedup_lines
from corrigenda.llm.packing import pack, token_pieces
from corrigenda.llm.quality import judge_quality
from corrigenda.llm.similar import keep_one_similar
from corrigenda.llm.spans import dedup_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept by the base rules and the forest.

    Null texts have no words and go. Rows that share an id, or have none, are judged one by one. An
    empty table stays empty; further columns are left out.
    """
    rows = keyed(docs.select(*COLUMNS), "doc_id")
    judged = judge_quality(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), also=(KEY,))
    return without_keys(rows, judged.where("not kept").select(KEY)).select(*COLUMNS)


def _without_emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents that still hold a word; the length column follows the text."""
    return after.where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document made of nothing else, or without a text, goes with them.

    Of rows with one id the first read keeps a line, rows without an id come last.
    """
    return _without_emptied(docs, dedup_lines(docs.select(*COLUMNS)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (five-word shingles, similarity 0.8 or more) stays.

    Of rows with one id, or none, that are near copies, the first read stays; those without come last.
    """
    return keep_one_similar(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences go, but for their first occurrence; emptied documents go with them.

    Of rows with one id the first read keeps a passage, rows without an id come last.
    """
    return _without_emptied(docs, dedup_spans(docs.select(*COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, with sequence and place; a null text is an empty one."""
    return pack(token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The forest's verdicts cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; stages meet in tables of the shared folder.

    What a stage has written besides its result is deleted behind it, and its input with it.
    """
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as written:
            docs = cut(stage(spark, docs, sf_dir), name)
            results.append(written.pop())
            written += results[:-1]
            results = results[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
