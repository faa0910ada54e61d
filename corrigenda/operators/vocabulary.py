"""Small tables of names: types of edits by number, categories by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrigenda.operators.english import TAGS

# Types of edits in the order of their numbers.
EDIT_TYPES = {
    "eng": (
        "M:ADJ", "M:ADV", "M:CONJ", "M:CONTR", "M:DET", "M:NOUN", "M:NOUN:POSS", "M:OTHER", "M:PART", "M:PREP", "M:PRON", "M:PUNCT", "M:VERB", "M:VERB:FORM", "M:VERB:TENSE",
        "R:ADJ", "R:ADJ:FORM", "R:ADV", "R:CONJ", "R:CONTR", "R:DET", "R:MORPH", "R:NOUN", "R:NOUN:INFL", "R:NOUN:NUM", "R:NOUN:POSS", "R:ORTH", "R:OTHER", "R:PART", "R:PREP",
        "R:PRON", "R:PUNCT", "R:SPELL", "R:VERB", "R:VERB:FORM", "R:VERB:INFL", "R:VERB:SVA", "R:VERB:TENSE", "R:WO",
        "U:ADJ", "U:ADV", "U:CONJ", "U:CONTR", "U:DET", "U:NOUN", "U:NOUN:POSS", "U:OTHER", "U:PART", "U:PREP", "U:PRON", "U:PUNCT", "U:VERB", "U:VERB:FORM", "U:VERB:TENSE",
        "UNK",
    ),
    "zho": ("M", "S", "R", "W"),
}
#: Rows of a table that may be broadcast.
SMALL = 100_000


def edit_type_table(spark: SparkSession, lang: str = "eng") -> DataFrame:
    """``type, type_no``."""
    return spark.createDataFrame(list(zip(EDIT_TYPES[lang], range(len(EDIT_TYPES[lang])))), "type string, type_no int")


def tag_table(spark: SparkSession) -> DataFrame:
    """``tag, category``: Penn tags and the categories they are reported as."""
    return spark.createDataFrame([(t, c) for c, tags in TAGS.items() for t in tags], "tag string, category string")


def looked_up(rows: DataFrame, column: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` from ``table`` where ``column`` is ``key``; null where the table does not know it.

    The table is broadcast up to SMALL rows, else joined. A key that stands in it more than once, or is null, is an error.
    """
    t = table.select(F.col(key).alias("_key"), F.col(value).alias(value))
    odd = t.groupBy("_key").count().where("count > 1 or _key is null").take(3)
    if odd:
        raise ValueError(f"keys that do not name one row: {[r[0] for r in odd]}")
    few = t.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(t) if few else t, F.col(column) == F.col("_key"), "left").drop("_key")


def numbered_types(edits: DataFrame, table: DataFrame) -> DataFrame:
    """``edits`` with ``type_no`` of their first type; null for a type that the table does not have, or none."""
    return looked_up(edits.withColumn("_type", F.get("types", F.lit(0))), "_type", table, "type", "type_no").drop("_type")


def unknown_types(edits: DataFrame, table: DataFrame) -> DataFrame:
    """``type, n``: types of edits that the table does not have, with the numbers of their edits."""
    used = edits.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return used.join(table.select("type"), "type", "left_anti")
