"""Chunk sequences: spans with boundaries shared by the source, the hypothesis and all references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrigenda.model import KEYS, TARGET
from corrigenda.operators.edits import collected, edits_type, splice


def with_islands(edits: DataFrame, merge_distance: int = 0) -> DataFrame:
    """Adds ``island_id``: edits of all targets of a sample that touch, or lie within the distance."""
    w = Window.partitionBy(*KEYS).orderBy("src_start", "src_end")
    before = F.max("src_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("src_start") > before + merge_distance), 1).otherwise(0)
    e = edits.withColumn("_opens", opens)
    return e.withColumn("island_id", (F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_opens")


def islands(edits: DataFrame, merge_distance: int = 0) -> DataFrame:
    return with_islands(edits, merge_distance).groupBy(*KEYS, "island_id").agg(F.min("src_start").alias("start"), F.max("src_end").alias("end"))


def chunk_bounds(samples: DataFrame, isl: DataFrame) -> DataFrame:
    """Islands and the gaps around them, numbered from the left; a sample without edits is one chunk.

    Islands of a sample are collected into one row (they are few), so gaps come without a window.
    """
    row = isl.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("start", "end", "island_id"))).alias("i"))
    j = samples.select(*KEYS, F.size("src_tokens").alias("n")).join(row, KEYS, "left")
    none = "array<struct<start:int,end:int,island_id:int>>"
    i = F.coalesce(F.col("i"), F.array().cast(none))
    ends = F.concat(F.array(F.lit(0)), i["end"])
    starts = F.concat(i["start"], F.array(F.col("n")))
    gaps = F.filter(F.arrays_zip(ends.alias("start"), starts.alias("end")), lambda g: g["end"] > g["start"])
    gaps = F.when(F.size(i) + F.col("n") == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("int").alias("island_id")))).otherwise(
        F.transform(gaps, lambda g: F.struct(g["start"].cast("int").alias("start"), g["end"].cast("int").alias("end"), F.lit(None).cast("int").alias("island_id")))
    )
    # by start and end; an island of length zero stands before the gap that begins where it does
    both = F.sort_array(F.concat(i, gaps))
    out = j.select(*KEYS, F.posexplode(both).alias("chunk_idx", "c"))
    return out.select(*KEYS, "chunk_idx", F.col("c.start").alias("src_start"), F.col("c.end").alias("src_end"), F.col("c.island_id").alias("island_id"))


def chunks(samples: DataFrame, targets: DataFrame, edits: DataFrame, merge_distance: int = 0) -> DataFrame:
    """Chunk rows of every target; the sequences of a sample all have the same chunk numbers.

    A chunk's text is its source slice with the target's own edits inside the island applied; it is
    marked if the target has an edit there, whether or not the text changes.
    """
    e = with_islands(edits, merge_distance)
    isl = e.groupBy(*KEYS, "island_id").agg(F.min("src_start").alias("start"), F.max("src_end").alias("end"))
    bounds = chunk_bounds(samples, isl)
    grid = bounds.join(targets.select(*TARGET), KEYS).join(samples.select(*KEYS, F.col("src_tokens").alias("_src")), KEYS)
    own = collected(e, [*TARGET, "island_id"])
    none = F.array().cast(edits_type(edits))
    ed = F.coalesce(F.col("edits"), none)
    return grid.join(own, [*TARGET, "island_id"], "left").select(
        *KEYS, "chunk_idx", "src_start", "src_end", "side", "target_id",
        F.slice("_src", F.col("src_start") + 1, F.col("src_end") - F.col("src_start")).alias("src_tokens"),
        splice(F.col("_src"), ed, F.col("src_start"), F.col("src_end")).alias("tgt_tokens"),
        F.flatten(F.transform(ed, lambda x: x["types"])).alias("types"),
        (F.size(F.flatten(F.transform(ed, lambda x: x["types"]))) > 0).alias("is_marked"),
    )


def chunk_table(ch: DataFrame) -> DataFrame:
    """Long view of the chunk table: text per target, and whether any text of the column differs from another."""
    w = Window.partitionBy(*KEYS, "chunk_idx")
    text, src = F.array_join("tgt_tokens", " "), F.array_join("src_tokens", " ")
    t = ch.withColumn("text", text)
    changed = (F.min("text").over(w) != F.max("text").over(w)) | F.max((F.col("text") != src).cast("int")).over(w).cast("boolean")
    return t.withColumn("changed", changed).select(*KEYS, "chunk_idx", "side", "target_id", "text", "changed")


def chunk_pivot(table: DataFrame) -> DataFrame:
    """Wide view for small inputs: a column per chunk, ``*`` on changed ones."""
    name = F.concat(F.lpad(F.col("chunk_idx").cast("string"), 3, "0"), F.when(F.col("changed"), "*").otherwise(""))
    return table.withColumn("_c", name).groupBy(*TARGET).pivot("_c").agg(F.first("text"))
