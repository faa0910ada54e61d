"""Outcomes of edits and chunks against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrigenda.model import KEYS


def edit_outcomes(targets: DataFrame, edits: DataFrame, detection: bool = False) -> DataFrame:
    """tp / fp / fn of every edit against each reference, by equal interval and text (detection: interval).

    Equal rows count each, as in lists: what is shared is decided by existence, not by pairing.
    """
    at = ["src_start", "src_end"] + ([] if detection else ["tgt_tokens"])
    refs = targets.where("side = 'ref'").select(*KEYS, F.col("target_id").alias("ref_id"))
    hyp = edits.where("side = 'hyp'").select(*KEYS, *at).join(refs, KEYS)
    ref = edits.where("side = 'ref'").select(*KEYS, *at, F.col("target_id").alias("ref_id"))
    on = [*KEYS, "ref_id", *at]
    tp = hyp.join(ref, on, "left_semi").withColumn("outcome", F.lit("tp"))
    fp = hyp.join(ref, on, "left_anti").withColumn("outcome", F.lit("fp"))
    fn = ref.join(hyp, on, "left_anti").withColumn("outcome", F.lit("fn"))
    return tp.unionByName(fp).unionByName(fn)


def _sides(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    hyp = chunks.where("side = 'hyp'").select(*KEYS, "chunk_idx", F.size("src_tokens").alias("src_len"), F.col("tgt_tokens").alias("h"), F.col("is_marked").alias("hm"))
    ref = chunks.where("side = 'ref'").select(*KEYS, "chunk_idx", F.col("target_id").alias("ref_id"), F.col("tgt_tokens").alias("r"), F.col("is_marked").alias("rm"))
    return hyp, ref


def dependent_outcomes(chunks: DataFrame, detection: bool = False) -> DataFrame:
    """Hypothesis chunk against the chunk of each reference at the same place.

    ``length`` is that of the hypothesis' own chunk, also where it misses a correction.
    """
    hyp, ref = _sides(chunks)
    j = hyp.join(ref, [*KEYS, "chunk_idx"])
    if detection:
        outcome = F.when(F.col("hm"), F.when(F.col("rm"), "tp").otherwise("fp")).otherwise(F.when(F.col("rm"), "fn").otherwise("tn"))
        kind = F.lit(None).cast("string")
    else:
        same = F.col("h") == F.col("r")
        outcome = F.when(F.col("hm"), F.when(same, "tp").otherwise("fp")).otherwise(F.when(same, "tn").otherwise("fn"))
        kind = F.when(F.col("hm") & ~same, F.when(F.col("rm"), "ne").otherwise("un"))
    return j.select(*KEYS, "ref_id", "chunk_idx", outcome.alias("outcome"), kind.alias("fp_kind"), F.greatest("src_len", F.size("h")).alias("length"))


def independent_outcomes(chunks: DataFrame, detection: bool = False) -> DataFrame:
    """Hypothesis chunk against the chunks of all references at its place; the same for every reference.

    Unmarked chunks are missed only where every reference is marked.
    """
    hyp, ref = _sides(chunks)
    by = ref.groupBy(*KEYS, "chunk_idx").agg(F.collect_set("r").alias("rs"), F.bool_or("rm").alias("any"), F.bool_and("rm").alias("all"))
    ids = ref.select(*KEYS, "ref_id").distinct()
    j = hyp.join(by, [*KEYS, "chunk_idx"])
    hit = F.col("any") if detection else F.array_contains("rs", F.col("h"))
    outcome = F.when(F.col("hm"), F.when(hit, "tp").otherwise("fp")).otherwise(F.when(F.col("all"), "fn").otherwise("tn"))
    kind = F.lit(None).cast("string") if detection else F.when(F.col("hm") & ~hit, F.when(F.col("any"), "ne").otherwise("un"))
    length = F.greatest("src_len", F.size("h"))
    return j.join(ids, KEYS).select(*KEYS, "ref_id", "chunk_idx", outcome.alias("outcome"), kind.alias("fp_kind"), length.alias("length"))
