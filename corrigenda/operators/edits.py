"""Edit rows: offsets, application to the source, validity, filters and set operations on targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrigenda.model import KEYS, TARGET


def with_target_offsets(edits: DataFrame) -> DataFrame:
    """Adds ``tgt_start, tgt_end``: the source place plus what earlier edits of the target have shifted."""
    w = Window.partitionBy(*TARGET).orderBy("src_start", "src_end", "edit_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.size("tgt_tokens") - (F.col("src_end") - F.col("src_start"))).over(w), F.lit(0))
    return edits.withColumn("tgt_start", (F.col("src_start") + shift).cast("int")).withColumn(
        "tgt_end", (F.col("tgt_start") + F.size("tgt_tokens")).cast("int")
    )


def splice(src: Column, edits: Column, start: Column, end: Column) -> Column:
    """Tokens of ``src[start:end)`` after ordered ``edits`` (structs with src_start, src_end, tgt_tokens)."""
    folded = F.aggregate(
        edits,
        F.struct(start.cast("int").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, e: F.struct(
            e["src_end"].cast("int").alias("at"),
            F.concat(acc["out"], F.slice(src, acc["at"] + 1, F.greatest(e["src_start"] - acc["at"], F.lit(0))), e["tgt_tokens"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.slice(src, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0)))),
    )
    return folded


def collected(edits: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with its edits in source order."""
    e = F.struct("src_start", "src_end", "edit_no", "tgt_tokens", "types")
    return edits.groupBy(*by).agg(F.sort_array(F.collect_list(e)).alias("edits"))


def apply_edits(samples: DataFrame, targets: DataFrame, edits: DataFrame) -> DataFrame:
    """``targets`` keys with ``tgt_tokens`` made from the source and the edits; no edits: the source."""
    done = targets.select(*TARGET).join(collected(edits, TARGET), TARGET, "left").join(samples.select(*KEYS, "src_tokens"), KEYS)
    none = F.array().cast(edits_type(edits))
    tokens = splice(F.col("src_tokens"), F.coalesce(F.col("edits"), none), F.lit(0), F.size("src_tokens"))
    return done.select(*TARGET, tokens.alias("tgt_tokens"))


def applied(rows: DataFrame) -> DataFrame:
    """``apply_edits`` where each target stands beside its source and its edits in order: TARGET, ``src_tokens, edits``."""
    return rows.select(*TARGET, splice(F.col("src_tokens"), F.col("edits"), F.lit(0), F.size("src_tokens")).alias("tgt_tokens"))


def edits_type(edits: DataFrame) -> str:
    return "array<struct<src_start:int,src_end:int,edit_no:int,tgt_tokens:array<string>,types:array<string>>>"


def invalid_edits(samples: DataFrame, targets: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose source or target slice is not what they say, or that overlap the edit before."""
    w = Window.partitionBy(*TARGET).orderBy("src_start", "src_end", "edit_no")
    e = edits.withColumn("_before", F.lag("src_end").over(w))
    e = e.join(samples.select(*KEYS, F.col("src_tokens").alias("_src")), KEYS).join(targets.select(*TARGET, F.col("tgt_tokens").alias("_tgt")), TARGET)
    src_ok = F.slice("_src", F.col("src_start") + 1, F.col("src_end") - F.col("src_start")) == F.col("src_tokens")
    tgt_ok = F.slice("_tgt", F.col("tgt_start") + 1, F.size("tgt_tokens")) == F.col("tgt_tokens")
    return e.where(~(src_ok & tgt_ok) | (F.coalesce("_before", F.lit(0)) > F.col("src_start"))).select(*edits.columns)


def violations(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Samples that cannot be scored: no source, not exactly one hypothesis, or no reference."""
    n = targets.groupBy(*KEYS).agg(F.count_if(F.col("side") == "hyp").alias("hyps"), F.count_if(F.col("side") == "ref").alias("refs"))
    both = samples.select(*KEYS, F.size("src_tokens").alias("n")).join(n, KEYS, "full")
    return both.where("n is null or n <= 0 or coalesce(hyps, 0) <> 1 or coalesce(refs, 0) < 1")


def _drop_refs(targets: DataFrame, good: Column) -> DataFrame:
    """Drops references that are not ``good``, but keeps the first where none would stay."""
    w = Window.partitionBy(*KEYS, "side")
    t = targets.withColumn("_good", good).withColumn("_any", F.max("_good").over(w)).withColumn("_first", F.min("target_id").over(w))
    keep = (F.col("side") != "ref") | F.col("_good") | (~F.col("_any") & (F.col("target_id") == F.col("_first")))
    return t.where(keep).drop("_good", "_any", "_first")


def drop_empty_refs(targets: DataFrame) -> DataFrame:
    """References without a token go (chunk metrics); if all are empty the first stays."""
    return _drop_refs(targets, F.size("tgt_tokens") > 0)


def drop_unchanged_refs(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """References equal to the source go; if all are, the first stays."""
    t = targets.join(samples.select(*KEYS, F.col("src_tokens").alias("_src")), KEYS)
    return _drop_refs(t, F.col("tgt_tokens") != F.col("_src")).drop("_src")


def keep_edits_of(edits: DataFrame, targets: DataFrame) -> DataFrame:
    """Edits whose target is still there."""
    return edits.join(targets.select(*TARGET), TARGET, "left_semi")


def merge_targets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Annotations of the same samples from two datasets; the second's target ids follow the first's."""
    base = a.groupBy(*KEYS, "side").agg((F.max("target_id") + 1).alias("_base"))
    moved = b.join(base, [*KEYS, "side"], "left").withColumn("target_id", (F.col("target_id") + F.coalesce("_base", F.lit(0))).cast("int"))
    return a.unionByName(moved.select(*a.columns))


def source_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of samples that only one of two tables of samples has, or whose sources differ."""
    both = a.select(*KEYS, F.col("src_tokens").alias("_a")).join(b.select(*KEYS, F.col("src_tokens").alias("_b")), KEYS, "full")
    return both.where("_a is null or _b is null or _a <> _b").select(*KEYS)


def merge_annotations(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two annotations of the same sources as one dataset: the targets of ``b``, and their edits, follow those of ``a``. Raises where sources differ."""
    odd = source_conflicts(a["samples"], b["samples"]).take(5)
    if odd:
        raise ValueError(f"samples that do not have one source in both: {[tuple(r) for r in odd]}")
    base = a["targets"].groupBy(*KEYS, "side").agg((F.max("target_id") + 1).alias("_base"))
    out = {"samples": a["samples"]}
    for name in ("targets", "edits"):
        moved = b[name].join(base, [*KEYS, "side"], "left").withColumn("target_id", (F.col("target_id") + F.coalesce("_base", F.lit(0))).cast("int"))
        out[name] = a[name].unionByName(moved.select(*a[name].columns))
    return out


def append_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two datasets; sample ids of the second follow those of the first, per system."""
    base = a.groupBy("system_id").agg((F.max("sample_id") + 1).alias("_base"))
    moved = b.join(base, "system_id", "left").withColumn("sample_id", F.col("sample_id") + F.coalesce("_base", F.lit(0)))
    return a.unionByName(moved.select(*a.columns))


def flatten_pairs(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (source, target) pair."""
    return targets.join(samples, KEYS).select(*TARGET, F.array_join("src_tokens", " ").alias("source"), F.array_join("tgt_tokens", " ").alias("target"))


def sample_flags(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """``has_empty, has_repeated, has_unchanged`` per sample."""
    t = targets.groupBy(*KEYS).agg(F.collect_list("tgt_tokens").alias("t"))
    j = samples.join(t, KEYS)
    return j.select(
        *KEYS, F.exists("t", lambda x: F.size(x) == 0).alias("has_empty"), (F.size(F.array_distinct("t")) < F.size("t")).alias("has_repeated"),
        F.exists("t", lambda x: x == F.col("src_tokens")).alias("has_unchanged"),
    )
