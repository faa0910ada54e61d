"""JSON datasets, parallel text, and persisted results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrigenda.functions.text import tokenize
from corrigenda.model import KEYS, TARGET
from corrigenda.sources.blocks import with_position
from corrigenda.sources.options import for_writing, with_options

_EDIT = "struct<edit_no:int,src_start:int,src_end:int,tgt_start:int,tgt_end:int,src_tokens:array<string>,tgt_tokens:array<string>,types:array<string>>"
NESTED = f"system_id string, sample_id bigint, source string, targets array<struct<side:string,target_id:int,target:string,edits:array<{_EDIT}>>>"


def to_nested(samples: DataFrame, targets: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per sample with its targets and their edits inside."""
    e = edits.groupBy(*TARGET).agg(F.sort_array(F.collect_list(F.struct("edit_no", "src_start", "src_end", "tgt_start", "tgt_end", "src_tokens", "tgt_tokens", "types"))).alias("edits"))
    t = targets.join(e, TARGET, "left").groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("side", "target_id", F.array_join("tgt_tokens", " ").alias("target"), F.coalesce("edits", F.array().cast(f"array<{_EDIT}>")).alias("edits")))).alias("targets")
    )
    return samples.join(t, KEYS, "left").select(*KEYS, F.array_join("src_tokens", " ").alias("source"), "targets")


def grouped_to_nested(g: DataFrame) -> DataFrame:
    """``to_nested`` of a grouped dataset (see ``grouped``), row by row."""
    edits = lambda t: F.sort_array(t["edits"])
    targets = F.sort_array(F.transform("t", lambda t: F.struct(t["side"].alias("side"), t["target_id"].alias("target_id"), F.array_join(t["tgt_tokens"], " ").alias("target"), edits(t).alias("edits"))))
    return g.select(*KEYS, F.array_join("src_tokens", " ").alias("source"), F.when(F.size("t") > 0, targets).alias("targets"))


def from_nested(nested: DataFrame) -> dict[str, DataFrame]:
    t = nested.select(*KEYS, F.explode("targets").alias("t"))
    e = t.select(*KEYS, "t.side", "t.target_id", F.explode("t.edits").alias("e"))
    return {
        "samples": nested.select(*KEYS, tokenize(F.col("source")).alias("src_tokens")),
        "targets": t.select(*KEYS, "t.side", "t.target_id", tokenize(F.col("t.target")).alias("tgt_tokens")),
        "edits": e.select(*TARGET, "e.*"),
    }


def read_json(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """A nested dataset as tables; ``options`` are those of ``with_options``."""
    return with_options(from_nested(spark.read.schema(NESTED).json(path)), **options)


def write_json(samples: DataFrame, targets: DataFrame, edits: DataFrame, path: str, flatten: bool = False, max_sample: int = -1, grouped: DataFrame | None = None, compression: str = "none") -> None:
    """A row for each sample with its targets and edits inside; see ``for_writing``.

    Where the same dataset is at hand ``grouped``, a row for each sample, whole and unflattened it is written row by row, without joins.
    """
    if grouped is not None and not flatten and max_sample < 0:
        nested = grouped_to_nested(grouped)
    else:
        d = for_writing({"samples": samples, "targets": targets, "edits": edits}, flatten, max_sample)
        nested = to_nested(d["samples"], d["targets"], d["edits"])
    nested.write.json(path, compression=compression)


def read_parallel(spark: SparkSession, source: str, target: str, system_id: str, side: str = "hyp", **options) -> dict[str, DataFrame]:
    """A source file and a target file by line number; several targets of a line are parted by tabs. ``options``: see ``with_options``."""
    s, t = (with_position(spark.read.text(p)).withColumn("system_id", F.lit(system_id)) for p in (source, target))
    each = t.select(*KEYS, F.posexplode(F.split("value", "\t")).alias("target_id", "text"))
    d = {"samples": s.select(*KEYS, tokenize(F.col("value")).alias("src_tokens")), "targets": each.select(*KEYS, F.lit(side).alias("side"), "target_id", tokenize(F.col("text")).alias("tgt_tokens"))}
    return with_options(d, **options)


def persist(scores: DataFrame, matches: DataFrame, path: str) -> None:
    """Score rows and every match, in full."""
    scores.write.json(f"{path}/scores")
    matches.write.parquet(f"{path}/matches")
