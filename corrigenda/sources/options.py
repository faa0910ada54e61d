"""What readers and writers may do to a dataset (``samples, targets, edits``) behind or before the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrigenda.functions.text import remove_space
from corrigenda.model import KEYS, TARGET
from corrigenda.sources.files import first_samples, places

Dataset = dict[str, DataFrame]


def _following(data: Dataset, samples: DataFrame) -> Dataset:
    """``data`` with these samples, and the targets and edits of them."""
    kept = samples.select(*KEYS)
    return {"samples": samples, **{t: data[t].join(kept, KEYS, "left_semi") for t in ("targets", "edits") if t in data}}


def _without(data: Dataset, unwanted) -> Dataset:
    """``data`` without the targets that are ``unwanted`` (a condition over ``_src`` and ``tgt_tokens``); those that stay are numbered anew."""
    t = data["targets"].join(data["samples"].select(*KEYS, F.col("src_tokens").alias("_src")), KEYS).where(~unwanted).drop("_src")
    new = (F.row_number().over(Window.partitionBy(*KEYS, "side").orderBy("target_id")) - 1).cast("int")
    t = t.withColumn("_new", new)
    out = {**data, "targets": t.withColumn("target_id", F.col("_new")).drop("_new").select(*data["targets"].columns)}
    if "edits" in data:
        out["edits"] = data["edits"].join(t.select(*TARGET, "_new"), TARGET).withColumn("target_id", F.col("_new")).select(*data["edits"].columns)
    return out


def flattened(data: Dataset) -> Dataset:
    """One sample for each pair of a source and a target, numbered in order of samples, sides and targets within each system."""
    at = places(data["targets"].select(*TARGET), ["system_id", "sample_id", "side", "target_id"], "_at")
    low = at.groupBy("system_id").agg(F.min("_at").alias("_low"))
    at = at.join(low, "system_id").select(*TARGET, (F.col("_at") - F.col("_low")).alias("_new"))
    samples = data["samples"].join(at, KEYS).withColumn("sample_id", F.col("_new")).select(*data["samples"].columns)
    out = {"samples": samples}
    for name in ("targets", "edits"):
        if name in data:
            moved = data[name].join(at, TARGET).withColumns({"sample_id": F.col("_new"), "target_id": F.lit(0)})
            out[name] = moved.select(*data[name].columns)
    return out


def with_options(data: Dataset, flatten: bool = False, remove_empty: bool = False, remove_unchanged: bool = False, remove_whitespace: bool = False, max_sample: int = -1) -> Dataset:
    """``data`` as a reader gives it with these options; edits stay with the targets that stay.

    The first ``max_sample`` samples (all where negative) are taken before anything else. Without white space
    a text is one token, and has no edits. With any other option a sample without a source is an error.
    """
    if max_sample >= 0:
        data = _following(data, first_samples(data["samples"], max_sample))
    if not (flatten or remove_empty or remove_unchanged or remove_whitespace):
        return data
    checked = F.when(F.size("src_tokens") > 0, F.col("src_tokens")).otherwise(F.raise_error(F.lit("a sample has no source")).cast("array<string>"))
    data = {**data, "samples": data["samples"].withColumn("src_tokens", checked)}
    if remove_empty:
        data = _without(data, F.size("tgt_tokens") == 0)
    if remove_unchanged:
        data = _without(data, F.col("tgt_tokens") == F.col("_src"))
    if remove_whitespace:
        whole = lambda c: F.filter(F.array(remove_space(F.array_join(c, " "))), lambda x: x != "")
        data = {"samples": data["samples"].withColumn("src_tokens", whole("src_tokens")), "targets": data["targets"].withColumn("tgt_tokens", whole("tgt_tokens"))}
    return flattened(data) if flatten else data


def for_writing(data: Dataset, flatten: bool = False, max_sample: int = -1) -> Dataset:
    """``data`` as a writer takes it: one target a sample, if asked for, and then the first samples (all where ``max_sample`` is negative)."""
    data = flattened(data) if flatten else data
    return data if max_sample < 0 else _following(data, first_samples(data["samples"], max_sample))
