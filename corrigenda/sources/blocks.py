"""Annotated block files: a source line, edit lines, a blank line."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrigenda.model import HYP, KEYS, TARGET
from corrigenda.operators.grouped import GROUPED, grouped_record, ungroup
from corrigenda.sources.files import ROWS, text_blocks
from corrigenda.sources.options import for_writing, with_options

#: Fixed values of the format.
NOOP, NONE, FIELD = ("noop", "NA"), "-NONE-", "|||"
LINE = "A %d %d|||%s|||%s|||REQUIRED|||-NONE-|||%d"


def with_position(df: DataFrame, name: str = "sample_id") -> DataFrame:
    """Numbers the rows of a file scan from 0, in the order of files and of rows within them.

    Rows are counted per file split; only these counts pass through one task, not the rows.
    """
    d = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_m", F.monotonically_increasing_id())
    n = d.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    base = n.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    row = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")) - 1
    return d.withColumn("_r", row).join(base, ["_f", "_b"]).withColumn(name, (F.col("_base") + F.col("_r")).cast("bigint")).drop("_f", "_b", "_m", "_r", "_base")


#: A line ``T{i}``, with its alternative where it has one.
MARK = re.compile(r"T([0-9]+)(?:-A([0-9]+))?")


def _block(lines: list[str], char_level: bool) -> tuple[list[str], list[tuple[int, list[str], list[tuple]]]]:
    """The source of a block, and (number, tokens, edits) of each annotator; see ``read_block_rows``."""
    tokens = (lambda text: list("".join(text.split()))) if char_level else str.split
    src = tokens(next(x for x in lines if x.startswith("S"))[2:])
    alternative, most, found = 0, 0, {}
    for line in lines:
        mark = MARK.match(line)
        if mark:
            alternative = int(mark[2] or 0)
        if alternative:
            continue
        if mark:
            most = max(most, int(mark[1]))
        elif line.startswith("A "):
            f = line.split(FIELD)
            start, end = map(int, f[0][2:102].split(" ")[:2])
            who = int(f[-1])
            if len(f) < 5 or who < 0 or end < start >= 0:
                raise ValueError(f"not an annotation: {line[:200]}")
            most = max(most, who)
            if f[1] not in NOOP and start >= 0:
                cor = FIELD.join(f[2 : len(f) - 3])
                found.setdefault(who, []).append((start, end, tokens("" if cor == NONE else cor), f[1]))
    out = []
    for who in range(most + 1):
        own = [(start, end, no, new, kind) for no, (start, end, new, kind) in enumerate(sorted(found.get(who, []), key=lambda e: e[0]))]
        at, shift, text, edits = 0, 0, [], []
        for start, end, no, new, kind in sorted(own, key=lambda e: e[:3]):
            edits.append((no, start, end, start + shift, start + shift + len(new), src[start:end], new, [kind]))
            shift += len(new) - (end - start)
            text += src[at : max(start, at)] + new
            at = end
        out.append((who, text + src[at:], edits))
    return src, out


def read_block_rows(spark: SparkSession, path: str | Sequence[str], system_id: str, side: str = HYP, char_level: bool = False, max_sample: int = -1, remove_unchanged: bool = False) -> DataFrame:
    """Annotated block files as a grouped dataset (GROUPED), a block at a time, without a shuffle; see ``read_blocks``.

    With ``remove_unchanged`` targets that equal their source go, and those that stay are numbered anew.
    """
    pos = text_blocks(spark, path)
    if max_sample >= 0:
        pos = pos.where(F.col("sample_id") < max_sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, lines = (c.to_pylist() for c in batch.slice(lo, ROWS).columns)
                sources, targets = [], []
                for block in lines:
                    src, own = _block(block, char_level)
                    if remove_unchanged:
                        if not src:
                            raise ValueError("a sample has no source")
                        own = [(k, *t[1:]) for k, t in enumerate(t for t in own if t[1] != src)]
                    sources.append(src)
                    targets.append(own)
                yield grouped_record([system_id] * len(ids), ids, sources, [[side] * len(t) for t in targets], *([[t[k] for t in own] for own in targets] for k in range(3)))

    return pos.mapInArrow(run, GROUPED)


def read_blocks(spark: SparkSession, path: str | Sequence[str], system_id: str, side: str = HYP, char_level: bool = False, max_sample: int = -1, **options: bool) -> dict[str, DataFrame]:
    """``samples, targets, edits`` of annotated block files, whatever line ends they have and runs of blank lines part their blocks.

    Targets are the annotators named in a block (a ``T{i}`` line counts; ``T{i}-A{j}`` with j > 0 and
    what follows it is skipped), at least annotator 0. A noop annotation is a target without edits. The first
    ``max_sample`` blocks, all where negative; ``options`` are those of ``with_options``.
    """
    return with_options(ungroup(read_block_rows(spark, path, system_id, side, char_level, max_sample)), **options)


def block_lines(samples: DataFrame, targets: DataFrame, edits: DataFrame, texts: bool = False) -> DataFrame:
    """``sample_id, value``: a block per sample, its targets as annotators in order of their ids.

    With ``texts`` a line ``T{i}`` with its text stands before the edits of each target, and none for a noop.
    """
    cor = F.array_join("tgt_tokens", " ")
    line = F.format_string(LINE, "src_start", "src_end", F.array_join("types", ","), cor, "target_id")
    own = edits.select(*TARGET, F.struct("target_id", "src_start", "edit_no", line.alias("line")).alias("x"))
    noop = targets.join(edits.select(*TARGET).distinct(), TARGET, "left_anti").select(
        *TARGET, F.struct("target_id", F.lit(-1).alias("src_start"), F.lit(0).alias("edit_no"), F.format_string("A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||%d", "target_id").alias("line")).alias("x")
    )
    if texts:
        line = F.concat(F.format_string("T%d ", "target_id"), F.array_join("tgt_tokens", " "))
        noop = targets.select(*TARGET, F.struct("target_id", F.lit(-1).alias("src_start"), F.lit(-1).alias("edit_no"), line.alias("line")).alias("x"))
    body = own.unionByName(noop).groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    return samples.join(body, KEYS, "left").select("sample_id", F.concat_ws("\n", F.concat(F.lit("S "), F.array_join("src_tokens", " ")), "body", F.lit("")).alias("value"))


def grouped_block_lines(g: DataFrame, texts: bool = False, flatten: bool = False) -> DataFrame:
    """``block_lines`` of a grouped dataset, row by row: its columns but the targets, and ``values``, the blocks of a sample.

    That is one block, or with ``flatten`` one for each target in order of sides and numbers, which is target 0 there.
    """

    def lines(t: Column) -> Column:
        who = F.lit(0) if flatten else t["target_id"]
        entry = lambda start, no, line: F.struct(who.alias("target_id"), start.alias("src_start"), no.alias("edit_no"), line.alias("line"))
        own = F.transform(t["edits"], lambda e: entry(e["src_start"], e["edit_no"], F.format_string(LINE, e["src_start"], e["src_end"], F.array_join(e["types"], ","), F.array_join(e["tgt_tokens"], " "), who)))
        if texts:
            return F.concat(F.array(entry(F.lit(-1), F.lit(-1), F.concat(F.format_string("T%d ", who), F.array_join(t["tgt_tokens"], " ")))), own)
        noop = F.array(entry(F.lit(-1), F.lit(0), F.format_string("A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||%d", who)))
        return F.when(F.size(own) > 0, own).otherwise(noop)

    def block(entries: Column) -> Column:
        body = F.array_join(F.transform(F.sort_array(entries), lambda x: x["line"]), "\n")
        return F.concat_ws("\n", F.concat(F.lit("S "), F.array_join("src_tokens", " ")), F.when(F.size(entries) > 0, body), F.lit(""))

    if flatten:
        order = F.array_sort(F.transform("t", lambda t: F.struct(t["side"].alias("side"), t["target_id"].alias("target_id"), t["tgt_tokens"].alias("tgt_tokens"), t["edits"].alias("edits"))))
        values = F.transform(order, lambda t: block(lines(t)))
    else:
        values = F.array(block(F.flatten(F.transform("t", lines))))
    return g.select(*KEYS, values.alias("values"))


def write_blocks(samples: DataFrame, targets: DataFrame, edits: DataFrame, path: str, texts: bool = False, flatten: bool = False, max_sample: int = -1, grouped: DataFrame | None = None, compression: str = "none") -> None:
    """Blocks in the order of sample ids, one file per range of ids; see ``block_lines`` and ``for_writing``.

    Where the same dataset, of one system, is at hand ``grouped``, a row for each sample, all of it is written without joins.
    """
    if grouped is not None and max_sample < 0:
        made = grouped_block_lines(grouped, texts, flatten).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).select(F.explode("values").alias("value"))
    else:
        d = for_writing({"samples": samples, "targets": targets, "edits": edits}, flatten, max_sample)
        made = block_lines(d["samples"], d["targets"], d["edits"], texts).repartitionByRange("sample_id").sortWithinPartitions("sample_id").select("value")
    made.write.text(path, compression=compression)
