"""Files and records of text sources: listing, blocks between blank lines, places in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrigenda.tables import saved

#: Characters of which blank lines are made.
BLANK = " \t\n\x0b\f\r\ufeff"
#: Blocks that are given on at a time.
ROWS = 2048


def list_files(spark: SparkSession, folder: str, exclude: Sequence[str] = (), recursive: bool = False, limit: int | None = None) -> list[str]:
    """The files of a folder in order of their paths, without those whose name, or path below the folder, fits a pattern of ``exclude``.

    Works on any file system that Spark reads; a positive ``limit`` keeps the first so many. Raises where there is none.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    found, it = [], fs.listFiles(top, recursive)
    while it.hasNext():
        path = it.next().getPath().toString()
        below = path.removeprefix(base)
        if not any(fnmatch(below, p) or fnmatch(below.rsplit("/", 1)[-1], p) for p in exclude):
            found.append(path)
    if not found:
        raise ValueError(f"no files in {folder}")
    found.sort()
    return found[:limit] if limit and limit > 0 else found


LINES = "_f string, _b bigint, _j bigint, lines array<string>"
ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ENDS = "_f string, _b bigint, _n bigint, _head array<string>, _tail array<string>, _head_open boolean, _tail_open boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[str], bool, bool]]:
    """Of the lines ``value, _f, _b`` of a task, split by split: file, place, number of the run in its split, its lines, whether it begins and whether it ends with the split.

    Run 0 is what a split begins with, if that is not blank, and else empty; the last run may be empty, too.
    """
    key, run, number, first = None, [], 0, True
    for batch in batches:
        for value, *here in zip(*(c.to_pylist() for c in batch.columns)):
            if here != key:
                if key is not None:
                    yield *key, number, run, number == 0, True
                key, run, number, first = here, [], 0, True
            if not value.strip(BLANK):
                if run or number == 0:
                    yield *key, number, run, number == 0, False
                    number += 1
                run = []
            else:
                run.append(value.removeprefix("\ufeff"))
    if key is not None:
        yield *key, number, run, number == 0, True


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ENDS of each split: the number of runs that begin behind its first line, and the lines of what lies at its borders."""
    head: list[str] = []
    for f, b, number, lines, begins, ends in _runs(batches):
        head = lines if begins else head
        if ends:
            whole = begins  # one run from border to border
            n = number - 1 + bool(lines) if number else 0
            yield _record([(f, b, n, head, [] if whole else lines, bool(head), bool(lines))], ENDS)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINES of the runs that lie within their split."""
    rows: list[tuple] = []
    for f, b, number, lines, begins, ends in _runs(batches):
        if not begins and not ends:
            rows.append((f, b, number, lines))
        if len(rows) >= ROWS:
            yield _record(rows, LINES)
            rows = []
    yield _record(rows, LINES)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names=list(names))


def text_blocks(spark: SparkSession, path: str | Sequence[str], name: str = "sample_id") -> DataFrame:
    """``name, lines array<string>``: runs of lines that are not blank, numbered from 0 in the order of files and of lines.

    Lines may end in any way, also differently in one file; files may be compressed. Blocks begin and end
    with their file. A block is put together where it is read; what lies at the borders of a split is gathered
    first, with the number of blocks that begin in it. Only these, a row for each split, are saved and pass
    through one task; only blocks at borders are put together by a shuffle.
    """
    rows = spark.read.text(path if isinstance(path, str) else list(path)).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    ends = saved(rows.mapInArrow(_ends, ENDS).repartition("_f"), "ends")
    before = F.lag("_tail_open").over(Window.partitionBy("_f").orderBy("_b"))
    ends = ends.withColumn("_opens", (F.col("_head_open") & ~F.coalesce(before, F.lit(False))).cast("int"))
    counts = ends.select("_f", "_b", "_n", "_opens")
    every = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    # behind the border run 0 a split's runs are numbered from 1
    base = counts.select("_f", "_b", (F.coalesce(F.sum(F.col("_n") + F.col("_opens")).over(every), F.lit(0)) + F.col("_opens") - 1).alias("_base"))
    number = (F.col("_base") + F.col("_j")).cast("bigint").alias(name)
    inner = rows.mapInArrow(_inner, LINES).join(F.broadcast(base), ["_f", "_b"]).select(number, "lines")
    borders = F.array(F.struct(F.lit(0).cast("bigint").alias("_j"), F.col("_head").alias("v")), F.struct(F.col("_n").alias("_j"), F.col("_tail").alias("v")))
    each = ends.select("_f", "_b", F.explode(F.filter(borders, lambda x: F.size(x["v"]) > 0)).alias("x")).select("_f", "_b", "x.*")
    parts = each.join(F.broadcast(base), ["_f", "_b"]).groupBy(number).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_j", "v"))), lambda x: x["v"])).alias("lines"))
    return inner.unionByName(parts)


def places(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its rows' places in ``order`` from 0, without one task for all: rows are dealt by range, and of each range the number counts.

    ``order`` tells any two rows apart.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    dealt = saved(dealt, "places")
    n = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_low"))
    base = n.select("_p", "_low", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return dealt.join(F.broadcast(base), "_p").withColumn(name, (F.col("_base") + F.col("_m") - F.col("_low")).cast("bigint")).drop("_p", "_m", "_low", "_base")


def first_samples(samples: DataFrame, n: int) -> DataFrame:
    """The ``n`` first samples of each system in order of their ids; all where ``n`` is negative."""
    if n < 0:
        return samples
    at = places(samples.select("system_id", "sample_id"), ["system_id", "sample_id"], "_at")
    low = at.groupBy("system_id").agg(F.min("_at").alias("_low"))
    keep = at.join(low, "system_id").where(F.col("_at") - F.col("_low") < n).select("system_id", "sample_id")
    return samples.join(keep, ["system_id", "sample_id"], "left_semi")
