"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at a time inside a task; keeps the Python side of a batch small.
SLICE_CHARS = 1 << 20
#: Bits of the fixed-size document filter (2 MiB), whatever the number of documents.
FILTER_BITS = 1 << 24


#: Added by ``keyed``: the id where ids are unique, else a struct that tells rows with one id apart.
KEY = "__corrigenda_key"
_written: list[str] | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode, where it is unset, a new local one."""
    set_by = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_by:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_by = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(set_by)
    return set_by.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written is not None:
        _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that ``cut`` has written for ``df``; nothing may read it any more."""
    path = getattr(df, "written_to", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what ``cut`` has written inside: the paths in the list it gives, unless taken out."""
    global _written
    outer, _written = _written, []
    try:
        yield _written
    finally:
        gone, _written = _written, outer
        for path in gone:
            _delete(spark, path)


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with KEY, which is unique, and ordered by id; rows without an id come last.

    Where ids are unique and not null, which one narrow aggregation finds out, KEY is the id.
    Otherwise it is a struct; rows with a repeated id or none are written once, with a number each,
    so that every one of them is a document of its own, in the order in which Spark reads them.
    """
    again = cut(docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).select(F.col(id_col).alias("__corrigenda_odd")), "repeated-ids")
    if again.isEmpty():
        return docs.withColumn(KEY, F.col(id_col))
    test = id_filter(again.dropna(), "__corrigenda_odd")
    same = F.col(id_col) == F.col("__corrigenda_odd")
    likely, none = docs.where(F.col(id_col).isNotNull() & test(id_col)), docs.where(F.col(id_col).isNull())
    odd = none.unionByName(likely.join(again.dropna(), same, "left_semi"))
    odd = cut(odd.withColumn("__corrigenda_no", F.monotonically_increasing_id() + 1), "repeated-rows")
    plain = docs.where(F.col(id_col).isNotNull() & ~test(id_col)).unionByName(likely.join(again.dropna(), same, "left_anti"))
    both = plain.withColumn("__corrigenda_no", F.lit(0).cast("long")).unionByName(odd)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__corrigenda_no").alias("no"))
    return both.withColumn(KEY, key).drop("__corrigenda_no")


def map_batches(
    df: DataFrame, columns: list[str], schema: T.StructType, fn: Callable[..., Iterator[dict]]
) -> DataFrame:
    """``mapInArrow`` over ``columns`` of ``df``; ``fn(*arrays)`` yields dicts of output columns.

    A batch is cut into slices of about SLICE_CHARS characters of its string columns, so that a
    batch of very long texts does not multiply in memory.
    """
    names = [f.name for f in schema.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch):
                part = batch.slice(lo, hi - lo)
                for out in fn(*part.columns):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[n], arrow.field(n).type) if not isinstance(out[n], pa.Array) else out[n].cast(arrow.field(n).type) for n in names],
                        names=names,
                    )
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch holding about SLICE_CHARS bytes of strings each; at least one row."""
    n = batch.num_rows
    if not n:
        return
    size = np.ones(n, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            size += np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    part = np.cumsum(size) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    yield from zip(cuts, cuts[1:])


def field_of(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def id_filter(ids: DataFrame, column: str) -> Callable[[str], F.Column]:
    """A fixed-size bit filter of the ids in ``ids``; returns ``test(column_name) -> Column``.

    Never false for an id that is there; a false alarm costs work, not results. 2 MiB travel to the
    driver and back, at any size of ``ids``; when it fills up it merely stops saving a shuffle.
    """
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    words = (
        ids.select(slot.alias("s"))
        .groupBy(F.floor(F.col("s") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = ids.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.pandas_udf("boolean")
    def hit(s):
        v = s.to_numpy().astype(np.int64)
        import pandas as pd

        return pd.Series((shared.value[v >> 6] >> (v & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return lambda name: hit(F.pmod(F.xxhash64(F.col(name)), F.lit(FILTER_BITS)))


def without_keys(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (with KEY) without the keys in ``gone`` (one column); only likely hits are shuffled. KEY goes."""
    ids = cut(gone.toDF("__corrigenda_gone").distinct(), "gone-ids")
    test = id_filter(ids, "__corrigenda_gone")
    hit = docs.where(test(KEY)).join(ids, F.col(KEY) == F.col("__corrigenda_gone"), "left_anti")
    return docs.where(~test(KEY)).unionByName(hit).drop(KEY)
