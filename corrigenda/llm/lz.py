"""Lempel-Ziv phrase fingerprints of documents and of their edited texts."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import field_of

#: Minimum hashes of a fingerprint.
SIGNATURE = 64
#: Bytes of text a shuffle partition is meant to hold; the most partitions there are; ranges of
#: rows dealt to each, so that long texts even out; rows drawn per range to place the borders.
PARTITION_BYTES, MAX_PARTITIONS, RANGES_PER_PARTITION, DRAWN = 32 << 20, 20_000, 16, 12


class Parse:
    """Dictionary parse of a text: each phrase is the shortest prefix of the rest not yet a phrase.

    All prefixes of a phrase are phrases, so the longest known one is found by stepping up or down
    from the length of the last phrase instead of from one character.
    """

    def __init__(self, text: str, seen: set[str] | None = None, at: int = 0):
        self.seen: set[str] = set() if seen is None else seen
        self.at = at  # where the first phrase that the end of the text cut off begins
        self.tail = ""
        self._run(text)

    def _run(self, s: str) -> None:
        seen, n, i, k = self.seen, len(s), self.at, 1
        add = seen.add
        while i < n:
            if s[i : i + k] in seen:
                k += 1
                while s[i : i + k] in seen and i + k <= n:
                    k += 1
            else:
                while k > 1 and s[i : i + k - 1] not in seen:
                    k -= 1
            if i + k > n:
                break
            add(s[i : i + k])
            i += k
        self.at, self.tail = i, s[i:]


def phrase_hashes(phrases: set[str] | list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p) for p in phrases), "<u8", len(phrases))


def signature(hashes: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """The ``size`` smallest distinct hashes, sorted."""
    if len(hashes) > 4 * size:
        hashes = np.partition(hashes, 2 * size)[: 2 * size + 1]
    return np.unique(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """Estimated share of common phrases: those of the smallest hashes of the union in both. Empty with empty: 1."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:size]
    return float((np.isin(union, a) & np.isin(union, b)).sum() / len(union))


def _phrases(text: str) -> set[str]:
    p = Parse(text)
    if p.tail:
        p.seen.add(p.tail)
    return p.seen


def fingerprint(text: str | None, size: int = SIGNATURE) -> np.ndarray:
    """Minimum-hash signature of the phrases of a text, its unfinished last phrase included."""
    return signature(phrase_hashes(_phrases(text or "")), size)


def fingerprint_with_edit(text: str, keep: int, new_tail: str, size: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of ``text[:keep] + new_tail``; the common beginning is parsed once."""
    head = Parse(text[:keep])
    whole = Parse(text, set(head.seen), head.at)
    edited = Parse(text[:keep] + new_tail, set(head.seen), head.at)
    common = phrase_hashes(head.seen)
    low = signature(common, size)
    out = []
    for p in (whole, edited):
        more = p.seen - head.seen
        if p.tail:
            more.add(p.tail)
        out.append(signature(np.concatenate([low, phrase_hashes(more)]), size))
    return out[0], out[1]


def hex_signature(sig: np.ndarray) -> str:
    return sig.astype(">u8").tobytes().hex()


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIGNATURE, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Every text against its edited text and against the next document (descending id; after the last, the first).

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Rows are ordered by id, those with one id or none by a hash of their text, and cut into ranges at
    the quantiles of a bounded sample of ids and hashes; each text is shuffled once, to its range, and
    read in order there. The first document of a range also goes to the range before it as a guest, so
    that no window over all rows is needed. Partitions follow the size of the texts. Null text is
    empty; rows with a null id come last; equal rows follow one another and are parsed once. A single
    document is its own next; an empty table stays empty.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    n, held_bytes = base.agg(F.count("*"), F.sum(F.octet_length("_t"))).first()
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTITIONS, (held_bytes or 0) // partition_bytes))
    n_ranges = n_parts * RANGES_PER_PARTITION
    place = F.struct(F.col("_id").isNull().alias("none"), F.coalesce(-F.col("_id").cast("long"), F.lit(0)).alias("id"), F.col("_h").alias("h"))
    drawn = base.sample(False, min(1.0, DRAWN * n_ranges / max(1, n)), 7).select(place.alias("p")).select("p.*").toPandas()
    drawn = sorted(zip(drawn["none"].tolist(), drawn["id"].tolist(), drawn["h"].tolist()))
    borders = sorted({drawn[len(drawn) * k // n_ranges] for k in range(1, n_ranges)}) if drawn else []

    @F.pandas_udf("int")
    def find(p: pd.DataFrame) -> pd.Series:
        return pd.Series([bisect_right(borders, x) for x in zip(p["none"].tolist(), p["id"].tolist(), p["h"].tolist())], dtype="int32")

    tops = base.select(place.alias("p")).withColumn("b", find("p")).groupBy("b").agg(F.min("p").alias("p")).select("b", "p.*").toPandas()
    order = sorted(tops["b"].tolist())
    before = dict(zip(order, [order[-1], *order[:-1]])) if order else {}  # the first range is also the guest of the last
    top = dict(zip(tops["b"], zip(tops["none"].tolist(), tops["id"].tolist(), tops["h"].tolist())))

    @F.pandas_udf("array<int>")
    def places(p: pd.DataFrame) -> pd.Series:
        out = []
        for x in zip(p["none"].tolist(), p["id"].tolist(), p["h"].tolist()):
            b = bisect_right(borders, x)
            out.append([b, -1 - before[b]] if x == top[b] else [b])
        return pd.Series(out)

    dealt = (
        base.withColumn("_p", F.explode(places(place)))
        .select("_id", "_t", "_h", F.when(F.col("_p") < 0, -1 - F.col("_p")).otherwise(F.col("_p")).alias("_b"), (F.col("_p") < 0).alias("_g"))
        .repartition(n_parts, "_b")
        .sortWithinPartitions(F.col("_b"), F.col("_g"), F.col("_id").desc_nulls_last(), F.col("_h"), F.col("_t"))
        .select("_id", "_t", "_b", "_g")
    )
    schema = T.StructType([
        field_of(docs, id_col), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held = None  # (bucket, id, text) that waits for its next document
        waiting = None  # (sig, row) whose near_next is open
        rows: list[tuple] = []
        done_bucket = None
        known = None  # ((text, tail), fingerprints) of the document before: equal rows follow one another
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for key, t, b, g in zip(*(c.to_pylist() for c in part.columns)):
                    if held is not None and held[0] == b:
                        keep = len(held[2]) - len(held[2]) // 3
                        tail = t[: len(held[2]) // 3]
                        if known is None or known[0] != (held[2], tail):
                            known = ((held[2], tail), fingerprint_with_edit(held[2], keep, tail, size))
                        own, edit = known[1]
                        if waiting is not None:
                            rows.append((*waiting[1], likeness(waiting[0], own, size)))
                        sha = hashlib.sha256((held[2][:keep] + tail).encode()).hexdigest()
                        waiting = (own, (held[1], len(held[2]), sha, hex_signature(own), hex_signature(edit), likeness(own, edit, size)))
                    if g:  # the guest closes its bucket; further guests (ties) are not needed
                        if waiting is not None and done_bucket != b:
                            rows.append((*waiting[1], likeness(waiting[0], fingerprint(t, size), size)))
                        held = waiting = None
                        done_bucket = b
                    else:
                        held = (b, key, t)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows = []

    return dealt.mapInArrow(run, schema)
