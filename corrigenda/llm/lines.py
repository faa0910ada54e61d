"""Line dedup: exact copies, and near copies through a deletion-neighbourhood join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import KEY, cut, id_filter, keyed, map_batches
from corrigenda.llm.spans import units

#: Lines with fewer words (characters in scripts without spaces) are compared by their characters,
#: and below so many characters only as exact copies.
NEAR_WORDS, NEAR_CHARS = 8, 12
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it can be inverted modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A line is hot if it holds this share of all line rows or more, so there are at most HOT_PARTS hot lines.
HOT_PARTS = 2_000


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hash(words: list[str]) -> int:
    return _signed(xxhash.xxh64_intdigest(" ".join(words)))


def parts(words: list[str], line: str) -> list[str] | None:
    """What edits of a line count in: words; characters, where there are few words; None where too few."""
    if len(words) >= NEAR_WORDS:
        return words
    text = " ".join(words)
    return list(text) if len(text) >= NEAR_CHARS and len(words) == len(line.split()) else None


def half_keys(words: list[str]) -> list[int]:
    """Hashes of beginnings and ends such that two lines at word distance 1 or less share one.

    One word inserted, deleted or replaced lies in the first or in the second half of the shorter
    line (m words), so either the first m // 2 words agree, or the last m - m // 2. A line of n words
    meets partners with m = n and m = n - 1, which makes three different keys.
    """
    n = len(words)
    firsts, lasts = {n // 2, (n - 1) // 2}, {n - n // 2, n - 1 - (n - 1) // 2}
    return [_signed(xxhash.xxh64_intdigest(" ".join(words[:h]), 1)) for h in sorted(firsts)] + [
        _signed(xxhash.xxh64_intdigest(" ".join(words[-h:]), 2)) for h in sorted(lasts)
    ]


def deletion_hashes(words: list[str]) -> list[int]:
    """Hash of the line without word p, for every p, in linear time (a polynomial over word hashes)."""
    h = [xxhash.xxh64_intdigest(w, 3) for w in words]
    n = len(h)
    before = [0] * (n + 1)
    power = 1
    for i, x in enumerate(h):
        before[i + 1] = (before[i] + x * power) & _MASK
        power = power * _BASE & _MASK
    total, out = before[n], []
    for p in range(n):
        out.append((before[p] + (total - before[p + 1]) * _INVERSE) & _MASK)
    return out


def whole_hash(words: list[str]) -> int:
    total, power = 0, 1
    for w in words:
        total = (total + xxhash.xxh64_intdigest(w, 3) * power) & _MASK
        power = power * _BASE & _MASK
    return total


def within_one(a: list[str], b: list[str]) -> bool:
    """Word edit distance 1 or less."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def near_copy(a: list[str], b: list[str]) -> bool:
    """Distance 1 or less; but a line of characters that differs by a digit is another line."""
    if not within_one(a, b):
        return False
    if max(map(len, a)) > 1:
        return True
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return not any(c.isdigit() for c in a[k : k + 1] + b[k : k + 1])


def _lines(docs: DataFrame) -> DataFrame:
    """One row per document and distinct line: ``h, k, line, a, b, c, again``."""
    schema = T.StructType([
        T.StructField("h", T.LongType()), T.StructField("k", docs.schema["k"].dataType), T.StructField("line", T.IntegerType()),
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("c", T.LongType()), T.StructField("again", T.BooleanType()),
    ])

    def run(ids, texts):
        out: dict = {f.name: [] for f in schema.fields}
        for j, text in enumerate(texts):
            seen: dict[int, int] = {}
            for n, line in enumerate((text.as_py() or "").split("\n")):
                words = units(line)
                if not words:
                    continue
                h = line_hash(words)
                if h in seen:
                    out["again"][seen[h]] = True
                    continue
                seen[h] = len(out["h"])
                of = parts(words, line)
                keys = half_keys(of) if of else []
                keys += [None] * (3 - len(keys))
                for name, v in zip(out, (h, j, n, *keys[:3], False)):
                    out[name].append(v)
        yield out | {"k": ids.take(pa.array(out["k"], pa.int64()))}

    return map_batches(docs, ["k", "t"], schema, run)


def _near_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``h`` of the lines that have an earlier line at distance 1."""
    keys = classes.where("a is not null").select("h", F.explode(F.array("a", "b", "c")).alias("key")).where("key is not null")
    # ends and beginnings that are not shared cannot belong to a near copy: most lines stop here
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("sk"))
    alive = cut(keys.join(shared, F.col("key") == F.col("sk")).select("h").distinct().join(classes.select("h", "k", "line"), "h"), "near-lines")
    test = id_filter(alive, "k")
    wanted = alive.groupBy("k").agg(F.collect_list(F.struct("h", "line")).alias("want"))
    texts = docs.where(test("k")).join(wanted.withColumnRenamed("k", "wk"), F.col("k") == F.col("wk")).select("k", "t", F.col("want.h").alias("hs"), F.col("want.line").alias("ls"))
    key = T.StructField("k", docs.schema["k"].dataType)
    schema = T.StructType([T.StructField("h", T.LongType()), key, T.StructField("line", T.IntegerType()), T.StructField("words", T.StringType())])

    def find(ids, texts, hs, ls):
        out: dict = {f.name: [] for f in schema.fields}
        for j, (text, want, at) in enumerate(zip(texts, hs.to_pylist(), ls.to_pylist())):
            open_ = dict(zip(want, at))
            for line in (text.as_py() or "").split("\n"):
                words = units(line)
                if words and (h := line_hash(words)) in open_:
                    for name, v in zip(out, (h, j, open_.pop(h), "\n".join(parts(words, line)))):
                        out[name].append(v)
        yield out | {"k": ids.take(pa.array(out["k"], pa.int64()))}

    found = cut(map_batches(texts, ["k", "t", "hs", "ls"], schema, find), "near-texts")
    var = T.StructType([T.StructField("role", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("h", T.LongType()), key, T.StructField("line", T.IntegerType())])

    def variants(hs, ks, lines, texts):
        out: dict = {f.name: [] for f in var.fields}
        for j, text in enumerate(texts):
            words = text.as_py().split("\n")
            gone = deletion_hashes(words)
            # role 0: a part replaced at p, so the rest and p agree; 1: a part more than; 2: the line itself
            own = [_signed((v * 31 + p * _BASE) & _MASK) for p, v in enumerate(gone)]
            more = {_signed(v) for v in gone}
            out["role"] += [0] * len(own) + [1] * len(more) + [2]
            out["key"] += [*own, *more, _signed(whole_hash(words))]
            out["h"] += [j] * (len(own) + len(more) + 1)
        at = pa.array(out["h"], pa.int64())
        yield out | {"h": hs.take(at), "k": ks.take(at), "line": lines.take(at)}

    v = cut(map_batches(found, ["h", "k", "line", "words"], var, variants), "variants")
    place = F.struct("k", "line", "h")
    same = v.where("role = 0")
    first = same.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("fk"), "first")
    swapped = same.join(first, F.col("key") == F.col("fk")).where(place > F.col("first")).select("h", F.col("first.h").alias("by"))
    longer = v.where("role = 1").select("key", place.alias("x"))
    shorter = v.where("role = 2").select(F.col("key").alias("sk"), place.alias("y"))
    grown = longer.join(shorter, F.col("key") == F.col("sk")).select(F.greatest("x", "y").alias("late"), F.least("x", "y").alias("early")).select(F.col("late.h").alias("h"), F.col("early.h").alias("by"))
    pairs = swapped.unionByName(grown).distinct()
    close = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: near_copy(x.split("\n"), y.split("\n"))).astype(bool), "boolean")
    words = found.select("h", "words")
    return (
        pairs.join(words, "h")
        .join(words.select(F.col("h").alias("by"), F.col("words").alias("other")), "by")
        .where(close("words", "other"))
        .select("h")
        .distinct()
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all other columns and all rows stay.

    A line goes if an earlier one (by id, then line number) is equal up to white space, or at edit
    distance 1: from NEAR_WORDS words on, one word inserted, deleted or replaced; below, from
    NEAR_CHARS characters on, one character, if it is no digit. What counts as earlier need not
    itself be kept. Blank lines always stay. In scripts without spaces each character counts as a
    word. The remaining lines keep their order and spelling.

    Copies are one class whatever their number; classes that share no beginning or end with another
    cannot have a near copy and stop there; the others emit hashed deletion variants, are grouped by
    equal variants, linked to the earliest of each group (never pairs within a group: a template line
    with one varying word gives one link per line, in joins that Spark splits where a key is hot), and
    verified. The rows of lines with a share of 1 / HOT_PARTS or more are not shuffled by line.
    Only documents that lose a line are shuffled at the end. Null text stays null. Rows that share
    an id, or have none, are documents of their own: behind one another, those without an id behind
    all others. A text may become empty; an empty table stays empty.
    """
    rows = keyed(docs, id_col)
    base = rows.select(F.col(KEY).alias("k"), F.col(text_col).alias("t"))
    lines = cut(_lines(base), "lines")
    classes = cut(
        lines.groupBy("h").agg(F.min("k").alias("k"), F.max("k").alias("last"), F.count("*").alias("n"), F.min_by("line", "k").alias("line"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("c").alias("c")),
        "line-classes",
    )
    near = _near_classes(classes, base).select(F.col("h").alias("nh"), F.lit(True).alias("near"))
    bad = classes.join(near, F.col("h") == F.col("nh"), "left").where("near or last > k").select(F.col("h").alias("bh"), F.col("k").alias("bk"), F.coalesce("near", F.lit(False)).alias("near"), "n")
    bad = cut(bad, "bad-lines")
    # the rows of a hot line stay where they are: at most HOT_PARTS lines are sent to them
    many = lines.count() // HOT_PARTS + 1
    hot = F.broadcast(bad.where(F.col("n") >= many))
    cold = lines.join(hot.select("bh"), F.col("h") == F.col("bh"), "left_anti").join(bad.where(F.col("n") < many), F.col("h") == F.col("bh"))
    gone = lines.join(hot, F.col("h") == F.col("bh")).unionByName(cold).where("near or k > bk").select("k", "h", F.lit(True).alias("every"))
    gone = gone.unionByName(lines.where("again").select("k", "h", F.lit(False).alias("every")))
    lists = cut(gone.groupBy("k").agg(F.collect_set(F.when(F.col("every"), F.col("h"))).alias("__corrigenda_lines")).withColumnRenamed("k", "__corrigenda_id"), "gone-lines")

    @F.pandas_udf("string")
    def strip(texts, gone):
        import pandas as pd

        return pd.Series([_strip(t, g) for t, g in zip(texts, gone)], dtype=object)

    test = id_filter(lists, "__corrigenda_id")
    hit = rows.where(test(KEY))
    done = hit.join(lists, F.col(KEY) == F.col("__corrigenda_id"), "left").withColumn(text_col, F.when(F.col("__corrigenda_id").isNotNull(), strip(F.col(text_col), F.col("__corrigenda_lines"))).otherwise(F.col(text_col)))
    return done.select(*docs.columns).unionByName(rows.where(~test(KEY)).select(*docs.columns))


def _strip(text: str | None, gone) -> str | None:
    if text is None or gone is None:
        return text
    out, seen = [], set(np.asarray(gone, dtype=object).tolist())
    for line in text.split("\n"):
        words = units(line)
        if words:
            h = line_hash(words)
            if h in seen:
                continue
            seen.add(h)
        out.append(line)
    return "\n".join(out)
