"""Near copies by the exact Jaccard similarity of their word shingles; SimHash fingerprints name the candidates."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import KEY, cut, id_filter, keyed, map_batches, without_keys
from corrigenda.llm.components import components
from corrigenda.llm.simhash import _LOWER, SEED, majority, near_edges

SHINGLE, SIMILARITY = 5, 0.8
#: Rounds in which each band's classes are compared with one of them, before the rest is.
ROUNDS = 2
#: Words of 64 bits of a set's fingerprint; bits by which the search through vantage-point trees reaches.
WORDS, DISTANCE = 4, 3
#: Chance that two sets at the similarity are not compared by the wide search, at most.
MISS = 3e-5
#: Sets of so few shingles are also found by the smallest of their hashes, exactly.
TINY = 8
#: Fingerprints that a bucket of the wide search is meant to hold; above so many it is dealt to several tasks.
BUCKET_ROWS, TASK_ROWS = 4_096, 32_768
_BASE, _C1, _C2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_DRAW = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64)
_TIMES, _XOR = _DRAW[0] * np.uint64(2) + np.uint64(1), _DRAW[1]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``shingle`` words (of the whole text, if it has fewer)."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), "<u8", len(words))
    m = max(1, len(w) - shingle + 1)
    h = np.zeros(m, "<u8")
    for j in range(min(len(w), shingle)):
        h = h * _BASE + w[j : j + m]
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(33))) * _C2
    return np.unique(h ^ (h >> np.uint64(33)))


def set_print(s: np.ndarray) -> np.ndarray:
    """SimHash of a set in WORDS words: bits that over half its hashes have; each word mixes the hashes anew."""
    h = (s[:, None] ^ _XOR) * _TIMES
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return majority(h ^ (h >> np.uint64(32))).view("<u8") if len(s) else np.zeros(WORDS, "<u8")


def tiny_keys(s: np.ndarray, similarity: float) -> list[int]:
    """The smallest hashes of a set of up to TINY: two such sets at the similarity have one of them in common."""
    n = len(s)
    return s[: n - math.ceil(similarity * n - 1e-6) + 1].view(np.int64).tolist() if 0 < n <= TINY else []


def flip(similarity: float) -> float:
    """Chance, at most, that two sets at the similarity differ in a given bit.

    The sums behind a bit have a cosine of at least 2s / (1 + s), and signs differ with the angle.
    Some more covers sets of a few shingles, where sums are small numbers and ties count as 0. Worked
    out for 0.8: 0.152 for large sets, at most 0.161 for all but 5 and 4 shingles (0.1875; see TINY).
    """
    return 1.07 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def _chances(bits: int, p: float) -> np.ndarray:
    """The binomial distribution of the number of differing bits."""
    return np.array([math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(bits + 1)])


def _reach(bits: int, p: float, miss: float = 1e-6) -> int:
    """Differing bits that are exceeded with a chance of ``miss`` at most."""
    return int(np.flatnonzero(np.cumsum(_chances(bits, p)[::-1])[::-1] > miss)[-1])


def tables_for(bits: int, p: float, miss: float = MISS) -> int:
    """Tables, each by ``bits`` drawn bits, of which two fingerprints share no bucket with a chance of ``miss`` at most."""
    total, chances, same = 64 * WORDS, _chances(64 * WORDS, p), np.ones(64 * WORDS + 1)
    for i in range(bits):
        same *= np.maximum(0.0, total - np.arange(total + 1) - i) / (total - i)
    n = 1
    while (chances * (1 - same) ** n).sum() > miss:
        n += 1
    return n


def _linked(prints: np.ndarray, left: np.ndarray, right: np.ndarray | None, reach: int, half_reach: int) -> np.ndarray:
    """Row -> smallest row of its group, from the pairs of a ``left`` and a ``right`` row (None: of two left rows)
    that differ in ``reach`` bits or fewer (``half_reach`` in the first half), in blocks."""
    root = np.arange(len(prints))
    words, half = prints.shape[1], prints.shape[1] // 2
    others = left if right is None else right
    lo = 0
    while lo < len(left) and len(others):
        at = others[lo:] if right is None else others
        rows = left[lo : lo + max(1, (1 << 18) // len(at))]
        lo += len(rows)
        d = np.bitwise_count(prints[rows, None, 0] ^ prints[None, at, 0])
        for k in range(1, half):
            d += np.bitwise_count(prints[rows, None, k] ^ prints[None, at, k])
        i, j = np.nonzero(d <= half_reach)
        i, j, d = rows[i], at[j], d[i, j].astype(np.int64)
        for k in range(half, words):
            d += np.bitwise_count(prints[i, k] ^ prints[j, k])
        i, j = i[d <= reach], j[d <= reach]
        while True:
            a, b = root[i], root[j]
            live = a != b
            if not live.any():
                break
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def wide_groups(prints: DataFrame, similarity: float, bucket_rows: int = BUCKET_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``d, key``: rows of ``prints`` (``d``, ``p``: WORDS words) that share a key are near in their fingerprints, or linked by such.

    No tree over 64 bits parts balls as wide as the similarity asks for. So each of some tables deals
    the fingerprints to buckets by bits drawn for it, as many as keep a bucket small, and as many
    tables as two fingerprints at the similarity need to meet in one. A bucket compares all its rows
    on all bits and gives each linked row the key of its group, never pairs. Large buckets (crowds)
    are dealt to several tasks, rows against rows.
    """
    n = prints.count()
    p = flip(similarity)
    bits = max(0, math.ceil(math.log2(max(1, n) / bucket_rows)))
    rng = np.random.default_rng(SEED)
    chosen = [np.sort(rng.choice(64 * WORDS, bits, replace=False)) for _ in range(tables_for(bits, p))]
    reach, half_reach = _reach(64 * WORDS, p), _reach(32 * WORDS, p)

    def buckets(words):
        for at in chosen:
            bucket = np.zeros(len(words), np.int64)
            for k, bit in enumerate(at):
                bucket |= (words[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(np.int64) << k
            yield bucket

    def read(p):
        return np.asarray(p.flatten()).astype(np.int64).view(np.uint64).reshape(-1, WORDS)

    crowded: dict[tuple[int, int], int] = {}
    place_fields = [T.StructField("tab", T.IntegerType()), T.StructField("bucket", T.LongType())]
    if n > task_rows:

        def only_place(p):
            for t, bucket in enumerate(buckets(read(p))):
                yield {"tab": np.full(len(bucket), t), "bucket": bucket}

        held = map_batches(prints, ["p"], T.StructType(place_fields), only_place).groupBy("tab", "bucket").count()
        crowded = {(r.tab, r.bucket): -(-2 * r["count"] // task_rows) for r in held.where(F.col("count") > task_rows).collect()}
    schema = T.StructType([*place_fields, T.StructField("part", T.IntegerType()), T.StructField("left", T.BooleanType()), T.StructField("d", T.LongType()), *(T.StructField(f"p{k}", T.LongType()) for k in range(WORDS))])

    def place(d, p):
        d, words = np.asarray(d).astype(np.int64), read(p)
        for t, bucket in enumerate(buckets(words)):
            rows, part, left = [np.arange(len(d))], [np.zeros(len(d), int)], [np.ones(len(d), bool)]
            for b, m in ((b, m) for (u, b), m in crowded.items() if u == t):
                # m groups: the part i, j compares group i with group j, or within itself
                mine = np.flatnonzero(bucket == b)
                own = (d[mine].view(np.uint64) % np.uint64(m)).astype(int)
                rows[0] = rows[0][bucket[rows[0]] != b]
                for j in range(m):
                    rows.append(mine)
                    part.append(np.minimum(own, j) * m + np.maximum(own, j))
                    left.append(own <= j)
            part[0], left[0] = part[0][: len(rows[0])], left[0][: len(rows[0])]
            at = np.concatenate(rows)
            yield {"tab": np.full(len(at), t), "bucket": bucket[at], "part": np.concatenate(part), "left": np.concatenate(left), "d": d[at]} | {f"p{k}": words[at, k].view(np.int64) for k in range(WORDS)}

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values("d", kind="stable")
        d, left = pdf["d"].to_numpy(), pdf["left"].to_numpy(bool)
        words = np.ascontiguousarray(pdf[[f"p{k}" for k in range(WORDS)]].to_numpy(np.int64)).view(np.uint64)
        root = _linked(words, np.flatnonzero(left), None if left.all() else np.flatnonzero(~left), reach, half_reach)
        live = np.bincount(root, minlength=len(root))[root] > 1
        first = {c: pdf[c].iloc[0] for c in ("tab", "bucket", "part")}
        return pd.DataFrame({"d": d[live], "root": d[root][live], **first})

    placed = map_batches(prints, ["d", "p"], schema, place)
    grouped = placed.groupBy("tab", "bucket", "part").applyInPandas(join, "d long, root long, tab int, bucket long, part int")
    return grouped.select("d", F.xxhash64("tab", "bucket", "part", "root").alias("key"))


def print_groups(prints: DataFrame, similarity: float) -> DataFrame:
    """``d, key`` of all rows of ``prints``: candidates share a key.

    Fingerprints (the first word) within DISTANCE bits are found exactly, through the vantage-point
    trees of ``near_edges``; those further apart by ``wide_groups`` on all words.
    """
    marks = prints.select("d", F.col("p")[0].alias("fp"))
    near = cut(near_edges(marks.select("fp").distinct(), DISTANCE, "fp"), "print-edges")
    linked = marks.join(near, F.col("fp") == F.col("u")).select("d", F.col("v").alias("key"))
    return marks.select("d", F.col("fp").alias("key")).unionByName(linked).unionByName(wide_groups(prints, similarity))


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets have the similarity; sets of unlike size are not compared."""
    a, b = F.col("s"), F.col("r")
    pairs = pairs.where(F.least("u.n", "v.n") >= similarity * F.greatest("u.n", "v.n")).distinct()
    both = pairs.join(sets, F.col("u.d") == F.col("sd")).drop("sd").join(sets.toDF("rd", "r"), F.col("v.d") == F.col("rd"))
    common = F.size(F.array_intersect(a, b))
    return both.where(common >= similarity * (F.size(a) + F.size(b) - common)).select("u", "v")


def _by_rare(classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: the pairs of classes in unlike components that may have the similarity; none that has is missing.

    Shingles are ordered by the number of ``classes`` that hold them, rarest first. Of two sets
    with ``common`` shingles in common the first common one has ``common - 1`` more behind it in both,
    so it stands among the first ``n - common + 1`` of each. Texts of one template meet in their rare
    shingles, of which unlike ones have none in common, and not in those of the template.
    """
    h = classes.join(sets, F.col("x.d") == F.col("sd")).select("x", "c", F.explode("s").alias("h"))
    often = h.groupBy("h").agg(F.count("*").alias("m")).withColumnRenamed("h", "oh")
    place = Window.partitionBy("x").orderBy("m", "h")
    rows = h.join(often, F.col("h") == F.col("oh")).select("x", "c", "h", "m", F.row_number().over(place).alias("at"))
    n, share = F.col("x.n"), 2 * similarity / (1 + similarity)
    rows = cut(rows.where((F.col("m") > 1) & (F.col("at") <= n - F.ceil(similarity * n - 1e-6) + 1)), "rare-shingles")
    p, q = rows.where(F.col("at") <= n - F.ceil(share * n - 1e-6) + 1).alias("p"), rows.alias("q")
    common = (F.col("p.x.n") + F.col("q.x.n")) * similarity / (1 + similarity) - 1e-6
    left = 1 + F.least(F.col("p.x.n") - F.col("p.at"), F.col("q.x.n") - F.col("q.at"))
    smaller = F.struct("p.x.n", "p.x.d") < F.struct("q.x.n", "q.x.d")
    met = p.join(q, (F.col("p.h") == F.col("q.h")) & smaller & (F.col("p.c") != F.col("q.c")) & (left >= common))
    return met.select(F.least("p.x", "q.x").alias("u"), F.greatest("p.x", "q.x").alias("v")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``id, component_id`` of every row (``id_col`` has to be unique, see ``keyed``): rows link at the similarity or above.

    Equal sets are one class whatever their number. Classes whose SimHash fingerprints are near share
    a key (a band, see ``print_groups``) and are candidates. Each
    round compares all classes of a band with one pivot: the one that shares most bands with others,
    which is the middle of a group of near copies; then with the next one outside the components
    found. Classes of bands that ROUNDS rounds left in different components are compared where they meet
    in one of their rare shingles (see ``_by_rare``), which loses none; so no group is ever compared in
    all its pairs. Candidates are compared by their whole sets.
    """
    schema = T.StructType([T.StructField("k", docs.schema[id_col].dataType), T.StructField("d", T.LongType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("p", "low"))])
    base = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def mark(ids, texts):
        sets = [shingle_set(t.as_py(), shingle) for t in texts]
        yield {"k": ids, "d": [_digest(s) for s in sets], "n": [len(s) for s in sets], "p": [set_print(s).view(np.int64) for s in sets], "low": [tiny_keys(s, similarity) for s in sets]}

    rows = cut(map_batches(base, ["k", "t"], schema, mark), "shingle-rows")
    classes = cut(rows.groupBy("d").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("low").alias("low")), "shingle-classes")
    found = print_groups(classes.where("n > 0").select("d", "p"), similarity).unionByName(classes.select("d", F.explode("low").alias("key")))
    keys = cut(found.withColumnRenamed("d", "kd"), "print-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumnRenamed("key", "bk")
    keys = keys.join(shared, F.col("key") == F.col("bk")).drop("bk")
    bands = cut(classes.join(keys, F.col("d") == F.col("kd")).select(F.struct("k", "d", "n").alias("x"), "key", "m"), "shingle-bands")
    ranks = bands.groupBy(F.col("x.d").alias("wd")).agg(F.sum("m").alias("w"))
    bands = cut(bands.drop("m").join(ranks, F.col("x.d") == F.col("wd")).drop("wd"), "ranked-bands")
    held = cut(bands.select(F.col("x.k").alias("hk"), F.col("x.d").alias("hd")).distinct(), "band-classes")
    test = id_filter(held, "hk")

    def whole(ids, texts):
        sets = [shingle_set(t.as_py(), shingle) for t in texts]
        yield {"d": [_digest(s) for s in sets], "s": [s.view(np.int64) for s in sets]}

    form = T.StructType([T.StructField("d", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])
    near = base.where(test("k")).join(held.select("hk").distinct(), F.col("k") == F.col("hk"), "left_semi")
    sets = cut(map_batches(near, ["k", "t"], form, whole).dropDuplicates(["d"]).withColumnRenamed("d", "sd"), "shingle-sets")

    edges, part = None, bands.withColumn("c", F.col("x.d"))
    for _ in range(ROUNDS):
        # the pivot of a band leads the component with the highest rank that has not led yet
        pivot = part.groupBy("key").agg(F.max(F.struct("w", "x", "c")).alias("p")).select(F.col("key").alias("pk"), "p")
        pairs = part.join(pivot, F.col("key") == F.col("pk")).where(F.col("c") != F.col("p.c"))
        found = _similar(pairs.select(F.least("x", "p.x").alias("u"), F.greatest("x", "p.x").alias("v")), sets, similarity)
        edges = cut(found if edges is None else edges.unionByName(found), "similar-edges")
        # components of classes, not of ids: rows that share an id may hold unlike texts
        comp = cut(components(edges.select(F.col("u.d").alias("u"), F.col("v.d").alias("v"))).toDF("cd", "c"), "similar-components")
        part = part.drop("c").join(pivot.select("pk", F.col("p.x.d").alias("pd")), F.col("key") == F.col("pk")).drop("pk")
        part = part.join(comp, F.col("x.d") == F.col("cd"), "left").withColumn("c", F.coalesce("c", "x.d")).drop("cd")
        part = cut(part.withColumn("w", F.when(F.col("x.d") == F.col("pd"), F.lit(-1).cast("long")).otherwise(F.col("w"))).drop("pd"), "band-parts")
        mixed = part.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.max("w").alias("top")).where("a <> b and top >= 0").select(F.col("key").alias("mk"))
        part = cut(part.join(mixed, F.col("key") == F.col("mk"), "left_semi"), "mixed-bands")
        if part.isEmpty():
            break
    part = cut(part.where("w >= 0").select("x", "c").distinct(), "mixed-classes")
    edges = edges.unionByName(_similar(_by_rare(part, sets, similarity), sets, similarity))
    # the smallest row of a class stands for it, so components are named by rows without another grouping
    linked = cut(components(edges.select(F.col("u.k").alias("u"), F.col("v.k").alias("v"))).toDF("n", "c"), "similar-classes")
    named = classes.select(F.col("d").alias("nd"), "k").join(linked, F.col("k") == F.col("n"), "left").select("nd", F.coalesce("c", "k").alias("component_id"))
    return rows.join(named, F.col("d") == F.col("nd")).select(F.col("k").alias(id_col), "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that are the first of their group of near copies; all columns stay.

    The first is the one with the smallest id. Rows that share an id, or have none, are documents of
    their own: behind one another, those without an id behind all others. Texts without a word are
    like one another. An empty table stays empty.
    """
    rows = keyed(docs, id_col)
    got = near_copies(rows, KEY, text_col, shingle, similarity)
    return without_keys(rows, got.where(F.col(KEY) > F.col("component_id")).select(KEY))
