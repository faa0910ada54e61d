"""SimHash fingerprints and their exact near pairs through vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import KEY, cut, field_of, keyed, map_batches, without_keys
from corrigenda.llm.components import components

SEED = 42
#: Fingerprints a shard is meant to hold, the most shards of a tree, and fingerprints drawn per
#: shard to place the vantage points (so at most MAX_SHARDS * PER_SHARD, 2 MB, reach the driver).
SHARD_ROWS, MAX_SHARDS, PER_SHARD = 8_192, 8_192, 32
#: A shard above this many rows is dealt to several tasks, rows against rows.
TASK_ROWS = 131_072
#: Inside a task, a tree of its own parts the shard down to leaves of about so many rows.
LEAF_ROWS = 512

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), "<u8")
    return int.from_bytes(majority(h).tobytes(), "little")


def majority(h: np.ndarray) -> np.ndarray:
    """The bits (packed bytes) that are set in over half the rows of ``h`` (hashes, one or more words each)."""
    bits = h.view(np.uint8).reshape(len(h), -1)
    ones = np.zeros(8 * bits.shape[1], np.int64)
    for lo in range(0, len(h), 65_536):
        ones += np.unpackbits(bits[lo : lo + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) of every row, in one pass over whole texts."""
    schema = T.StructType([field_of(docs, id_col), T.StructField("fp", T.LongType())])

    def run(ids, texts):
        got = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), "<u8", len(texts))
        yield {id_col: ids, "fp": pa.array(got.view(np.int64))}

    return map_batches(docs, [id_col, text_col], schema, run)


class VantageTree:
    """A vantage-point tree over one half of the bits; leaves are shards.

    A node holds a vantage fingerprint and a radius: rows within the radius go inside, others
    outside. Two fingerprints within r differ by at most r in their distances to the vantage, so a
    query skips a side only if the triangle bound excludes its whole ball from it.
    """

    def __init__(self, sample: np.ndarray, leaves: int, rng: np.random.Generator):
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, inside, outside (leaf: ~leaf)
        self.share: list[float] = []  # of the sample in each leaf
        least = max(1, len(sample) // max(1, leaves))
        self.root = self._grow(sample, least, max(1, len(sample)), rng)

    def _grow(self, s: np.ndarray, least: int, n: int, rng: np.random.Generator) -> int:
        if len(s) > least:
            best = None
            for v in rng.choice(s, min(4, len(s)), replace=False):  # the vantage that leaves fewest rows near its border
                d = np.bitwise_count(s ^ v)
                for r in {int(np.median(d)), int(np.median(d)) - 1}:
                    inside = int((d <= r).sum())
                    if 0 < inside < len(s):
                        cost = int((np.abs(d.astype(int) - r) <= 1).sum()) + abs(2 * inside - len(s)) // 2
                        if best is None or cost < best[0]:
                            best = (cost, int(v), r, d <= r)
            if best is not None:
                at = len(self.nodes)
                self.nodes.append((best[1], best[2], 0, 0))
                kids = (self._grow(s[best[3]], least, n, rng), self._grow(s[~best[3]], least, n, rng))
                self.nodes[at] = (best[1], best[2], *kids)
                return at
        self.share.append(len(s) / n)
        return ~(len(self.share) - 1)

    def route(self, half: np.ndarray, r: int):
        """Yields (leaf, rows that live there, rows whose ball of radius r reaches it from elsewhere)."""
        todo = [(self.root, np.arange(len(half)), np.ones(len(half), bool))]
        while todo:
            at, rows, home = todo.pop()
            if at < 0:
                yield ~at, rows[home], rows[~home]
                continue
            v, radius, inside, outside = self.nodes[at]
            d = np.bitwise_count(half[rows] ^ half.dtype.type(v)).astype(np.int16)
            near = d <= radius
            for kid, mine, reach in ((inside, near, d - r <= radius), (outside, ~near, d + r > radius)):
                if reach.any():
                    todo.append((kid, rows[reach], (home & mine)[reach]))


def _near_in_shard(fps: np.ndarray, half: np.ndarray, home: np.ndarray, distance: int, radius: int, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """Row -> smallest row of its component, from the pairs (a home row, any row) of a shard within the distance.

    A tree over the home rows' halves parts them into leaves; every row is searched in the leaves
    that its ball of ``radius`` reaches, and compared there on all 64 bits.
    """
    root, own = np.arange(len(fps)), np.flatnonzero(home)
    if not len(own):
        return root
    rng = np.random.default_rng(len(own))
    tree = VantageTree(half[own] if len(own) <= 1 << 17 else half[rng.choice(own, 1 << 17, replace=False)], max(1, len(own) // leaf_rows), rng)
    living = {leaf: own[mine] for leaf, mine, _ in tree.route(half[own], 0)}
    for leaf, mine, others in tree.route(half, radius):
        at, rows = living.get(leaf, own[:0]), np.concatenate([mine, others])
        if len(at):
            _link(root, fps, rows, at, distance)
    return root


def _link(root: np.ndarray, fps: np.ndarray, rows: np.ndarray, at: np.ndarray, distance: int) -> None:
    """Joins in ``root`` all pairs of a row of ``rows`` and one of ``at`` within the distance, in blocks."""
    block = max(1, (1 << 18) // len(at))
    for lo in range(0, len(rows), block):
        i, j = np.nonzero(np.bitwise_count(fps[rows[lo : lo + block], None] ^ fps[None, at]) <= distance)
        i, j = rows[lo + i], at[j]
        while True:
            a, b = root[i], root[j]
            live = a != b
            if not live.any():
                break
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tolist() != root.tolist():
                root[:] = up


def near_edges(nodes: DataFrame, distance: int = 3, node_col: str = "node", fp_col: str = "fp", seed: int = SEED) -> DataFrame:
    """``u, v``: edges whose components are those of all pairs of ``nodes`` within ``distance`` bits.

    ``nodes`` has one row per distinct fingerprint. Of two fingerprints within d bits, one of the
    two 32-bit halves differs by at most d // 2: a tree over each half is searched with that small
    radius. Rows are shuffled to the shards their balls reach; a shard compares those that live
    there with all that reach it on the full 64 bits and gives one edge per row to the smallest of
    its component, never all pairs of a group. Shards expected to be large (a crowd of near copies)
    are dealt to several tasks. Only a bounded sample of fingerprints, which places the vantage
    points, is gathered; every row is indexed and the search is exact.
    """
    n = nodes.count()
    leaves = max(1, min(MAX_SHARDS, n // SHARD_ROWS))
    part = min(1.0, 1.2 * leaves * PER_SHARD / max(1, n))
    drawn = nodes.where(F.abs(F.xxhash64(fp_col, F.lit(seed)) % 1_000_003) <= part * 1_000_003).select(fp_col).limit(2 * MAX_SHARDS * PER_SHARD).toPandas()
    sample = np.sort(drawn[fp_col].to_numpy(np.int64)).view(np.uint64)
    rng = np.random.default_rng(seed)
    low, high = (sample & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sample >> np.uint64(32)).astype(np.uint32)
    trees = [VantageTree(x, leaves, rng) for x in (low, high)]
    radius = distance // 2
    deal = [[max(1, round(share * n / TASK_ROWS)) for share in t.share] for t in trees]

    schema = T.StructType([
        T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.IntegerType()), T.StructField("deal", T.IntegerType()),
        T.StructField("home", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()),
    ])

    def place(ids, prints):
        node, fp = np.asarray(ids).astype(np.int64), np.asarray(prints).astype(np.int64)
        bits = fp.view(np.uint64)
        for k, half in enumerate(((bits & np.uint64(0xFFFFFFFF)).astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32))):
            for leaf, mine, others in trees[k].route(half, radius):
                m = deal[k][leaf]
                # m groups of rows that live there times m groups of rows that reach it
                own = (mine if m == 1 else np.repeat(mine, m), np.zeros(len(mine), int) if m == 1 else np.add.outer(bits[mine] % np.uint64(m) * np.uint64(m), np.arange(m, dtype=np.uint64)).ravel().astype(int), True)
                reach = others if m == 1 else np.concatenate([mine, others])
                far = (np.repeat(reach, m), np.add.outer(bits[reach] // np.uint64(m) % np.uint64(m), np.arange(m, dtype=np.uint64) * np.uint64(m)).ravel().astype(int), False)
                for rows, cell, home in (own, far):
                    if len(rows):
                        yield {"tree": np.full(len(rows), k), "leaf": np.full(len(rows), leaf), "deal": cell, "home": np.full(len(rows), home), "node": node[rows], "fp": fp[rows]}

    placed = map_batches(nodes.select(F.col(node_col).cast("long").alias("node"), F.col(fp_col).alias("fp")), ["node", "fp"], schema, place)

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values("node", kind="stable")
        node = pdf["node"].to_numpy()
        bits = pdf["fp"].to_numpy().view(np.uint64)
        half = ((bits >> np.uint64(32 * int(pdf["tree"].iloc[0]))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        root = _near_in_shard(bits, half, pdf["home"].to_numpy(), distance, radius)
        live = node[root] != node
        return pd.DataFrame({"u": node[live], "v": node[root][live]})

    return placed.groupBy("tree", "leaf", "deal").applyInPandas(join, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """``id, fp, component_id`` of every row; fingerprints link at ``distance`` or fewer bits.

    component_id is the smallest id reachable. Null or wordless texts have fingerprint zero and link
    like any other. Equal fingerprints form one node whatever their number, so copies are never
    paired. Repeated ids keep their rows. A row with a null id gets the component of its
    fingerprint, or null if no row with an id is reachable.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min(id_col).cast("long").alias("node")).where("node is not null"), "fp-nodes")
    comp = components(near_edges(nodes, distance))
    named = nodes.join(comp.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        F.col("fp").alias("nfp"), F.coalesce("component", "node").alias("component_id")
    )
    return rows.join(named, F.col("fp") == F.col("nfp"), "left").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """Rows of ``docs`` that are the first of their group; all columns stay.

    The first is the one with the smallest id. Rows that share an id, or have none, are documents of
    their own: behind one another, those without an id behind all others.
    """
    rows = keyed(docs, id_col)
    marks = cut(fingerprints(rows, KEY, text_col, shingle), "fingerprints")
    nodes = cut(marks.groupBy("fp").agg(F.min(KEY).alias("low")), "fp-nodes")
    linked = components(near_edges(nodes, distance, "fp")).toDF("n", "c")
    of = cut(nodes.join(linked, F.col("fp") == F.col("n"), "left").select("fp", "low", F.coalesce("c", "fp").alias("c")), "fp-groups")
    first = of.groupBy("c").agg(F.min("low").alias("first")).withColumnRenamed("c", "fc")
    named = of.join(first, F.col("c") == F.col("fc")).select(F.col("fp").alias("nfp"), "first")
    return without_keys(rows, marks.join(named, F.col("fp") == F.col("nfp")).where(F.col(KEY) > F.col("first")).select(KEY))
