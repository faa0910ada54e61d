"""Approximate nearest neighbours by cosine: NN-descent builds a graph, greedy search walks it.

Equal vectors are one node of the graph, named by the smallest id that has it. Nodes travel as
16-bit components of the unit vector; only the last ranking reads the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import cut, discard, scratch

#: Neighbours of a node in the graph.
K = 48
#: Random-projection partitions from which the first lists come, and the nodes of one bucket.
TREES, BUCKET = 4, 1024
#: Members of a node's local join that meet at a time; larger groups are parted by a hash.
GROUP = 256
#: Rounds of NN-descent; fewer where less than SETTLED of all entries are new.
ROUNDS, SETTLED = 4, 0.05
#: Best nodes a query keeps, and how many of them it expands at a time.
BEAM, EXPAND = 48, 16
#: Nodes whose projections set the borders of buckets.
SAMPLE = 4096
#: Rows of a side that may be broadcast (three longs each).
SMALL = 100_000
SCALE = 32767.0
LISTS = "node bigint, nbrs array<bigint>, sims array<float>, fresh array<boolean>"


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.float32) / np.float32(SCALE)


def _stack(col: pa.Array) -> np.ndarray:
    """The vectors of a column (or list) of binaries, one a row."""
    if isinstance(col, list):
        return np.frombuffer(b"".join(col), np.int16).reshape(len(col), -1)
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.int16, (ends[-1] - ends[0]) // 2, ends[0]).reshape(len(a), -1)


@F.pandas_udf(T.BinaryType())
def _packed(x: pd.Series) -> pd.Series:
    def one(v):
        v = np.asarray(v, np.float64)
        v = v / np.abs(v).max()
        return np.rint(v / np.sqrt(v @ v) * SCALE).astype(np.int16).tobytes()

    return x.map(one)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part: an id, and a vector of finite numbers that is not zero.

    Vectors whose length is not the most frequent one (of several, the largest) take no part either.
    """
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = x.where("id is not null and vec is not null").where(~bad & F.exists("vec", lambda v: v != 0))
    top = x.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("vec") == (top.d if top else 0))


def nodes_of(rows: DataFrame, copies: int) -> DataFrame:
    """``node, vec, ids`` for each different vector of ``rows(id, vec)``: its smallest ``copies`` ids, the first of which names it.

    Rows are first thinned inside each task, so that a vector of very many rows sends few.
    """
    schema = T.StructType([T.StructField("vec", rows.schema["vec"].dataType), T.StructField("id", T.LongType())])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, list] = {}
            flat, ids = b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            wide = flat.reshape(len(ids), -1)
            for i in np.argsort(ids, kind="stable").tolist():
                had = seen.setdefault(wide[i].tobytes(), [])
                if len(had) < copies and (not had or ids[had[-1]] != ids[i]):
                    had.append(i)
            yield b.take(pa.array(sorted(i for had in seen.values() for i in had)))

    some = rows.select("vec", "id").mapInArrow(thin, schema)
    part = some.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("p")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, copies).alias("ids"))
    whole = part.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, copies).alias("ids"))
    # an id with several vectors would name several nodes: the name is then told apart by the vector
    named = whole.select(F.element_at("ids", 1).alias("id1"), "vec", "ids")
    twice = named.groupBy("id1").count().where("count > 1").select("id1", F.lit(True).alias("again"))
    named = named.join(twice, "id1", "left")
    node = F.when(F.col("again"), F.xxhash64("id1", "vec")).otherwise(F.col("id1"))
    return named.select(node.alias("node"), "vec", "ids")


def _parted(df: DataFrame, keys: list[str], by: str, most: int, label: str) -> DataFrame:
    """``df`` with ``part``: rows of a key that has more than ``most`` of them are dealt to parts of about that many by a hash of ``by``."""
    large = cut(df.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).alias("parts")), label)
    side = F.broadcast(large) if large.count() <= SMALL else large
    return df.join(side, keys, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), "parts"))).drop("parts")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of about ``rows`` rows that end where a key ends, with the borders of the keys in them.

    A key of more than four times as many rows is cut in pieces.
    """
    held: list[pa.RecordBatch] = []
    have = 0

    def borders(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in range(n_keys):
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        have += b.num_rows
        if have >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            edge = borders(t)
            at = edge[-2] if edge[-2] else (have if have > 4 * rows else 0)
            if at:
                yield t.slice(0, at), edge[: len(edge) - (at != have)]
                held, have = (t.slice(at).to_batches() if at < have else []), have - at
    if have:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, borders(t)


def _arrays(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _best(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest of each node, known entries before fresh ones of the same neighbour; ties to the smaller neighbour."""
    o = np.lexsort((fresh, nbr, node))
    node, nbr, sim, fresh = node[o], nbr[o], sim[o], fresh[o]
    keep = np.ones(len(node), bool)
    keep[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
    node, nbr, sim, fresh = node[keep], nbr[keep], sim[keep], fresh[keep]
    o = np.lexsort((nbr, -sim, node))
    node, nbr, sim, fresh = node[o], nbr[o], sim[o], fresh[o]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(node)))
    keep = np.arange(len(node)) - np.repeat(first, size) < k
    return node[keep], nbr[keep], sim[keep], fresh[keep]


def _as_lists(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    starts = np.append(first, len(node))
    return pa.RecordBatch.from_arrays(
        [pa.array(node[first], pa.int64()), _arrays(starts, nbr, pa.int64()), _arrays(starts, sim, pa.float32()), _arrays(starts, fresh, pa.bool_())],
        names=["node", "nbrs", "sims", "fresh"],
    )


def _from_lists(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    cols = [t.column(n).combine_chunks() if isinstance(t, pa.Table) else t.column(n) for n in ("node", "nbrs", "sims", "fresh")]
    lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
    size = np.diff(lists[1].offsets.to_numpy())
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists[1:]]
    return np.repeat(lists[0].to_numpy(), size), flat[0], flat[1], flat[2].astype(bool)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the ``k`` nearest for each node from any number of lists (LISTS)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[np.ndarray, ...] | None = None
        for t, _ in _runs(batches, 1, 8_000):
            now = _from_lists(t)
            if left is not None:
                now = tuple(np.concatenate(x) for x in zip(left, now))
            now = _best(*now, k)
            last = now[0] == now[0][-1]  # its rows may go on in the next table
            left = tuple(x[last] for x in now)
            if not last.all():
                yield _as_lists(*(x[~last] for x in now))
        if left is not None:
            yield _as_lists(*left)

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(merge, LISTS)


class _Pairs:
    """Pairs of nodes found in a task; of each node only the ``k`` nearest leave it."""

    def __init__(self, k: int) -> None:
        self.k, self.kept, self.n = k, [], 0

    def add(self, node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> None:
        self.kept.append((node, nbr, sim, np.ones(len(node), bool)))
        self.n += len(node)
        if self.n > 2_000_000:
            self.kept = [_best(*(np.concatenate(x) for x in zip(*self.kept)), self.k)]
            self.n = len(self.kept[0][0])

    def lists(self, at_least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.n > at_least:
            node, nbr, sim, fresh = _best(*(np.concatenate(x) for x in zip(*self.kept)), self.k)
            for lo in range(0, len(node), 1 << 18):
                yield _as_lists(*(x[lo : lo + (1 << 18)] for x in (node, nbr, sim, fresh)))
            self.kept, self.n = [], 0


def first_lists(nodes: DataFrame, k: int, trees: int, bucket: int, seed: int = 7) -> DataFrame:
    """Lists (LISTS) from buckets of random projections: each node's nearest among about ``bucket`` nodes on the same sides of random planes.

    The borders are medians over a sample of SAMPLE nodes; the number of planes follows the number of nodes.
    """
    n = nodes.count()
    probe = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").toPandas()["vec"]
    if not len(probe):
        return nodes.sparkSession.createDataFrame([], LISTS)
    seen = _unit(_stack(probe.tolist()))
    planes = int(np.ceil(np.log2(max(1, n / bucket))))
    turn = np.random.default_rng(seed).standard_normal((seen.shape[1], trees * planes)).astype(np.float32)
    middle = np.median(seen @ turn, axis=0)

    @F.pandas_udf("array<bigint>")
    def sides(v: pd.Series) -> pd.Series:
        bits = (_unit(_stack(v.tolist())) @ turn > middle).reshape(len(v), trees, planes)
        return pd.Series(list((bits * (1 << np.arange(planes, dtype=np.int64))).sum(2)))

    dealt = nodes.select("node", "vec", F.posexplode(sides("vec")).alias("tree", "side"))
    dealt = _parted(dealt, ["tree", "side"], "node", 2 * bucket, "large-buckets")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Pairs(k)
        for t, edge in _runs(batches, 3, 4 * bucket):
            ids, vec = t.column("node").to_numpy(), _unit(_stack(t.column("vec")))
            for lo, hi in zip(edge, edge[1:]):
                for at in range(lo, hi, 512):
                    sim = vec[at : min(hi, at + 512)] @ vec[lo:hi].T
                    own = np.arange(len(sim))
                    sim[own, own + at - lo] = -9
                    m = min(k, hi - lo - 1)
                    if m > 0:
                        best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                        found.add(np.repeat(ids[at : at + len(sim)], m), ids[lo:hi][best].ravel(), np.take_along_axis(sim, best, 1).ravel())
            yield from found.lists(1_000_000)
        yield from found.lists()

    keys = ["tree", "side", "part"]
    return _merged(dealt.select(*keys, "node", "vec").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(near, LISTS), k)


def descend(nodes: DataFrame, graph: DataFrame, k: int, label: str = "members") -> DataFrame:
    """One round of NN-descent: at every node its neighbours, and those whose neighbour it is, are compared with one another.

    Pairs of which neither entry is fresh have met before. Vectors are fetched once for each member of a
    node's group; a group above GROUP members is parted, each part meets by itself.
    """
    edges = graph.select("node", F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.fresh").alias("fresh"))
    out = edges.select(F.col("node").alias("g"), F.col("nbr").alias("m"), "fresh")
    back = edges.select(F.col("nbr").alias("g"), F.col("node").alias("m"), "fresh")
    met = out.unionByName(back).repartition("m").groupBy("m", "g").agg(F.max("fresh").alias("fresh"))
    bar = F.when(F.size("sims") >= k, F.array_min("sims")).otherwise(F.lit(-9.0)).cast("float")
    has = nodes.join(graph.select("node", bar.alias("bar")), "node").select(F.col("node").alias("m"), "vec", "bar")
    indegree = edges.groupBy(F.col("nbr").alias("g")).count().where(F.col("count") > GROUP - k).select("g", F.ceil((F.col("count") + k) / GROUP).alias("parts"))
    large = cut(indegree, "large-groups")
    side = F.broadcast(large) if large.count() <= SMALL else large
    rows = met.join(side, "g", "left").join(has, "m")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("m"), "parts"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Pairs(k)
        for t, edge in _runs(batches, 2, 16_384):
            m, fresh, bars = (t.column(n).to_numpy() for n in ("m", "fresh", "bar"))
            vec = _unit(_stack(t.column("vec")))
            for lo, hi in ((a, min(z, a + 2 * GROUP)) for x, z in zip(edge, edge[1:]) for a in range(x, z, 2 * GROUP)):
                new = fresh[lo:hi]
                if not new.any():
                    continue
                sim = vec[lo:hi] @ vec[lo:hi].T
                ok = (new[:, None] | new[None, :]) & (sim > bars[lo:hi][:, None])
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                found.add(m[lo:hi][i], m[lo:hi][j], sim[i, j])
        yield from found.lists()

    members = rows.select("g", part.alias("part"), "m", "fresh", "bar", "vec").repartition("g", "part").sortWithinPartitions("g", "part")
    old = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
    return _merged(old.unionByName(members.mapInArrow(meet, LISTS)), k)


def build_graph(nodes: DataFrame, k: int = K, trees: int = TREES, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph (LISTS) of ``nodes(node, vec)`` with 16-bit unit vectors: buckets of random projections, then NN-descent."""
    graph = cut(first_lists(nodes, k, trees, bucket), "graph")
    for _ in range(rounds):
        fresh, entries = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if not entries or fresh < SETTLED * entries:
            break
        before, graph = graph, cut(descend(nodes, graph, k), "graph")
        discard(before)
    return graph


STATE = "query bigint, qvec binary, best array<bigint>, sims array<float>, done array<boolean>, seen array<bigint>, ask array<bigint>, want string"


def _advance(beam: int, expand: int) -> Callable:
    """What a query does with the rows it has asked for: vectors are ranked, lists of expanded nodes name the vectors to ask for next."""

    def step(key, state: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        s = state.iloc[0]
        best, seen = np.asarray(s["best"], np.int64), np.asarray(s["seen"], np.int64)
        sims, done = np.asarray(s["sims"], np.float32), np.asarray(s["done"], bool)
        if s["want"] == "vectors":
            q = _unit(np.frombuffer(s["qvec"], np.int16))
            if len(got):
                ids = got["node"].to_numpy()
                sim = _unit(_stack(got["vec"].tolist())) @ q
                best, sims, done = np.append(best, ids), np.append(sims, sim), np.append(done, np.zeros(len(ids), bool))
                o = np.lexsort((best, -sims))[:beam]
                best, sims, done = best[o], sims[o], done[o]
            want = "lists"
        else:
            near = np.unique(np.concatenate([np.asarray(x, np.int64) for x in got["nbrs"]])) if len(got) else np.zeros(0, np.int64)
            ask = np.setdiff1d(near, seen)
            seen, want = np.append(seen, ask), "vectors" if len(ask) else "lists"
        if want == "lists":
            at = np.flatnonzero(~done)[:expand]
            done[at] = True
            ask = best[at]
            seen = seen[:0] if not len(ask) else seen  # the query has ended
        one = (key[0], s["qvec"], best.astype(np.int64), sims.astype(np.float32), done.astype(bool), seen, ask.astype(np.int64), want)
        return pd.DataFrame([one], columns=["query", "qvec", "best", "sims", "done", "seen", "ask", "want"])

    return step


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, starts: int = 32, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """``query, best array<bigint>``: the nodes that greedy search finds for each of ``queries(query, qvec)``, nearest first.

    A query starts from the list of the node it equals, if there is one (``query`` is that node's name), else from
    ``starts`` nodes that are the same for all such queries. It expands its best nodes until each of the ``beam`` best has been
    expanded. Every hop is two joins: lists of the expanded nodes, then vectors of what they name.
    """
    from_all = [r.node for r in nodes.select("node").orderBy(F.xxhash64("node", F.lit(1))).limit(starts).collect()]
    start = F.array(*[F.lit(x) for x in from_all]) if from_all else F.expr("cast(array() as array<bigint>)")
    own = queries.join(graph.select(F.col("node").alias("query"), "nbrs"), "query", "left")
    ask = F.coalesce(F.array_union(F.array("query"), F.col("nbrs")), start)
    none = F.expr("cast(array() as array<bigint>)")
    state = own.select("query", "qvec", none.alias("best"), F.expr("cast(array() as array<float>)").alias("sims"), F.expr("cast(array() as array<boolean>)").alias("done"), ask.alias("seen"), ask.alias("ask"), F.lit("vectors").alias("want"))
    state, fetch = cut(state, "search"), nodes.select("node", "vec")
    while not (rest := state.where("size(ask) > 0")).isEmpty():
        asked = rest.select(F.col("query").alias("q"), "want", F.explode("ask").alias("node"))
        got = asked.where("want = 'vectors'").join(fetch, "node").select("q", "node", "vec", F.lit(None).cast("array<bigint>").alias("nbrs"))
        got = got.unionByName(asked.where("want = 'lists'").join(graph.select("node", "nbrs"), "node").select("q", "node", F.lit(None).cast("binary").alias("vec"), "nbrs"))
        now = rest.groupBy("query").cogroup(got.groupBy("q")).applyInPandas(_advance(beam, expand), STATE)
        before, state = state, cut(now.unionByName(state.where("size(ask) = 0")), "search")
        discard(before)
    return state.select("query", "best")


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Score: cosine in double precision on the original vectors; ties to the smaller id; a row is no candidate
    of its own. Rows without an id, and vectors that are null, zero, of another length than most, or hold null
    or non-finite components take no part. Rows that share id and vector count once; rows that share an id only
    are candidates each, but not of that id's queries; such an id, if divisible, asks with each of its vectors,
    the nearest of which count. Further columns are ignored; an empty table gives an empty one.
    """
    rows = usable(df, id_col, vec_col)
    with scratch(df.sparkSession) as written:
        nodes = cut(nodes_of(rows, k + 1).withColumn("code", _packed("vec")), "nodes")
        coded = nodes.select("node", F.col("code").alias("vec"))
        graph = build_graph(coded)
        asks = rows.where(F.col("id") % every == 0).select("id", "vec").distinct()
        asks = cut(asks.join(nodes.select("node", "vec"), "vec").select(F.col("id").alias("query_id"), F.col("node").alias("query")), "asks")
        queries = asks.select("query").distinct().join(coded.select(F.col("node").alias("query"), F.col("vec").alias("qvec")), "query")
        found = search_graph(coded, graph, queries)
        pairs = found.select("query", F.explode(F.slice("best", 1, max(BEAM // 2, 2 * k + 2))).alias("node"))
        pairs = pairs.join(nodes.select("node", "vec", "ids"), "node").join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("qvec")), "query")
        pairs = pairs.select("query", "ids", _cosine("qvec", "vec").alias("score"))
        each = asks.join(pairs, "query").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
        each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        top = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))), 1, k).alias("top"))
        out = top.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.d")).alias("score"))
        out = cut(out, "nearest")
        written.pop()
    return out


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = np.stack(a.to_list()).astype(np.float64), np.stack(b.to_list()).astype(np.float64)
    dot = np.einsum("ij,ij->i", x, y)
    return pd.Series(dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))))
