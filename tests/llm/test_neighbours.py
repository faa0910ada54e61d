"""Nearest neighbours against brute force; what takes part and how ties are ordered."""

import numpy as np

from corrigenda.llm import neighbours, queries

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score string"


def exact(ids, vecs, q, k=5):
    x = np.asarray(vecs, np.float64)
    sim = (x @ x[q]) / (np.sqrt((x * x).sum(1)) * np.sqrt(x[q] @ x[q]))
    order = [i for i in np.lexsort((ids, -sim)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(sim[i])) for i in order]


def by_query(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_in_many_buckets(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 24))
    vecs = (centres[rng.integers(0, 12, 3000)] + 0.7 * rng.standard_normal((3000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x", "y") for i, v in enumerate(vecs)], SCHEMA)
    rows = neighbours.usable(df, "vec_id", "embedding")
    nodes = neighbours.nodes_of(rows, 6).select("node", neighbours._packed("vec").alias("vec"))
    nodes = neighbours.cut(nodes, "nodes")
    graph = neighbours.build_graph(nodes, k=16, trees=2, bucket=64)
    lists = {r.node: r.nbrs for r in graph.collect()}
    assert len(lists) == 3000 and all(len(x) == 16 for x in lists.values())
    truth = {q: {i for i, _ in exact(np.arange(3000), vecs, q)} for q in range(0, 3000, 50)}
    assert sum(len(truth[q] & set(lists[q])) for q in truth) / 300 > 0.9
    # queries that are no rows of the table start from the same few nodes
    own = spark.createDataFrame([(-1 - q, neighbours._packed.func(__import__("pandas").Series([vecs[q]]))[0]) for q in truth], "query bigint, qvec binary")
    found = {r.query: r.best for r in neighbours.search_graph(nodes, graph, own).collect()}
    assert sum(len((truth[q] | {q}) & set(found[-1 - q][:6])) for q in truth) / 360 > 0.9


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = by_query(queries.op11_nn_descent(spark, sf).collect())
    ids = table["vec_id"].to_numpy()
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        want = exact(ids, np.stack(table["embedding"].to_list()), q)
        hits += len({i for i, _ in want} & {i for i, _ in got[ids[q]]})
    assert len(got) == (ids % 50 == 0).sum() and hits / (5 * len(got)) > 0.9


def test_copies_ties_and_rows_that_take_no_part(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(400)] + [(50, same)] * 3  # a vector of very many rows, a row that repeats
    rows += [(1000, [0.0, 1.0, 0.0]), (1001, [0.0, 1.0, 0.1]), (1002, [0.0, -1.0, 0.0])]
    rows += [(1050, None), (1100, [0.0, 0.0, 0.0]), (1150, [1.0, None, 1.0]), (1200, [float("nan"), 1.0, 1.0]), (1250, [1.0, float("inf"), 1.0]), (1300, [1.0]), (None, same), (1350, [])]
    got = by_query(neighbours.nearest(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect())
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 350, 1000}
    for q in got:
        if q < 400:
            assert [i for i, _ in got[q]] == [i for i in range(7) if i != q][:5] and all(abs(s - 1) < 1e-12 for _, s in got[q])
    assert [i for i, _ in got[1000]] == [1001, 0, 1, 2, 3]


def test_few_rows_and_none(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0], "", "")], SCHEMA)).count() == 0
    got = by_query(neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0], "", ""), (7, [1.0, 1.0], "", "")], SCHEMA)).collect())
    assert list(got) == [0] and got[0][0][0] == 7 and abs(got[0][0][1] - 0.5**0.5) < 1e-12
