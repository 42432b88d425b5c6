import numpy as np
import pytest

from webloom.llm import graphs


def brute(rows, query, k):
    own = np.array(query[1], float)
    found = sorted((float(np.sqrt(np.square(np.array(v, float) - own).sum())), i) for i, v in rows if i != query[0] and len(v) == len(own))
    return found[:k]


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1100] = x[3]  # a crowd of copies
    rows = [(int(i), v.tolist(), "clash") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, raw string").repartition(5)
    queries = graphs.usable(df, "vec_id", "embedding").filter("vec_id % 100 = 0")
    got = graphs.search(graphs.index(df, shard_size=300), queries).collect()
    hits = total = 0
    plain = [(i, v) for i, v, _ in rows]
    for q in range(0, 1500, 100):
        want = brute(plain, (q, x[q]), 10)
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(np.square(x[i].astype(float) - x[q]).sum())) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i in want} & {i for _, i, _ in mine})
        total += len(want)
        if q in (700, 800, 900, 1000):  # all at distance 0: the smallest ids, without the query's
            assert [i for _, i, _ in mine] == [3, *[i for i in range(700, 711) if i != q]][:10]
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = graphs.usable(df, "vec_id", "embedding").filter("vec_id % 100 = 0")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in graphs.search(graphs.index(df), queries).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.0), (0, 2, 7, 1.0), (100, 1, 0, 0.0), (100, 2, 7, 1.0)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert graphs.search(graphs.index(df), graphs.usable(df, "vec_id", "embedding")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30])
def test_small_graphs_find_all(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    found, _ = graphs.build(x).search(x[:1], 48)
    assert set(found[0][found[0] >= 0]) == set(range(n))


def test_pruning_keeps_diverse_edges():
    # the second candidate is nearer to the first than to the node, the third is not
    d, among = np.array([[1.0, 1.21, 4.0]]), np.zeros((1, 3, 3))
    among[0] = [[0, 0.01, 9], [0.01, 0, 9], [9, 9, 0]]
    assert graphs.robust_prune(d, among, 1.0, 8).tolist() == [[True, False, True]]
    assert graphs.robust_prune(d, among, 1.0, 1).tolist() == [[True, False, False]]


def test_recall_with_the_querys_settings(spark):
    """The query's beam over several shards, each searched by several blocks of queries that share it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    queries = graphs.usable(df, "vec_id", "embedding").filter("vec_id % 20 = 0")
    got = graphs.search(graphs.index(df, shard_bytes=1000 * (8 * 64 + 256)), queries, beam=192, block=32, together=2).collect()
    hits = 0
    for q in range(0, 3000, 20):
        d = np.square(x.astype(float) - x[q].astype(float)).sum(1)
        want = {int(i) for i in np.argsort(d, kind="stable")[1:11]}
        hits += len(want & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 1500 and hits / 1500 >= 0.9
