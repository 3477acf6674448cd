import time

import numpy as np

from quantloom.llm import ann
from quantloom.llm.queries import QUERIES


def brute(ids, x, asked, k=20):
    out = {}
    for i in asked:
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_op4_recall_and_order(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0))
    got = {}
    for r in QUERIES["op4_nearest"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    recall = np.mean([len({r.vec_id for r in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    for q, own in got.items():
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_recall_on_many_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 64))
    x[:3000] = x[0]  # one very common vector
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(len(x)).astype(np.int64)
    asked = np.r_[0:5, 4000:4080]
    config = ann.PermutationConfig()
    pivots = ann._lifted(np.unique(x, axis=0)[rng.permutation(6001)[: config.pivots]], 1.0)
    got = ann._search(ids, x, ids[asked], x[asked], pivots, 1.0, 20, config)
    want = brute(ids, x, asked)
    recall = np.mean([len(set(got[got.query_id == q].vec_id) & {v for v, _ in own}) / 20 for q, own in want.items()])
    assert recall >= 0.9
    copies = int(ids[0])
    assert list(got[got.query_id == copies].vec_id) == [v for v, _ in want[copies]]  # ties go to the smaller ids


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [3.0, 4.0]), (8, []), (20, [0.5, 0.5]), (7, [3.0, 4.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 7, 3.0), (0, 2, 7, 3.0), (0, 3, 1, 1.0), (20, 1, 7, 3.5), (20, 2, 7, 3.5), (20, 3, 0, 0.5)]
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def test_vectors_of_other_lengths_and_huge_ones(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1.0, 2.0]), (3, [-1e200, 0.0]), (4, [1.0, 2.0, 3.0]), (20, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), 5).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, np.inf), (0, 2, 1e200), (0, 3, -np.inf)]


def test_recall_over_several_shards(spark):
    """A table of many shards: the index alone, with few candidates of each, finds what brute force finds."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(60, 24))
    x = centre[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 24))
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    config = ann.PermutationConfig(pivots=128, prefix=32, candidates=0.1, least_candidates=60, shard_rows=1000, query_rows=100)
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20, config).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(6000), x, np.arange(0, 6000, 20))
    assert set(got) == set(want)
    assert np.mean([len(got[q] & {i for i, _ in own}) / 20 for q, own in want.items()]) >= 0.9


def test_candidates_are_those_of_least_footrule():
    """Without an exact rank list of all: the reranked ones are the nearest by the orders of pivots, of equals the first."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8))
    config = ann.PermutationConfig(pivots=20, prefix=7, candidates=0.1, least_candidates=30)
    norm = float(np.linalg.norm(x, axis=1).max())
    pivots = ann._lifted(x[:20], norm)
    got = ann._search(np.arange(700), x, np.arange(5), x[:5], pivots, norm, 12, config)
    order = lambda v: [int(p) for p in np.argsort(-(v @ pivots.T), kind="stable")[:7]]
    lists = [order(v) for v in ann._lifted(x, norm)]
    for i in range(5):
        asked = order(np.r_[x[i], 0.0])
        rank = lambda own, p: own.index(p) if p in own else 7
        footrule = [sum(abs(rank(asked, p) - rank(own, p)) for p in range(20)) for own in lists]
        best = [j for j in np.lexsort((np.arange(700), footrule))[:70] if j != i]
        want = sorted(best, key=lambda j: (-(x[j] * x[i]).sum(), j))[:12]
        assert list(got[got.query_id == i].vec_id) == want


def test_a_query_costs_little_beside_all_products():
    """CPU time of one thread for queries added to a full shard, against exact products with all its vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8192, 64))
    norm = float(np.linalg.norm(x, axis=1).max())
    ids, pivots, config = np.arange(len(x)), ann._lifted(x[:512], norm), ann.PermutationConfig()

    def cpu(f):
        t = time.thread_time()
        f()
        return time.thread_time() - t

    of = lambda n: cpu(lambda: ann._search(ids, x, ids[:n], x[:n], pivots, norm, 20, config))
    plain = min(cpu(lambda: [np.lexsort((ids, -(x * x[i]).sum(axis=1)))[:20] for i in range(200)]) for _ in range(3))
    of(10)
    added = min(of(210) for _ in range(3)) - min(of(10) for _ in range(3))
    assert added < 1.3 * plain
