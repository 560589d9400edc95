"""What tasks hold whole gives the rows of the plans that exchange vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nnspark.operators import beam, descent, exact, graph, held, layered
from nnspark.operators.exact import _RunningTopk
from nnspark.operators.kernels import ltr_sq_dist, near_pairs

VECTORS = "vec_id long, embedding array<float>"


def table(spark, X):
    return spark.createDataFrame([(7 * i - 50, [float(e) for e in x]) for i, x in enumerate(X)], VECTORS).repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def some_vectors(n, dim, seed):
    X = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    X[n // 2:n // 2 + 9] = X[:9]
    return X


def test_descent_held_by_tasks_gives_the_same_lists(spark, monkeypatch):
    frame = exact.corpus_frame(table(spark, some_vectors(300, 6, 1)))
    with monkeypatch.context() as m:
        m.setattr(held, "HELD_BYTES", 0)
        apart = descent.neighbour_lists(frame, 12)
    monkeypatch.setattr(descent, "_pairs", None)    # no vector travels for a pair
    whole = descent.neighbour_lists(frame, 12)
    assert rows(whole.lists) == rows(apart.lists)
    assert (whole.evaluations, whole.rounds) == (apart.evaluations, apart.rounds)


def test_searches_held_by_tasks_give_the_same_rows(spark, monkeypatch):
    emb = table(spark, some_vectors(260, 6, 2))
    qs = exact.self_queries(emb)
    deep, flat = layered.build(emb, 4), graph.build(emb, 4)
    both = lambda: (rows(layered.search(deep, qs, 5, 12)), rows(graph.search(flat, qs, 5, 12, corpus=emb)))
    with monkeypatch.context() as m:
        m.setattr(held, "HELD_BYTES", 0)
        apart = both()
    monkeypatch.setattr(beam, "settle", None)       # no round is a job
    assert both() == apart


def test_repeated_query_ids_keep_their_rows(spark, monkeypatch):
    emb = table(spark, some_vectors(120, 5, 6))
    deep = layered.build(emb, 4)
    qs = exact.self_queries(emb).where("query_id < 100")
    qs = qs.unionByName(qs.where("query_id < 0"))
    whole = rows(layered.search(deep, qs, 4, 8))
    monkeypatch.setattr(held, "HELD_BYTES", 0)
    assert whole == rows(layered.search(deep, qs, 4, 8))


def test_hash_of_a_pair_is_that_of_spark(spark):
    pairs = [(-5, 3), (0, 0), (2**61, -1), (17, 2**40)]
    df = spark.createDataFrame(pairs, "src long, dst long").select("src", "dst", F.xxhash64("src", "dst", F.lit(9)).alias("h"))
    got = df.collect()
    src, dst, h = (np.array([r[i] for r in got], np.int64) for i in range(3))
    assert held.pair_hash(src, dst, 9).tolist() == h.tolist()


@pytest.mark.parametrize("fill", [False, True])
def test_occlusion_of_many_vectors_at_once(fill):
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 24):
        X = rng.normal(size=(n, 5))
        X = X[np.argsort((X * X).sum(1))]
        d2 = ltr_sq_dist(np.zeros(5), X)
        padded = np.append(d2, [np.nan] * 3)[None], np.append(X, np.repeat(X[-1:], 3, 0), 0)[None]
        assert np.flatnonzero(layered._keep_in_rows(*padded, 4, fill)[0]).tolist() == sorted(layered._keep_unoccluded(d2, X, 4, fill))


@pytest.mark.parametrize("scale", [1.0, 1e-22, 1e18])
def test_lists_bounded_by_their_last_hit_are_exact(scale):
    rng = np.random.default_rng(4)
    V = rng.normal(size=(2500, 9)) * scale
    V[1200:] = V[rng.integers(0, 1200, 1300)]       # many ties
    ids = rng.permutation(2500)
    best = _RunningTopk(np.arange(60), V[:60], 12)
    for lo in range(0, 2500, 700):
        best.add(ids[lo:lo + 700], V[lo:lo + 700])
    for q in range(60):
        d = ltr_sq_dist(V[q], V)
        order = np.lexsort((ids, d))[:12]
        assert best.i[q].tolist() == ids[order].tolist() and best.d[q].tolist() == d[order].tolist()
    q, r, d2 = near_pairs(V[:60], V, best.d[:, -1])
    d = np.stack([ltr_sq_dist(x, V) for x in V[:60]])
    assert list(zip(q, r)) == list(zip(*np.nonzero(d <= best.d[:, -1:]))) and (d2 == d[q, r]).all()


def test_a_full_list_meets_no_shortlists(monkeypatch):
    """After the first vectors no batch is sorted for every query any more."""
    calls = []
    monkeypatch.setattr(exact, "batch_topk", lambda q, V, ids, k, f=exact.batch_topk: calls.append(len(V)) or f(q, V, ids, k))
    V = np.random.default_rng(5).normal(size=(6000, 4))
    best = _RunningTopk(np.arange(10), V[:10], 5)
    best.add(np.arange(6000), V)
    assert sum(calls) <= 1000 and best.seen == 6000
