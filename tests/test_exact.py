import numpy as np
from pyspark.sql import functions as F

from helpers import assert_same_ranking, brute_topk, ranked_dict
from nnspark.operators import exact
from nnspark.operators.kernels import batch_topk, ltr_sq_dist


def test_exact_matches_brute_force(emb, emb_np):
    ids, V = emb_np
    got = ranked_dict(exact.exact_knn(emb, exact.self_queries(emb), 20))
    assert_same_ranking(got, brute_topk(ids, V, ids, V, 20))


def test_exact_result_contract(emb):
    r = exact.exact_knn(emb, exact.self_queries(emb), 5)
    assert r.columns[:7] == ["query_id", "rank", "id", "dist", "d2", "cost", "n_hits"]
    row = r.agg(F.min("cost"), F.max("cost"), F.min("n_hits"), F.max("rank")).first()
    n = emb.count()
    assert row[0] == row[1] == n and row[2] == 5 and row[3] == 5


def test_query_blocks_equal_single_block(emb):
    qs = exact.self_queries(emb)
    one = ranked_dict(exact.exact_knn(emb, qs, 10))
    many = ranked_dict(exact.exact_knn(emb, qs, 10, budget=40_000))  # forces several query blocks
    assert_same_ranking(many, one, tol=0.0)


def test_stable_under_repartition(emb):
    qs = exact.self_queries(emb)
    base = ranked_dict(exact.exact_knn(emb, qs, 10))
    for n in (1, 7):
        got = ranked_dict(exact.exact_knn(emb.repartition(n), qs.repartition(3), 10))
        assert_same_ranking(got, base, tol=0.0)


def test_k_larger_than_corpus_returns_fewer_rows(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, qv array<float>")
    r = exact.exact_knn(corpus, q, 10).orderBy("rank").collect()
    assert [x["id"] for x in r] == [1, 2, 3]
    assert all(x["n_hits"] == 3 for x in r)


def test_empty_corpus_returns_no_rows(spark):
    corpus = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, qv array<float>")
    assert exact.exact_knn(corpus, q, 5).count() == 0


def test_identical_vectors_ranked_by_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 1.0]) for i in (5, 3, 9, 1)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, qv array<float>")
    r = exact.exact_knn(corpus, q, 3).orderBy("rank").collect()
    assert [x["id"] for x in r] == [1, 3, 5]
    assert all(x["dist"] == 0.0 for x in r)


def test_exclude_self(emb, emb_np):
    ids, V = emb_np
    got = ranked_dict(exact.exact_knn(emb, exact.self_queries(emb), 5, exclude_self=True))
    assert_same_ranking(got, brute_topk(ids, V, ids, V, 5, exclude_self=True))


def test_k_sweep_prefix_equals_separate_searches(emb):
    qs = exact.self_queries(emb)
    sweep = exact.k_sweep(exact.exact_knn(emb, qs, 20), [5, 20])
    for k in (5, 20):
        sep = ranked_dict(exact.exact_knn(emb, qs, k))
        got = ranked_dict(sweep.where(F.col("k") == k))
        assert_same_ranking(got, sep, tol=0.0)


def test_with_text_default(spark):
    corpus = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [0.0])], "query_id long, qv array<float>")
    texts = spark.createDataFrame([(1, "one")], "id long, text string")
    r = exact.with_text(exact.exact_knn(corpus, q, 2), texts).orderBy("rank").collect()
    assert [x["text"] for x in r] == ["one", "ID 2"]


def test_kernel_exact_under_near_ties():
    rng = np.random.default_rng(0)
    V = rng.normal(size=(300, 16))
    V[10] = V[11] + 1e-13          # near-duplicate rows: product form cannot order them
    ids = np.arange(300)
    Q = V[[10, 11, 50]] + 1e-14
    qp, rp, d2 = batch_topk(Q, V, ids, 5, slack=1)
    for qi in range(3):
        want = np.lexsort((ids, ltr_sq_dist(Q[qi][None, :], V)))[:5]
        assert list(rp[qp == qi]) == list(want)


def test_large_query_tables_stay_off_the_driver_and_merge_in_levels(emb, monkeypatch):
    qs = exact.self_queries(emb)
    want = exact.exact_knn(emb, qs, 7, with_vectors=True)
    monkeypatch.setattr(exact, "gather_vectors", None)
    monkeypatch.setattr(exact, "GRID_GROUP_BYTES", 20_000)
    monkeypatch.setattr(exact, "MERGE_PARTS", 3)
    got = exact.exact_knn(emb, qs, 7, with_vectors=True, budget=40_000)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_memory_of_a_small_batch_does_not_follow_the_queries():
    import tracemalloc

    from nnspark.operators.kernels import batch_topk, nearest_rows

    rng = np.random.default_rng(3)
    Q, V = rng.normal(size=(40_000, 64)), rng.normal(size=(40, 64))
    tracemalloc.start()
    batch_topk(Q, V, np.arange(40), 20)
    nearest_rows(Q, V, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_running_lists_equal_one_pass_over_all_rows():
    rng = np.random.default_rng(4)
    V = np.round(rng.normal(size=(400, 3)), 1)  # many ties
    Q, ids = V[::3], np.arange(400) // 2        # repeated ids
    best = exact._RunningTopk(np.arange(len(Q)), Q, 30)
    for lo, hi in ((0, 5), (5, 5), (5, 40), (40, 400)):
        best.add(ids[lo:hi], V[lo:hi])
    rows = [r for b in best.batches(0) for r in b.to_pylist()]
    assert sum(r["n_eval"] for r in rows) == 400 * len(Q)
    for q in range(len(Q)):
        d2 = ((V - Q[q]) ** 2).sum(axis=1)
        want = [int(ids[j]) for j in np.lexsort((ids, d2))[:30]]
        assert [r["id"] for r in rows if r["query_id"] == q] == want
