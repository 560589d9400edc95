"""Exact search with pruning: the rows of exact search, at a lower cost where the data allow it."""

import numpy as np
from helpers import assert_same_ranking, ranked_dict
from pyspark.sql import functions as F

from nnspark.operators import exact, pruned


def test_rows_equal_exact_search(spark, emb):
    g = pruned.build(emb, nlist=12, n_iter=2)
    qs = exact.self_queries(emb)
    for kw in ({}, {"exclude_self": True}):
        assert_same_ranking(ranked_dict(pruned.search(g, qs, 10, **kw)), ranked_dict(exact.exact_knn(emb, qs, 10, **kw)), tol=0.0)
    few = qs.where("query_id % 40 = 0")
    assert_same_ranking(ranked_dict(pruned.search(g, few, 500)), ranked_dict(exact.exact_knn(emb, few, 500)), tol=0.0)


def test_clusters_are_skipped_and_ties_kept(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6)) * 50
    X = np.round(centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 6)), 1)
    X[700:760] = X[699]  # many equal vectors
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<double>").repartition(4)
    table = table.unionByName(spark.createDataFrame([(9999, None)], table.schema))
    g = pruned.build(table, nlist=40)
    qs = exact.self_queries(table).where("query_id % 15 = 0 or query_id = 699")
    r = pruned.search(g, qs, 10)
    assert_same_ranking(ranked_dict(r), ranked_dict(exact.exact_knn(table, qs, 10)), tol=0.0)
    assert r.agg(F.avg("cost")).first()[0] < 250 and r.agg(F.min("cost")).first()[0] >= 10


def test_empty_sides(spark, emb):
    none = emb.where("false")
    assert pruned.search(pruned.build(none), exact.self_queries(emb), 5).count() == 0
    assert pruned.search(pruned.build(emb, nlist=4, n_iter=1), exact.self_queries(none), 5).count() == 0


def test_groups_are_told_in_tasks_not_listed_for_every_query(spark, emb, monkeypatch):
    written = []
    keep = pruned._written
    monkeypatch.setattr(pruned, "_written", lambda df, name: (written.append(keep(df, name)), written[-1])[1])
    g = pruned.build(emb, nlist=60, n_iter=1)
    written.clear()
    qs = exact.self_queries(emb)
    pruned.search(g, qs, 3).count()
    assert max(t.count() for t in written) <= 2 * emb.count() * 4   # a few hits a query and group of postings, not 60 groups


def test_a_bound_rules_out_hits_from_the_first_list():
    """Before, every list gave its k nearest until a million hits waited."""
    from nnspark.operators import list_scan

    rng = np.random.default_rng(8)
    Q, V = rng.normal(size=(40, 4)), rng.normal(size=(300, 4))
    d = np.sqrt(((Q[:, None] - V[None]) ** 2).sum(-1))
    bound = np.sort(d, axis=1)[:, 4] * (1 + 1e-6)
    rings = list_scan.Rings(np.array([0]), np.zeros((1, 4)), np.array([0.0]), np.array([9.0]))
    asked = [(np.arange(40), Q, bound, np.zeros(0, np.int32), np.zeros(40, np.int64))]
    block = list_scan._Block(asked, 5, False, rings)
    block.scan(0, np.arange(300), np.zeros(300, np.int64), np.sqrt((V * V).sum(1)), V)
    assert block.hits.n_waiting == 200
