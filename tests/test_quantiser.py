"""The k-means tree held as tables against numpy; edge cases."""

import hashlib

import numpy as np
import pytest
from helpers import assert_same_ranking, ranked_dict
from pyspark.sql import functions as F

from nnspark.operators import exact, ivf, quantiser
from nnspark.session import scratch_path

VECTORS = "vec_id long, embedding array<float>"


def lloyd(X, C, n_iter):
    for _ in range(n_iter):
        lab = np.array([np.lexsort((np.arange(len(C)), ((C - x) ** 2).sum(1)))[0] for x in X], int)
        C = np.array([np.round(X[lab == j].mean(0), 9) if (lab == j).any() else C[j] for j in range(len(C))])
    return C, np.array([np.lexsort((np.arange(len(C)), ((C - x) ** 2).sum(1)))[0] for x in X], int)


@pytest.mark.parametrize("group_bytes", [1 << 20, 3000])
def test_tree_matches_numpy(spark, emb, emb_np, group_bytes):
    ids, X = emb_np
    tree = quantiser.train(emb, nlist=20, n_iter=3, group_bytes=group_bytes)  # small groups: every cell is cut
    order = sorted(range(len(ids)), key=lambda i: (int(hashlib.md5(f"ivf:{ids[i]}".encode()).hexdigest()[:8], 16), ids[i]))
    cells, lab = lloyd(X, X[order[:5]], 3)
    got = {r["list_id"]: r["centroid"] for r in tree.cells.collect()}
    assert np.abs(np.array([got[i] for i in range(5)]) - cells).max() < 2e-9
    want, first = {}, 0
    for c in range(5):
        members = [i for i in order if lab[i] == c]
        if not members:
            continue
        share = max(1, int(np.floor(len(members) * 20 / len(ids) + 0.5)))
        C, _ = lloyd(X[np.sort(members)], X[members[:share]], 3)
        want |= {first + j: (c, row) for j, row in enumerate(C)}
        first += share
    lists = {r["list_id"]: (r["cell"], r["centroid"]) for r in tree.lists.collect()}
    assert lists.keys() == want.keys() and all(lists[i][0] == want[i][0] for i in want)
    assert max(np.abs(np.array(lists[i][1]) - want[i][1]).max() for i in want) < 2e-9
    post = {r["id"]: r["list_id"] for r in quantiser.assign(emb, tree, group_bytes=group_bytes).collect()}
    assert len(post) == len(ids)
    for i, x in zip(ids, X):
        own = [j for j in lists if lists[j][0] == int(np.argmin(((cells - x) ** 2).sum(1)))]
        best = min(((np.array(lists[j][1]) - x) ** 2).sum() for j in own)
        assert abs(((np.array(lists[post[i]][1]) - x) ** 2).sum() - best) < 1e-9


def test_full_probe_equals_exact_and_reopens(spark, emb):
    idx = quantiser.build(emb, nlist=16, n_iter=2)
    qs = exact.self_queries(emb)
    want = ranked_dict(exact.exact_knn(emb, qs, 10))
    assert_same_ranking(ranked_dict(quantiser.search(idx, qs, 10, 100, 100)), want, tol=0.0)
    path = scratch_path(spark, "tree-index")
    idx.save(path)
    again = quantiser.TreeIndex.open(spark, path)
    part = quantiser.search(again, qs, 10, 4)
    assert_same_ranking(ranked_dict(part), ranked_dict(quantiser.search(idx, qs, 10, 4)), tol=0.0)
    assert part.agg(F.max("cost")).first()[0] < emb.count()


def test_flat_round_equals_the_driver_held_one(spark, emb):
    sample = ivf.sample_vectors(emb, 10**6)
    C = ivf.seed_centroids(sample, 12)
    lists = quantiser.seeds(sample, 12)
    for _ in range(2):
        C = ivf.lloyd_round(sample, C)
        lists = quantiser.lloyd_round(sample.withColumn("cell", F.lit(0)), lists)
    got = {r["list_id"]: r["centroid"] for r in lists.collect()}
    assert np.abs(np.array([got[i] for i in range(12)]) - C).max() < 2e-9


def test_crowded_cell_empty_list_and_few_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(1000 + i, [float(i), -5.0]) for i in range(30)] + [(5000, None)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    idx = quantiser.build(table, nlist=9, n_iter=3, group_bytes=400)
    assert idx.postings.count() >= 330
    qs = exact.self_queries(table)
    assert_same_ranking(ranked_dict(quantiser.search(idx, qs, 5, 50, 50)), ranked_dict(exact.exact_knn(table, qs, 5)), tol=0.0)
    one = spark.createDataFrame([(7, [1.0, 2.0])], VECTORS)
    assert quantiser.search(quantiser.build(one, n_iter=1), exact.self_queries(one), 3, 1).count() == 1


def test_numbering_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert [r["pos"] for r in quantiser.numbered(df, "v").orderBy("v").collect()] == list(range(1000))
