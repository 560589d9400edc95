"""Neighbour descent and the layered graph against brute force; edge cases."""

import numpy as np
import pytest
from helpers import brute_topk, ranked_dict
from pyspark.sql import functions as F

from nnspark.operators import descent, exact, layered, quality
from nnspark.session import scratch_path

VECTORS = "vec_id long, embedding array<float>"


def table(spark, X, ids=None):
    ids = range(len(X)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(e) for e in x]) for i, x in zip(ids, X)], VECTORS).repartition(4)


def edges_of(X, k):
    d = np.stack([((X - x) ** 2).sum(-1) for x in X])
    np.fill_diagonal(d, np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(X)), row))[:k]] for i, row in enumerate(d)}, d


def test_descent_finds_the_neighbours_of_all_rows(spark):
    X = np.random.default_rng(1).normal(size=(3000, 12)).astype(np.float32).astype(float)
    found = descent.neighbour_lists(exact.corpus_frame(table(spark, X)), 20)
    near, d = edges_of(X, 10)
    lists = {}
    for r in found.lists.collect():
        assert abs(r["d2"] - d[r["src"], r["dst"]]) < 1e-9 and r["src"] != r["dst"]
        lists.setdefault(r["src"], set()).add(r["dst"])
    assert max(len(v) for v in lists.values()) <= 20
    recall = np.mean([len(lists[i] & set(near[i])) / 10 for i in range(len(X))])
    assert recall > 0.95 and found.evaluations < 0.35 * len(X) ** 2 and found.rounds > 1


def test_descent_of_few_crowded_and_no_vectors(spark):
    X = np.random.default_rng(2).normal(size=(20, 5))
    found = descent.neighbour_lists(exact.corpus_frame(table(spark, X.astype(np.float32))), 6)
    got = {}
    for r in found.lists.orderBy("src", "d2", "dst").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == edges_of(X.astype(np.float32).astype(float), 6)[0] and found.rounds == 0
    same = table(spark, np.ones((300, 4)))  # one side of every plane: cut by hash
    lists = descent.neighbour_lists(exact.corpus_frame(same), 5).lists
    assert lists.agg(F.max("d2")).first()[0] == 0 and lists.select("src").distinct().count() == 300
    assert descent.neighbour_lists(exact.corpus_frame(table(spark, np.ones((1, 4)))), 5).lists.count() == 0
    assert descent.neighbour_lists(exact.corpus_frame(same.filter("false")), 5).lists.count() == 0


def test_levels_thin_out_geometrically(spark):
    rows = spark.range(20000).select(layered.level("id", 4).alias("l")).groupBy("l").count().orderBy("l").collect()
    share = [r["count"] / 20000 for r in rows]
    assert all(abs(share[i] - 0.75 * 0.25 ** i) < 0.02 for i in range(3)) and rows[-1]["l"] >= 4


@pytest.mark.parametrize("fill", [False, True])
def test_occlusion_matches_its_definition(spark, fill):
    X = np.round(np.random.default_rng(3).normal(size=(80, 3)), 1)  # ties of distance
    near, d = edges_of(X, 15)
    nodes = exact.corpus_frame(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<double>"))
    cand = spark.createDataFrame([(i, j, float(d[i, j])) for i, js in near.items() for j in js], descent.LISTS)
    got = {}
    for r in layered.occlude(cand, nodes, 6, fill).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    dist = lambda a, b: sum((float(x) - float(y)) ** 2 for x, y in zip(X[a], X[b]))
    for i, js in near.items():
        js, kept = sorted(js, key=lambda j: (float(d[i, j]), j)), []
        for j in js:
            if len(kept) < 6 and all(dist(j, o) > float(d[i, j]) for o in kept):
                kept.append(j)
        if fill:
            kept += [j for j in js if j not in kept][:6 - len(kept)]
        assert got[i] == set(kept)


def test_search_recall_cost_and_degrees(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(1200, 16)).astype(np.float32)
    emb = table(spark, X)
    g = layered.build(emb, m=8)
    assert len(g.edges) >= 3
    for e in g.edges:
        assert (e.agg(F.max(F.size("dsts"))).first()[0] or 0) <= 16
    qs = spark.createDataFrame([(i, [float(e) for e in x]) for i, x in enumerate(rng.normal(size=(60, 16)).astype(np.float32))],
                               "query_id long, qv array<float>")
    r = layered.search(g, qs, 10, ef=60)
    rec = quality.mean_recall(quality.recall(exact.exact_knn(emb, qs, 10), r.withColumn("m", F.lit(8))), ["m"]).first()["recall"]
    cost = r.agg(F.avg("cost")).first()[0]
    assert rec >= 0.95 and cost < 600
    want = brute_topk(range(60), np.array([q["qv"] for q in qs.orderBy("query_id").collect()]), np.arange(1200), X.astype(float), 1200)
    d2 = {q: dict(v) for q, v in want.items()}
    for q, hits in ranked_dict(r).items():
        assert len(hits) == 10
    assert all(abs(h["d2"] - d2[h["query_id"]][h["id"]]) < 1e-9 for h in r.collect())
    path = scratch_path(spark, "layered")
    g.save(path)
    again = layered.search(layered.LayeredGraph.open(spark, path), qs, 10, ef=60)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, r.collect()))


def test_equal_vectors_null_rows_and_short_lists(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate((np.ones((100, 4)), rng.normal(size=(60, 4)))).astype(np.float32)  # most rows are one vector
    emb = table(spark, X).unionByName(spark.createDataFrame([(900, None), (901, None)], VECTORS))
    g = layered.build(emb, m=4)
    assert g.vectors.count() == 61
    qs = exact.self_queries(emb)
    got, want = ranked_dict(layered.search(g, qs, 7, ef=61)), ranked_dict(exact.exact_knn(emb, qs, 7))
    assert got.keys() == want.keys()
    right = sum([i for i, *_ in got[q]] == [i for i, *_ in want[q]] for q in want)
    assert right >= 0.95 * len(want) and [i for i, *_ in got[3]] == list(range(7))
    few = table(spark, X[99:103])
    r = layered.search(layered.build(few, m=4), exact.self_queries(few), 10, with_vectors=True)
    assert r.count() == 16 and r.agg(F.max("n_hits")).first()[0] == 4 and r.where("vec is null").isEmpty()
    one = table(spark, X[:1])
    assert layered.search(layered.build(one), exact.self_queries(one), 3).count() == 1


def test_empty_corpus_and_no_queries(spark):
    empty = spark.createDataFrame([], VECTORS)
    g = layered.build(empty)
    qs = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, qv array<float>")
    assert layered.search(g, qs, 5).count() == 0 and layered.search(g, qs, 5, with_vectors=True).count() == 0
    some = table(spark, np.eye(3))
    assert layered.search(layered.build(some), qs.filter("false"), 5).count() == 0
