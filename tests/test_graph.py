from pyspark.sql import functions as F

from nnspark.operators import exact, graph, quality


def test_graph_search_high_recall_and_bounded(emb):
    g = graph.build(emb, m=8, n_entries=4)
    qs = exact.self_queries(emb)
    r = graph.search(g, qs, 10, ef=40, corpus=emb)
    assert r.agg(F.max("rank")).first()[0] <= 10
    rec = quality.mean_recall(quality.recall(exact.exact_knn(emb, qs, 10), r.withColumn("m", F.lit(8))), ["m"])
    assert rec.first()["recall"] > 0.9


def test_edges_are_symmetric(emb):
    g = graph.build(emb, m=4, n_entries=2)
    e = g.edges
    assert e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").count() == 0


def test_graph_query_blocks_equal_single_pass(emb):
    from helpers import assert_same_ranking, ranked_dict

    g = graph.build(emb, m=8, n_entries=4)
    qs = exact.self_queries(emb)
    a = graph.search(g, qs, 5, ef=20, corpus=emb, budget=80_000)
    b = graph.search(g, qs, 5, ef=20, corpus=emb)
    assert_same_ranking(ranked_dict(a), ranked_dict(b), tol=0.0)


def test_graph_save_open(spark, emb):
    from helpers import assert_same_ranking, ranked_dict
    from nnspark.session import scratch_path

    g = graph.build(emb, m=4, n_entries=2)
    path = scratch_path(spark, "graph")
    g.save(path)
    g2 = graph.Graph.open(spark, path)
    assert (g2.entries, g2.m, g2.n_edges, g2.n_vectors) == (g.entries, g.m, g.n_edges, g.n_vectors)
    assert g2.edges.exceptAll(g.edges).isEmpty() and g2.vectors.exceptAll(g.vectors).isEmpty()
    # the saved buckets are used as they lie: a join on the key shuffles the other side alone
    small = spark.range(5).hint("merge")
    plan = g2.vectors.join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    qs = exact.self_queries(emb)
    assert_same_ranking(ranked_dict(graph.search(g2, qs, 5, ef=10, corpus=emb)),
                        ranked_dict(graph.search(g, qs, 5, ef=10, corpus=emb)), tol=0.0)


def test_ivf_blocked_edges_with_full_probe_equal_exact(emb):
    from nnspark.operators import ivf

    idx = ivf.build(emb, nlist=8, n_iter=2)
    a = {(r["src"], r["dst"], r["rank"]) for r in graph.knn_edges(emb, 4, ivf_index=idx, nprobe=8).collect()}
    b = {(r["src"], r["dst"], r["rank"]) for r in graph.knn_edges(emb, 4).collect()}
    assert a == b


def test_a_query_goes_once_to_each_block_of_vectors(spark, emb):
    import numpy as np

    from nnspark.operators import beam
    from nnspark.operators.kernels import ltr_sq_dist

    vecs = exact.corpus_frame(emb)
    held = {r["id"]: np.array(r["vec"], float) for r in vecs.collect()}
    blocks = beam.deal(vecs, len(held), 64, block_bytes=len(held) * 64 * 8 // 4)
    assert blocks.n_blocks >= 4
    ids = sorted(held)
    asked = spark.createDataFrame([(q, held[q].tolist(), ids[q % 7::3] + [10 ** 12]) for q in ids[:40]] + [(-1, [0.0] * 64, [])],
                                  "query_id long, qv array<double>, ids array<long>")
    rows = beam.score(asked, blocks).collect()
    assert max(sum(r["query_id"] == q for r in rows) for q in ids[:40]) <= blocks.n_blocks
    got = {(r["query_id"], i): d for r in rows for i, d in zip(r["ids"], r["d2"])}
    assert got == {(q, i): float(ltr_sq_dist(held[q], held[i])) for q in ids[:40] for i in ids[q % 7::3]}


def test_repeated_query_ids_and_entries_without_a_vector(spark, emb):
    g = graph.build(emb, m=6, n_entries=3)
    qs = exact.self_queries(emb)
    once = graph.search(g, qs, 5, ef=20, corpus=emb)
    g.entries = [*g.entries, g.entries[0], 10 ** 12]
    twice = graph.search(g, qs.unionByName(qs.limit(9)), 5, ef=20, corpus=emb)
    assert twice.exceptAll(once).isEmpty() and once.exceptAll(twice).isEmpty()
