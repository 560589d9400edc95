import os
import tempfile

from pyspark.sql import functions as F

from nnspark.operators import exact
from nnspark.plans import registry
from nnspark.streaming.ingest import keyword_vectors_stream


def test_stream_ingest_appends_vectors(spark):
    d = tempfile.mkdtemp(prefix="nn-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w", encoding="utf-8") as f:
        f.write("1 red bolt\n2 blue gear\nx bad\n1 red bolt again\n")
    qs = keyword_vectors_stream(spark, src, os.path.join(d, "out"), os.path.join(d, "ck"),
                                rejects_dir=os.path.join(d, "rej"), trigger_once=True)
    for q in qs:
        q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(d, "out"))
    assert sorted(r["vec_id"] for r in out.collect()) == [1, 1, 2]
    assert out.where(F.size("embedding") != 64).count() == 0
    assert spark.read.parquet(os.path.join(d, "rej")).count() == 1


def test_registry_sweep(emb):
    qs = exact.self_queries(emb.where("vec_id < 400"))
    long = registry.sweep(emb, qs, [5, 10], {"exact": {}, "ivf": {"nlist": 8, "n_iter": 2, "nprobe": 8}})
    rows = long.where("k = 10").groupBy("algo").agg(F.avg("sum_dist").alias("s")).collect()
    s = {r["algo"]: r["s"] for r in rows}
    assert abs(s["exact"] - s["ivf"]) < 1e-9          # nprobe = nlist is exact
    assert set(registry.methods()) >= {"exact", "ivf", "forest", "graph"}


def test_trigram_udf_equals_expression(spark):
    from nnspark.operators import embed

    df = spark.createDataFrame([("Red Bolt",), ("ab",), ("",), ("Élan vital",)], "text string")
    a = df.select(embed.trigram_udf()(F.col("text")).alias("w")).collect()
    b = df.select(embed.trigram_weights("text").alias("w")).collect()
    assert [r["w"] for r in a] == [r["w"] for r in b]


def test_registry_runs_every_method_with_one_contract(emb):
    qs = exact.self_queries(emb)
    cols = ["query_id", "rank", "id", "dist", "d2", "cost", "n_hits", "algo"]
    for name, params in (("forest", {"n_trees": 2, "max_leaf": 40, "search_k": 80}), ("graph", {"m": 4, "ef": 10})):
        r = registry.search(name, emb, qs, 5, **params)
        assert r.columns[:8] == cols
        row = r.agg(F.max("rank"), F.min("n_hits"), F.countDistinct("query_id")).first()
        assert row[0] <= 5 and row[1] >= 1 and row[2] == emb.count()


def test_with_text_broadcast_bound_same_result(spark, emb):
    qs = exact.self_queries(emb)
    r = exact.exact_knn(emb, qs, 3)
    texts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_partkey AS id", "p_name AS text")
    a = {tuple(x) for x in exact.with_text(r, texts, hits_bound=emb.count() * 3).select("query_id", "rank", "text").collect()}
    b = {tuple(x) for x in exact.with_text(r, texts).select("query_id", "rank", "text").collect()}
    assert a == b and len(a) == emb.count() * 3


def test_sweep_of_a_smaller_k_is_its_own_search(emb):
    small = emb.where("vec_id < 120")
    qs = exact.self_queries(small)
    plan = {"forest": {"n_trees": 2, "max_leaf": 8}, "graph": {"m": 4, "ef": 4}}
    both = registry.sweep(small, qs, [3, 6], plan).where("k = 3")
    alone = registry.sweep(small, qs, [3], plan)
    cols = ["algo", "query_id", "n_hits", "cost", F.round("sum_dist", 9).alias("s"), F.round("spread", 9).alias("sp")]
    a = sorted(tuple(r) for r in both.select(*cols).collect())
    assert a == sorted(tuple(r) for r in alone.select(*cols).collect())
    assert len(a) == 240 and all(r[-1] is not None for r in a)
