"""The fitted encoder: the same under any partitioning, equal to the direct computation, and useful."""

import numpy as np
from helpers import SF001
from pyspark.sql import functions as F

from nnspark.operators import embed, encoder, exact
from nnspark.session import scratch_path


def corpus(spark):
    rng = np.random.default_rng(3)
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(5)]
    rows = [(i, " ".join(rng.choice(topics[i % 5], 12)) + " the of " * 3) for i in range(200)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "...")], "vec_id long, text string").repartition(4)


def test_same_vectors_under_any_partitioning_and_after_reopening(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "text")
    a, b = encoder.fit(docs.coalesce(1), dim=16), encoder.fit(docs.repartition(7), dim=16)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.idf, b.idf)
    path = scratch_path(spark, "encoder")
    a.save(spark, path)
    again = encoder.Encoder.open(spark, path)
    x = {r["vec_id"]: r["embedding"] for r in a.embed(docs.coalesce(1)).collect()}
    y = {r["vec_id"]: r["embedding"] for r in again.embed(docs.repartition(5)).collect()}
    assert x == y and all(len(v) == 16 for v in x.values())


def test_matches_the_direct_factorisation(spark):
    docs = corpus(spark)
    texts = [r["text"] for r in docs.collect() if r["text"] is not None]
    found = encoder.fit(docs, dim=8, features=512)
    df = np.zeros(512)
    for t in texts:
        df[encoder.terms(t, 512)[0]] += 1
    idf = np.round(np.log((1 + len(texts)) / (1 + df)) + 1, 7)
    W = np.zeros((len(texts), 512))
    for row, t in zip(W, texts):
        u, tf = encoder.terms(t, 512)
        row[u] = encoder.weights(u, tf, idf)
    signs = np.random.default_rng(7).integers(0, 2, (512, 24)) * 2 - 1
    u = np.linalg.svd(W.T @ (W @ signs), full_matrices=False)[0][:, :8]
    got = found.vectors.astype(float)
    assert np.allclose(np.abs(np.sum(got * u, axis=0)), 1, atol=1e-5)
    exact_top = np.linalg.eigh(W.T @ W)[1][:, ::-1][:, :5]   # the sketch holds the strongest directions
    cosines = np.linalg.svd(exact_top.T @ got)[1]  # one pass over the texts, so not exactly
    assert cosines.mean() > 0.9 and cosines.min() > 0.8


def test_texts_of_a_topic_are_neighbours_and_queries_use_the_model(spark):
    docs = corpus(spark)
    model = encoder.fit(docs, dim=8)
    vectors = model.embed(docs)
    blank = {r["vec_id"]: r["embedding"] for r in vectors.where("vec_id >= 900").collect()}
    assert blank == {i: [0.0] * 8 for i in (900, 901, 902)}
    near = exact.exact_knn(vectors, exact.self_queries(vectors.where("vec_id < 200")), 10)
    assert near.select(F.avg(((F.col("id") % 5) == (F.col("query_id") % 5)).cast("int"))).first()[0] > 0.95
    q = spark.createDataFrame([(1, "t2w3 t2w7 the"), (2, "t4w1")], "query_id long, query string")
    qs = embed.embed_queries(q, encoder=lambda d: model.embed(d, "query"))
    hits = exact.exact_knn(vectors, qs, 5).collect()
    assert {(r["query_id"], r["id"] % 5) for r in hits} == {(1, 2), (2, 4)}


def test_no_texts(spark):
    empty = spark.createDataFrame([], "vec_id long, text string")
    model = encoder.fit(empty, dim=4)
    assert model.encode("some words").tolist() == [0.0] * 4 and model.embed(empty).count() == 0


def test_terms_are_those_of_the_regular_expression_which_ascii_texts_do_not_take(monkeypatch):
    import re
    import zlib

    odd = ["", "a_B9-c\x1cd\x85e", "\u00c9t\u00e9 x\u00a0y \u0130x \u00df", "a\u0307b\u2028c", "\u0391\u03a3.\u0392 \u0391\u03a3 x", "\ud800 a", "\u0663\u0664 ab \u6f22\u5b57"]
    for text in [*odd, *(f"a{chr(c)}B" for c in range(0x300))]:
        words = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % 4096 for w in re.findall(r"\w+", text.lower())]
        u, tf = encoder.terms(text)
        assert dict(zip(u.tolist(), tf.tolist())) == {h: words.count(h) for h in words} and list(u) == sorted(u)
    monkeypatch.setattr(encoder, "_WORD", None)
    assert encoder.terms("Two words, two Words!")[1].tolist() == [2, 2]
