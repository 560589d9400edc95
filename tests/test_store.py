"""Load or build: reuse, appended vectors, validity, half-written versions."""

import os

from helpers import assert_same_ranking, ranked_dict
from pyspark.sql import functions as F

from nnspark.operators import exact, ivf, store
from nnspark.session import scratch_path

P = {"nlist": 8, "n_iter": 2}


def postings(index):
    return sorted((r["id"], r["list_id"]) for r in index.postings.select("id", "list_id").collect())


def test_open_append_and_rebuild(spark, emb):
    path = scratch_path(spark, "store")
    some = emb.where("vec_id % 3 <> 0")
    first = store.load_or_build(some, path, **P)
    again = store.load_or_build(some.repartition(7), path, **P)
    assert (first.how, again.how, again.version) == ("built", "opened", 0)
    assert postings(first.index) == postings(again.index)

    grown = store.load_or_build(emb, path, **P)
    assert (grown.how, grown.n_new, grown.version) == ("appended", emb.count() - some.count(), 1)
    whole = ivf.assign(emb, first.index.centroids)
    assert postings(grown.index) == sorted((r["id"], r["list_id"]) for r in whole.select("id", "list_id").collect())
    qs = exact.self_queries(emb)
    assert_same_ranking(ranked_dict(ivf.search(grown.index, qs, 5, 8)), ranked_dict(exact.exact_knn(emb, qs, 5)), tol=0.0)
    assert store.load_or_build(emb, path, **P).how == "opened"
    assert store.load_or_build(some, path, **P).version == 0  # an earlier version is still whole

    changed = emb.withColumn("embedding", F.when(F.col("vec_id") == 5, F.transform("embedding", lambda x: x + 1)).otherwise(F.col("embedding")))
    assert store.load_or_build(changed, path, **P).how == "built"
    assert store.load_or_build(emb, path, nlist=4, n_iter=2).how == "built"


def test_a_version_without_its_manifest_does_not_exist(spark, emb):
    path = scratch_path(spark, "store")
    built = store.load_or_build(emb, path, **P)
    manifests = os.path.join(path.removeprefix("file:"), "manifests")
    half = os.path.join(manifests, "v00000009-dead")
    os.makedirs(half)  # a writer that died before its commit
    assert store.load_or_build(emb, path, **P).version == built.version
    n, mark = store.fingerprint(exact.corpus_frame(emb))
    twice = exact.corpus_frame(emb.unionByName(emb))
    assert store.fingerprint(twice) != (n, mark) and store.fingerprint(exact.corpus_frame(emb.orderBy(F.desc("vec_id")))) == (n, mark)


def test_null_vectors_and_empty_corpus(spark, emb):
    path = scratch_path(spark, "store")
    with_null = emb.unionByName(spark.createDataFrame([(10**6, None, None)], emb.select("vec_id", "embedding", "label").schema), allowMissingColumns=True)
    a = store.load_or_build(with_null, path, **P)
    assert a.n_new == emb.count() and store.load_or_build(emb, path, **P).how == "opened"
