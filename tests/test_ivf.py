import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import assert_same_ranking, ranked_dict
from nnspark.operators import exact, ivf, quality
from nnspark.session import scratch_path


@pytest.fixture(scope="module")
def index(emb):
    return ivf.build(emb, nlist=16, n_iter=3)


def test_sample_ids_follow_md5_order(emb):
    got = [r["id"] for r in ivf.sample_ids(emb, 37).orderBy("h", "id").collect()]
    ids = [r["vec_id"] for r in emb.select("vec_id").collect()]
    key = lambda i: (int(hashlib.md5(f"ivf:{i}".encode()).hexdigest()[:8], 16), i)
    assert got == sorted(ids, key=key)[:37]


def test_every_vector_in_one_list(index, emb):
    p = index.postings
    assert p.count() == emb.count()
    assert p.select("id").distinct().count() == emb.count()
    assert p.agg(F.min("list_id"), F.max("list_id")).first()[1] < index.nlist


def test_full_probe_equals_exact(index, emb):
    qs = exact.self_queries(emb)
    got = ranked_dict(ivf.search(index, qs, 10, index.nlist))
    want = ranked_dict(exact.exact_knn(emb, qs, 10))
    assert_same_ranking(got, want, tol=0.0)


def test_recall_non_decreasing_in_nprobe(index, emb):
    qs = exact.self_queries(emb)
    ex = exact.exact_knn(emb, qs, 10)
    prev = -1.0
    for p in (1, 4, 16):
        r = quality.mean_recall(quality.recall(ex, ivf.search(index, qs, 10, p).withColumn("nprobe", F.lit(p))),
                                ["nprobe"]).first()["recall"]
        assert 0.0 <= r <= 1.0 and r >= prev
        prev = r


def test_short_lists_give_fewer_rows_and_cost(index, emb):
    r = ivf.search(index, exact.self_queries(emb), 100, 1)
    row = r.agg(F.max("n_hits"), F.min("cost"), F.max("rank")).first()
    assert row[0] <= 100 and row[2] <= row[0]
    sizes = {x["list_id"]: x["size"] for x in index.list_sizes().collect()}
    assert row[1] >= min(sizes.values())


def test_save_open_reuse_equals_rebuild(spark, index, emb):
    path = scratch_path(spark, "ivf-index")
    index.save(path)
    again = ivf.IvfIndex.open(spark, path)
    qs = exact.self_queries(emb)
    assert_same_ranking(ranked_dict(ivf.search(again, qs, 5, 3)), ranked_dict(ivf.search(index, qs, 5, 3)), tol=0.0)


def test_training_is_deterministic(emb):
    a = ivf.train(emb, nlist=16, n_iter=2)
    b = ivf.train(emb.repartition(5), nlist=16, n_iter=2)
    assert (a == b).all()


def test_centroid_blocks_equal_single_broadcast(emb):
    # a budget below 16 x 64 doubles forces the blocked nearest-list path everywhere
    small = ivf.build(emb, nlist=16, n_iter=2, budget=3_000)
    big = ivf.build(emb, nlist=16, n_iter=2)
    assert (small.centroids == big.centroids).all()
    qs = exact.self_queries(emb)
    a = ranked_dict(ivf.search(small, qs, 5, 4, budget=3_000))
    b = ranked_dict(ivf.search(big, qs, 5, 4))
    assert_same_ranking(a, b, tol=0.0)


def test_training_rows_grow_with_the_lists_and_never_cut_them():
    assert ivf.train_rows(10**9, 10_000) == 640_000
    assert ivf.train_rows(10**9, 100) == 100_000
    assert ivf.train_rows(500, 89) == 500
    assert ivf.default_nlist(3) == 3
    with pytest.raises(ValueError):
        ivf.train_rows(10**6, 200, train_size=100)


def test_sample_vectors_are_the_first_in_md5_order(emb):
    want = {r["id"] for r in ivf.sample_ids(emb, 10**9).orderBy("h", "id").limit(123).collect()}
    got = [r["id"] for r in ivf.sample_vectors(emb, 123).collect()]
    assert len(got) == 123 and set(got) == want


def test_postings_of_a_hot_list_are_split(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 20 == 0, 1).otherwise(0).cast("int").alias("list_id"), "id",
        F.array(*[F.rand(i).cast("float") for i in range(8)]).alias("vec"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size)
    spark.conf.set(size, "200k")
    try:
        ivf.write_postings(rows, str(tmp_path / "p"), 2)
    finally:
        spark.conf.set(size, old)
    files = list((tmp_path / "p" / "list_bucket=0").glob("*.parquet"))
    assert len(files) > 2
    assert spark.read.parquet(str(tmp_path / "p")).agg(F.sum("id")).first()[0] == 60_000 * 59_999 // 2


def test_hits_that_leave_the_scan_follow_k_not_the_lists(spark, index, emb):
    from nnspark.operators import list_scan

    qs = exact.self_queries(emb).where("qv is not null")
    probes = qs.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(index.nlist - 1))).alias("list_id"))
    hits = list_scan.topk(index.postings.withColumn("tag", F.lit(0).cast("long")), qs, probes, 5, index.nlist)
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 2 * 5


def test_repeated_ids_keep_their_own_vectors(spark):
    rows = [(i // 2, [float(i % 7), float(i % 5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    qs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [6.0, 4.0]), (2, [6.0, 4.0])], "query_id long, qv array<float>")
    found = ivf.search(ivf.build(df, nlist=6, n_iter=2), qs, 9, 6, with_vectors=True).collect()
    assert len(found) == 18
    for r in found:
        q = [0.0, 0.0] if r["query_id"] == 1 else [6.0, 4.0]
        assert sum((a - b) ** 2 for a, b in zip(q, r["vec"])) == r["d2"]
    assert len({(r["id"], r["d2"]) for r in found if r["query_id"] == 2}) == 5   # a query that comes twice has its hits twice
