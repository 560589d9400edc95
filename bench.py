"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query runs its whole plan into the ``noop`` sink
(nothing collected).  Index builds are timed separately from searches, as
the reference times searches against stored indexes.  Besides wall time, the
mean number of distance evaluations per query (``cost``) of each search is
reported, which is the hardware-independent comparison with the baseline.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from nnspark.operators import exact  # noqa: E402
from nnspark.plans import catalog as C  # noqa: E402
from nnspark.session import local_session  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="nnspark-bench")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    times: dict[str, float] = {}
    costs: dict[str, float] = {}

    # warm-up: start the Python workers outside the timings
    emb = C.corpus(spark, sf_dir)
    run(exact.exact_knn(emb.limit(10), exact.self_queries(emb.limit(2)), 1))

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    def search(name, make):
        holder = {}

        def go():
            holder["df"] = make()
            run(holder["df"])

        timed(name, go)
        df = holder["df"]
        if "cost" in df.columns:
            costs[name] = round(float(df.groupBy("query_id").agg(F.first("cost").alias("c"))
                                      .agg(F.avg("c")).first()[0] or 0.0), 2)

    search("knn_exact_top20", lambda: C.exact_ranked(spark, sf_dir))
    timed("ivf_build", lambda: C.ivf_index(spark, sf_dir).postings.count())
    search("ivf_search_nprobe10", lambda: C.ivf_ranked(spark, sf_dir, 10))
    timed("forest_build", lambda: C.forest_index(spark, sf_dir))
    search("forest_search_budget", lambda: C.forest_ranked(spark, sf_dir))
    timed("graph_build", lambda: C.graph_index(spark, sf_dir))
    search("graph_search_ef50", lambda: C.graph_search_ef50(spark, sf_dir))
    timed("result_spread", lambda: run(C.result_spread(spark, sf_dir)))
    timed("compare_baseline", lambda: run(C.compare_baseline(spark, sf_dir)))
    timed("knn_k_sweep_sums", lambda: run(C.knn_k_sweep_sums(spark, sf_dir)))
    timed("text_query_search", lambda: run(C.text_query_search(spark, sf_dir)))

    # scale point: a generated corpus (bench only; never used by queries()).
    # 52 queries as in the reference's query set, exact top-20 over N vectors.
    n_syn = int(os.environ.get("BENCH_SYNTH_N", "500000"))
    dim = 64
    if n_syn > 0:
        from nnspark.session import scratch_path

        vals = [((F.xxhash64(F.col("id"), F.lit(j)) % 2000) / 1000.0 - 1.0).cast("float") for j in range(dim)]
        syn_path = scratch_path(spark, "bench-synth")
        spark.range(n_syn).select(F.col("id").alias("vec_id"), F.array(*vals).alias("embedding")) \
            .write.parquet(syn_path)
        syn = spark.read.parquet(syn_path)
        q52 = syn.where(F.col("vec_id") < 52).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
        timed("exact_synthetic_top20", lambda: run(exact.exact_knn(syn, q52, 20)))
        t = times["exact_synthetic_top20"]
        scale = {"n_vectors": n_syn, "dim": dim, "n_queries": 52,
                 "ms_per_query": round(1000 * t / 52, 3),
                 "distance_dims_per_sec": round(52 * n_syn * dim / t, 1),
                 "baseline_exact_distance_dims_per_sec": round(2927026 * 384 / 0.279831, 1)}
    else:
        scale = {}

    n_queries = emb.count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "mean_cost_per_query": costs,
        "scale_point": scale,
        "n_queries": n_queries,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
