"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads whole driver tables (or tables Spark derives from them).
The search queries use every stored vector as a query (the kNN self-join), so
no id subset is involved; numeric outputs are rounded to 6 decimals so that
the SQL oracle and Spark agree regardless of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnspark import ship
from nnspark.operators import best_first, calibrate, compare, exact, forest, ivf, pruned, quality, quantiser

K_MAIN = 20
K_SWEEP = [5, 20, 50, 100]
NPROBES = [1, 10, 50]
IVF_ITER = 10
FOREST_TREES = 50
FOREST_MAX_LEAF = 32
FOREST_SEARCH_K = 400
SAMPLE_M = 256
DEC = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DEC)


# ---------------------------------------------------------------- exact

def exact_ranked(spark, sf_dir, k=K_MAIN, with_vectors=False) -> DataFrame:
    emb = corpus(spark, sf_dir)
    return exact.exact_knn(emb, exact.self_queries(emb), k, with_vectors=with_vectors)


def knn_exact_top20(spark, sf_dir):
    r = exact_ranked(spark, sf_dir)
    return r.select("query_id", "rank", "id", r6("dist").alias("dist"))


def knn_exact_pruned(spark, sf_dir):
    """Exact top-20 through groups and bounds, not by comparing all."""
    emb = corpus(spark, sf_dir)
    r = pruned.search(pruned.build(emb), exact.self_queries(emb), K_MAIN)
    return r.select("query_id", "rank", "id", r6("dist").alias("dist"))


def knn_sq_l2_top10(spark, sf_dir):
    r = exact_ranked(spark, sf_dir, 10)
    return r.select("query_id", "rank", "id", r6("d2").alias("d2"))


def knn_k_sweep_sums(spark, sf_dir):
    r = exact.k_sweep(exact_ranked(spark, sf_dir, max(K_SWEEP)), K_SWEEP)
    return compare.distance_sums(r, ["k"]).select(
        "k", "query_id", "n_hits", r6("sum_dist").alias("sum_dist")
    )


def knn_with_text(spark, sf_dir):
    r = exact_ranked(spark, sf_dir, 10)
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    n_queries = corpus(spark, sf_dir).count()
    out = exact.with_text(r, part, hits_bound=n_queries * 10)
    return out.select("query_id", "rank", "id", "text")


def result_spread(spark, sf_dir):
    r = exact_ranked(spark, sf_dir, K_MAIN, with_vectors=True)
    s = quality.spread(r)
    return s.select("query_id", r6("spread").alias("spread"), "n_hits")


def result_proportionality(spark, sf_dir):
    r = exact_ranked(spark, sf_dir, K_MAIN, with_vectors=True)
    p = quality.proportionality(r)
    return p.select("query_id", "rank", "id", r6("proportionality").alias("proportionality"))


# ---------------------------------------------------------------- IVF

def ivf_train_sample(spark, sf_dir):
    ids = ivf.sample_ids(corpus(spark, sf_dir), SAMPLE_M)
    return ids.select(F.col("id").alias("vec_id"), "h")


def ivf_lloyd_round(spark, sf_dir):
    """One round over centroids that are a table from the seeds to the result."""
    emb = corpus(spark, sf_dir)
    n = emb.where(F.col("embedding").isNotNull()).count()
    nlist = ivf.default_nlist(n)
    sample = ivf.sample_vectors(emb, ivf.train_rows(n, nlist))
    lists = quantiser.lloyd_round(sample.withColumn("cell", F.lit(0)), quantiser.seeds(sample, nlist))
    return lists.select("list_id", F.posexplode("centroid").alias("dim", "x")).select(
        "list_id", F.col("dim").cast("int"), r6("x").alias("x"))


_IVF_CACHE: dict = {}


def ivf_index(spark, sf_dir) -> ivf.IvfIndex:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _IVF_CACHE:
        emb = corpus(spark, sf_dir)
        _IVF_CACHE[key] = ivf.build(emb, n_iter=IVF_ITER)
    return _IVF_CACHE[key]


def ivf_assign_sizes(spark, sf_dir):
    idx = ivf_index(spark, sf_dir)
    return idx.list_sizes().select("list_id", F.col("size").cast("long").alias("size"))


def ivf_ranked(spark, sf_dir, nprobe, k=K_MAIN, with_vectors=False):
    emb = corpus(spark, sf_dir)
    return ivf.search(ivf_index(spark, sf_dir), exact.self_queries(emb), k, nprobe, with_vectors=with_vectors)


def ivf_search_nprobe10(spark, sf_dir):
    r = ivf_ranked(spark, sf_dir, 10)
    return r.select("query_id", "rank", "id", r6("dist").alias("dist"))


def ivf_recall_sweep(spark, sf_dir):
    ex = exact_ranked(spark, sf_dir)
    parts = [ivf_ranked(spark, sf_dir, p).withColumn("nprobe", F.lit(p)) for p in NPROBES]
    approx = parts[0]
    for p in parts[1:]:
        approx = approx.unionByName(p)
    rec = quality.recall(ex, approx.select("nprobe", "query_id", "rank", "id"), params=[{"nprobe": p} for p in NPROBES])
    return quality.mean_recall(rec, ["nprobe"]).select(
        "nprobe", r6("recall").alias("recall"), F.col("n_queries").cast("long").alias("n_queries")
    )


def ivf_candidate_cost(spark, sf_dir):
    emb = corpus(spark, sf_dir)
    idx = ivf_index(spark, sf_dir)
    qf = exact.self_queries(emb)
    sizes = idx.list_sizes()
    out = None
    for p in NPROBES:
        pr = ivf.probe_lists(qf, idx.centroids, p)
        c = pr.join(F.broadcast(sizes), "list_id").groupBy("query_id").agg(
            F.sum("size").cast("long").alias("cost")
        ).withColumn("nprobe", F.lit(p))
        out = c if out is None else out.unionByName(c)
    return out.select("nprobe", "query_id", "cost")


# ---------------------------------------------------------------- forest

_FOREST_CACHE: dict = {}


def forest_index(spark, sf_dir) -> forest.Forest:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOREST_CACHE:
        _FOREST_CACHE[key] = forest.build(corpus(spark, sf_dir), FOREST_TREES, FOREST_MAX_LEAF)
    return _FOREST_CACHE[key]


def forest_leaf_sizes(spark, sf_dir):
    f = forest_index(spark, sf_dir)
    return f.leaf_sizes().select("tree", "leaf", F.col("size").cast("long").alias("size"))


def forest_ranked(spark, sf_dir, k=K_MAIN, search_k=FOREST_SEARCH_K, with_vectors=False):
    emb = corpus(spark, sf_dir)
    return forest.search(forest_index(spark, sf_dir), exact.self_queries(emb), k, search_k, corpus=emb,
                         with_vectors=with_vectors)


def forest_search_budget(spark, sf_dir):
    r = forest_ranked(spark, sf_dir)
    return r.select("query_id", "rank", "id", r6("dist").alias("dist"), "cost")


def best_first_ranked(spark, sf_dir, search_k, k=K_MAIN):
    emb = corpus(spark, sf_dir)
    return best_first.search(forest_index(spark, sf_dir), exact.self_queries(emb), k, search_k, corpus=emb)


def forest_best_first(spark, sf_dir):
    r = best_first_ranked(spark, sf_dir, FOREST_SEARCH_K)
    return r.select("query_id", "rank", "id", r6("dist").alias("dist"), "cost")


RECALL_TARGET = 0.9


def _measured(spark, sf_dir, approx: DataFrame, budget: int) -> DataFrame:
    """Recall over every vector as a query, and mean cost, of a search at a calibrated budget."""
    rec = quality.recall(exact_ranked(spark, sf_dir), approx.select(F.lit(budget).alias("budget"), "query_id", "rank", "id"),
                         params=[{"budget": budget}])
    cost = approx.groupBy("query_id").agg(F.first("cost").alias("cost")).agg(
        F.lit(budget).alias("budget"), r6(F.avg("cost")).alias("mean_cost"))
    return quality.mean_recall(rec, ["budget"]).select(
        F.lit(RECALL_TARGET).alias("target"), "budget", r6("recall").alias("recall"),
        F.col("n_queries").cast("long").alias("n_queries")).join(cost, "budget")


def ivf_recall90(spark, sf_dir):
    idx = ivf_index(spark, sf_dir)
    nprobe = calibrate.budget_for(calibrate.ivf_curve(idx, corpus(spark, sf_dir), K_MAIN), RECALL_TARGET)
    return _measured(spark, sf_dir, ivf_ranked(spark, sf_dir, nprobe), nprobe)


def forest_recall90(spark, sf_dir):
    curve = calibrate.forest_curve(forest_index(spark, sf_dir), corpus(spark, sf_dir), K_MAIN, RECALL_TARGET)
    search_k = calibrate.budget_for(curve, RECALL_TARGET)
    return _measured(spark, sf_dir, best_first_ranked(spark, sf_dir, search_k), search_k)


# ---------------------------------------------------------------- comparison (J4, A1-A6, PV1, PV2, A9, A11, W2)

ALGOS = ["exact", "ivf", "forest"]
IVF_NPROBE = 10


def _labels(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("dataset")
    )


def compare_baseline_frame(spark, sf_dir) -> DataFrame:
    base = compare.metrics(exact_ranked(spark, sf_dir), "exact")
    cand = compare.metrics(ivf_ranked(spark, sf_dir, IVF_NPROBE), "ivf")
    return compare.compare_pair(base, cand)


def compare_baseline(spark, sf_dir):
    c = compare_baseline_frame(spark, sf_dir)
    return c.select(
        "query_id", r6("base_sum").alias("base_sum"), r6("cand_sum").alias("cand_sum"),
        r6("pct_diff").alias("pct_diff"), F.col("base_cost").cast("long").alias("base_cost"),
        F.col("cand_cost").cast("long").alias("cand_cost"), r6("speedup").alias("speedup"),
        F.col("cand_n_hits").cast("int").alias("cand_n_hits"),
    )


def compare_totals(spark, sf_dir):
    t = compare.totals(compare_baseline_frame(spark, sf_dir))
    return t.select(
        F.col("n_queries").cast("long").alias("n_queries"), r6("avg_pct_diff").alias("avg_pct_diff"),
        r6("avg_base_cost").alias("avg_base_cost"), r6("avg_cand_cost").alias("avg_cand_cost"),
        r6("mean_of_speedups").alias("mean_of_speedups"), r6("speedup_of_means").alias("speedup_of_means"),
    )


def sweep_long(spark, sf_dir, with_spread: bool = True) -> DataFrame:
    """Metrics of every method for every k from one top-max(k) pass each."""
    kmax = max(K_SWEEP)
    ranked = {
        "exact": exact_ranked(spark, sf_dir, kmax, with_vectors=with_spread),
        "ivf": ivf_ranked(spark, sf_dir, IVF_NPROBE, kmax, with_vectors=with_spread),
        "forest": forest_ranked(spark, sf_dir, kmax, FOREST_SEARCH_K, with_vectors=with_spread),
    }
    frames = []
    for algo, r in ranked.items():
        r, sp = quality.spread_sweep(r, K_SWEEP) if with_spread else (r, None)
        sw = exact.k_sweep(r, K_SWEEP)
        frames.append(compare.metrics(sw, algo, ["k"], sp))
    return compare.union_methods(frames).join(_labels(spark, sf_dir), "query_id")


def sweep_frame(spark, sf_dir) -> DataFrame:
    return compare.sweep_wide(sweep_long(spark, sf_dir), "exact", ALGOS)


def sweep_wide(spark, sf_dir, wide: DataFrame | None = None):
    """``wide``: a ``sweep_frame`` that is there already."""
    w = sweep_frame(spark, sf_dir) if wide is None else wide
    cols = []
    for f in w.schema.fields:
        if f.name in ("dataset", "k", "query_id"):
            cols.append(F.col(f.name))
        elif f.name.endswith("_cost"):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(r6(f.name).alias(f.name))
    return w.select(*cols)


def sweep_summary_stats(spark, sf_dir, wide: DataFrame | None = None):
    w = sweep_frame(spark, sf_dir) if wide is None else wide
    s = compare.summary_stats(w, "k", exclude=["dataset"])
    return s.select("k", "type", *[r6(c).alias(c) for c in s.columns if c not in ("k", "type")])


def cost_quartiles(spark, sf_dir):
    q = compare.cost_quartiles(sweep_long(spark, sf_dir, with_spread=False))
    return q.select("algo", "k", F.col("n").cast("long").alias("n"),
                    *[r6(c).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi", "min", "max"]])


def dataset_change_marker(spark, sf_dir):
    m = sweep_long(spark, sf_dir, with_spread=False).where(F.col("algo") == "exact")
    m = m.select("k", "query_id", "dataset", F.col("query_id").alias("query_ord"))
    out = compare.change_marker(m, "dataset", "k", "query_ord")
    return out.select("k", "query_id", "dataset", "marker")


# ---------------------------------------------------------------- text, queries, datasets

from nnspark.functions import text as T  # noqa: E402
from nnspark.operators import dataset, descent, embed, encoder, graph, layered, querygen  # noqa: E402
from nnspark.session import scratch_path  # noqa: E402
from nnspark.sources import keywords  # noqa: E402

# Vocabulary of the events table, in code order (class encoding P7).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
GRAPH_M = 16
GRAPH_EF = 50
TEXT_K = 5
ENCODER_DIM = 32


def keyword_lines(spark, sf_dir) -> DataFrame:
    """Keyword lines derived from whole tables: ``p_partkey p_name`` per part,
    and every line of every document (mostly not keyword lines)."""
    part = read(spark, sf_dir, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("key"), F.lit(0).alias("pos"),
        F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_name")).alias("line"),
    )
    docs = read(spark, sf_dir, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("key"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    )
    return part.unionByName(docs)


def parse_keyword_lines(spark, sf_dir):
    lines = keyword_lines(spark, sf_dir)
    tok, txt, kid = T.keyword_id_token("line"), T.keyword_text("line"), T.keyword_id("line")
    two = (tok != "") & (txt != "")
    status = F.when(two & kid.isNotNull(), "ok").when(two, "reject").otherwise("skip")
    ok = two & kid.isNotNull()
    return lines.select("src", "key", F.col("pos").cast("int").alias("pos"), status.alias("status"),
                        F.when(ok, kid).alias("id"), F.when(ok, txt).alias("text"))


def keep_last_text(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(
        F.col("p_size").alias("id"), F.col("p_name").alias("text"), F.col("p_partkey").alias("line_no")
    )
    return keywords.keep_last(part)


def distinct_first_seen(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_name").alias("value"), F.col("p_partkey").alias("ord"))
    return keywords.first_seen(part, "value", "ord").select("value", "ord", F.col("n").cast("long").alias("n"))


def expand_entity_queries(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"),
                                                  F.col("n_nationkey").cast("long").alias("ord"))
    part = read(spark, sf_dir, "part").select(F.col("p_name").alias("entity"),
                                              (F.lit(1 << 32) + F.col("p_partkey")).cast("long").alias("ord"))
    ents = keywords.first_seen(nation.unionByName(part).where(F.col("entity").isNotNull()), "entity", "ord")
    return querygen.expand(ents)


def corpus_shape(spark, sf_dir):
    emb = corpus(spark, sf_dir)
    dims = emb.where(F.col("embedding").isNotNull()).agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    return emb.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("embedding")).alias("dim_min"),
        F.max(F.size("embedding")).alias("dim_max"),
        F.countDistinct("label").alias("n_labels"),
        F.sum(F.when(F.col("embedding").isNull(), 1).otherwise(0)).cast("long").alias("n_null"),
        F.sum(F.when(F.size("embedding") == F.lit(dims), 1).otherwise(0)).cast("long").alias("n_width_ok"),
    ).select(F.col("n").cast("long"), F.col("dim_min").cast("int"), F.col("dim_max").cast("int"),
             F.col("n_labels").cast("long"), "n_null", "n_width_ok")


def _event_split_cols():
    return [F.col("user_id").cast("string"), F.col("event_type"),
            F.round(F.col("value") * 100).cast("long").cast("string"), F.col("props")]


def hash_split_85(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    flag = dataset.split_flag(*_event_split_cols())
    return ev.select("event_id", F.when(flag, "train").otherwise("test").alias("split"))


def class_codes(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        "event_type", dataset.class_code("event_type", EVENT_TYPES).alias("code"), F.col("n").cast("long")
    )


# ---------------------------------------------------------------- embedding

def embed_texts(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    w = part.select(F.col("p_partkey").alias("id"), embed.trigram_udf()(F.col("p_name")).alias("w"))
    return w.select("id", F.posexplode("w").alias("dim", "weight")).where(F.col("weight") > 0) \
        .select("id", F.col("dim").cast("int"), r6("weight").alias("weight"))


def text_query_search(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    corpus_t = embed.embed_texts(part.select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("text")))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"),
                                                  F.col("n_name").alias("query"))
    qs = embed.embed_queries(nation)
    r = exact.exact_knn(corpus_t, qs, TEXT_K)
    out = exact.with_text(r, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")),
                          hits_bound=nation.count() * TEXT_K)
    return out.select("query_id", "rank", "id", r6("dist").alias("dist"), "text")


def embed_documents(spark, sf_dir):
    """X1 with an encoder fitted on the documents, stored, opened and applied as a model over all of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "encoder")
    encoder.fit(docs, dim=ENCODER_DIM).save(spark, path)
    vectors = encoder.Encoder.open(spark, path).embed(docs)
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "x")).select("doc_id", "dim", r6("x").alias("x"))


# ---------------------------------------------------------------- graph

_GRAPH_CACHE: dict = {}


def graph_index(spark, sf_dir) -> graph.Graph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPH_CACHE:
        _GRAPH_CACHE[key] = graph.build(corpus(spark, sf_dir), GRAPH_M)
    return _GRAPH_CACHE[key]


def graph_knn_edges(spark, sf_dir):
    return graph.knn_edges(corpus(spark, sf_dir), GRAPH_M)


def graph_search_ef50(spark, sf_dir):
    emb = corpus(spark, sf_dir)
    r = graph.search(graph_index(spark, sf_dir), exact.self_queries(emb), K_MAIN, GRAPH_EF, corpus=emb)
    return r.select("query_id", "rank", "id", r6("dist").alias("dist"), "cost")


_LAYERED_CACHE: dict = {}
LAYERED_EF = 50


def layered_index(spark, sf_dir) -> layered.LayeredGraph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAYERED_CACHE:
        _LAYERED_CACHE[key] = layered.build(corpus(spark, sf_dir), GRAPH_M)
    return _LAYERED_CACHE[key]


def layered_ranked(spark, sf_dir, k=K_MAIN, ef=LAYERED_EF, with_vectors=False):
    return layered.search(layered_index(spark, sf_dir), exact.self_queries(corpus(spark, sf_dir)), k, ef, with_vectors=with_vectors)


def graph_levels(spark, sf_dir):
    return corpus(spark, sf_dir).select("vec_id", layered.level("vec_id", GRAPH_M).alias("level"))


def graph_layer_edges(spark, sf_dir):
    """Unoccluded edges of every layer, chosen from the exact nearest candidates: what the descent's edges approach."""
    nodes, _ = layered.distinct_vectors(corpus(spark, sf_dir))
    nodes = nodes.withColumn("level", layered.level("id", GRAPH_M))
    out = None
    for layer in range((nodes.agg(F.max("level")).first()[0] or 0) + 1):
        part = nodes.where(F.col("level") >= layer).select("id", "vec")
        near = exact.exact_knn(part, exact.self_queries(part, "id", "vec"), layered.CANDIDATES, id_col="id", vec_col="vec",
                               exclude_self=True).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "d2")
        edges, _ = layered.layer_edges(part, GRAPH_M, near)
        edges = edges.select(F.lit(layer).alias("layer"), "src", "dst", r6("d2").alias("d2"))
        out = edges if out is None else out.unionByName(edges)
    return out


def graph_descent_recall(spark, sf_dir):
    """Share of all exact edges (16 nearest of every vector) that neighbour descent finds, and the distances it computed."""
    emb = corpus(spark, sf_dir)
    found = descent.neighbour_lists(exact.corpus_frame(emb), layered.CANDIDATES)
    near = exact.exact_knn(emb, exact.self_queries(emb), GRAPH_M, exclude_self=True).select(
        F.col("query_id").alias("src"), F.col("id").alias("dst"))
    hit = near.join(found.lists.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_edges"), r6(F.avg(F.coalesce("hit", F.lit(0)))).alias("recall"),
                   F.lit(found.evaluations).cast("long").alias("n_evaluations"))


def graph_layered_search(spark, sf_dir):
    r = layered_ranked(spark, sf_dir)
    return r.select("query_id", "rank", "id", r6("dist").alias("dist"), "cost")


def graph_layered_recall(spark, sf_dir):
    """Mean recall@20 of the layered search over every vector as a query, and the share of the vectors it scores."""
    approx = layered_ranked(spark, sf_dir)
    n = corpus(spark, sf_dir).where(F.col("embedding").isNotNull()).count()
    rec = quality.recall(exact_ranked(spark, sf_dir), approx.select(F.lit(LAYERED_EF).alias("ef"), "query_id", "rank", "id"),
                         params=[{"ef": LAYERED_EF}])
    cost = approx.groupBy("query_id").agg(F.first("cost").alias("cost")).agg(F.avg("cost").alias("mean_cost"))
    rows = quality.mean_recall(rec, ["ef"]).select("ef", r6("recall").alias("recall"), F.col("n_queries").cast("long").alias("n_queries"))
    share = cost.select(F.lit(LAYERED_EF).alias("ef"), r6("mean_cost").alias("mean_cost"),
                        r6(F.col("mean_cost") / F.lit(float(max(n, 1)))).alias("cost_share"))
    return rows.join(share, "ef")


def compare_layered(spark, sf_dir):
    """J4 with the layered graph as the candidate method."""
    base = compare.metrics(exact_ranked(spark, sf_dir), "exact")
    c = compare.compare_pair(base, compare.metrics(layered_ranked(spark, sf_dir), "layered"))
    return c.select("query_id", r6("base_sum").alias("base_sum"), r6("cand_sum").alias("cand_sum"), r6("pct_diff").alias("pct_diff"),
                    F.col("base_cost").cast("long").alias("base_cost"), F.col("cand_cost").cast("long").alias("cand_cost"),
                    r6("speedup").alias("speedup"), F.col("cand_n_hits").cast("int").alias("cand_n_hits"))


# ---------------------------------------------------------------- registry

def registry_sweep(spark, sf_dir):
    """Methods by name through the registry's sweep, one search each for both k."""
    from nnspark.plans import registry

    emb = corpus(spark, sf_dir)
    plan = {"exact": {}, "ivf": {"index": ivf_index(spark, sf_dir), "nprobe": IVF_NPROBE}}
    r = registry.sweep(emb, exact.self_queries(emb), [5, K_MAIN], plan, with_spread=False)
    return r.select("algo", F.col("k").cast("int").alias("k"), "query_id", F.col("n_hits").cast("int").alias("n_hits"),
                    r6("sum_dist").alias("sum_dist"))
