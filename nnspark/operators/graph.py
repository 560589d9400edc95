"""Neighbour-graph search (J10), our re-aim of the hierarchical graph index.

Edges: each vector's M nearest other vectors (exact, from the kNN
self-join), made symmetric.  Search: batched beam search as DataFrame rounds.
Every query starts from a few md5-chosen entry vectors; each round the
neighbours of the query's current best ``ef`` vectors that it has not yet
visited are scored, visited grows, and the best ``ef`` are re-selected by
(distance, id).  A query's rounds stop when its best set has no vector that was
not expanded; there is no limit on rounds.  Edges are a table bucketed on src,
and vectors are dealt into blocks (see ``beam``), so no vector is shuffled for a
pair.  Each round's state is written to the checkpoint folder, so the lineage
stays one round deep and a lost executor recomputes one round.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.functions.distance import safe_sqrt
from nnspark.operators import beam, exact
from nnspark.operators.exact import corpus_frame
from nnspark.operators.ivf import sample_ids
from nnspark.operators.gather import DEFAULT_BROADCAST_BYTES, measure
from nnspark.operators.kernels import list_matrix
from nnspark.session import scratch_path

DEFAULT_M = 16
DEFAULT_EF = 50
DEFAULT_ENTRIES = 8
DEFAULT_BUCKETS = 0   # 0: as many buckets as spark.sql.shuffle.partitions
META = "entries array<long>, m int, buckets int, n_edges long, n_vectors long, dim int, has_vectors boolean"


@dataclass
class Graph:
    edges: DataFrame      # src, dst (symmetric), bucketed by src
    entries: list[int]
    m: int
    vectors: DataFrame | None = None   # id, vec, bucketed by id (same bucket count)
    n_edges: int = -1                  # measured at build; -1 = unknown
    n_vectors: int = -1
    dim: int = 0

    def save(self, path: str) -> None:
        """Edges and vectors as Parquet bucketed on their join keys, entry points and sizes beside them."""
        spark = self.edges.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        _bucketed_table(self.edges, "src", buckets, "graph_edges", f"{path}/edges")
        if self.vectors is not None:
            _bucketed_table(self.vectors, "id", buckets, "graph_vectors", f"{path}/vectors")
        meta = (self.entries, self.m, buckets, self.n_edges, self.n_vectors, self.dim, self.vectors is not None)
        spark.createDataFrame([meta], META).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def open(cls, spark, path: str, corpus: DataFrame | None = None, id_col: str = "vec_id",
             vec_col: str = "embedding") -> "Graph":
        """The saved graph; nothing is written but, where it was saved without vectors, those of ``corpus``."""
        meta = spark.read.parquet(f"{path}/meta").first()
        edges = _attach(spark, f"{path}/edges", "src", meta["buckets"], "graph_edges")
        if meta["has_vectors"]:
            vectors = _attach(spark, f"{path}/vectors", "id", meta["buckets"], "graph_vectors")
        elif corpus is not None:
            vectors = _bucketed_table(corpus_frame(corpus, id_col, vec_col), "id", meta["buckets"], "graph_vectors")
        else:
            vectors = None
        return cls(edges, list(meta["entries"]), meta["m"], vectors, meta["n_edges"], meta["n_vectors"], meta["dim"])

def _bucketed_table(df: DataFrame, key: str, buckets: int, prefix: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key`` (in the checkpoint folder
    unless ``path`` is given), so later joins on ``key`` shuffle only the other side."""
    spark = df.sparkSession
    name = f"nn_{prefix}_{uuid.uuid4().hex[:12]}"
    # hash-partition on the key first (same hash as bucketing): one file per bucket
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) \
        .option("path", path or scratch_path(spark, prefix)).saveAsTable(name)
    return spark.table(name)


def _attach(spark, path: str, key: str, buckets: int, prefix: str) -> DataFrame:
    """A bucketed table over files that ``_bucketed_table`` wrote: a catalogue entry, no data is moved."""
    name = f"nn_{prefix}_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f"`{c}` {kind}" for c, kind in spark.read.parquet(path).dtypes)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def knn_edges(corpus: DataFrame, m: int = DEFAULT_M, id_col: str = "vec_id", vec_col: str = "embedding",
              ivf_index=None, nprobe: int = 10) -> DataFrame:
    """Directed kNN edges (src, dst, rank): the m nearest other vectors.

    Exact by default (quadratic: fine for bounded corpora, and what the oracle
    checks).  For large corpora pass an IVF index: every vector then probes
    only its ``nprobe`` nearest lists (the IVF-blocked kNN graph).
    """
    qs = exact.self_queries(corpus, id_col, vec_col)
    if ivf_index is not None:
        from nnspark.operators import ivf

        r = ivf.search(ivf_index, qs, m, nprobe, exclude_self=True)
    else:
        r = exact.exact_knn(corpus, qs, m, id_col=id_col, vec_col=vec_col, exclude_self=True)
    return r.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "rank")


def build(corpus: DataFrame, m: int = DEFAULT_M, n_entries: int = DEFAULT_ENTRIES, seed: str = "graph",
          id_col: str = "vec_id", vec_col: str = "embedding", buckets: int = DEFAULT_BUCKETS,
          ivf_index=None, nprobe: int = 10) -> Graph:
    if not buckets:
        buckets = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = knn_edges(corpus, m, id_col, vec_col, ivf_index, nprobe).select("src", "dst")
    sym = d.unionByName(d.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    edges = _bucketed_table(sym, "src", buckets, "graph_edges")
    vectors = _bucketed_table(corpus_frame(corpus, id_col, vec_col), "id", buckets, "graph_vectors")
    entries = [int(r["id"]) for r in sample_ids(corpus, n_entries, seed, id_col).collect()]
    n_vec, dim = measure(vectors, "vec")
    return Graph(edges, entries, m, vectors, edges.count(), n_vec, dim)


def search(graph: Graph, queries: DataFrame, k: int, ef: int = DEFAULT_EF, *, corpus: DataFrame,
           id_col: str = "vec_id", vec_col: str = "embedding", query_id_col: str = "query_id",
           query_vec_col: str = "qv", with_vectors: bool = False,
           budget: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Beam search with beam width ``ef``; returns the ranked-result contract
    with cost = number of distinct vectors scored for the query.

    Each round expands every vector of a beam that was not expanded before
    (see ``beam``).  A query leaves the rounds when its beam has none; as a
    pair is scored once, that comes for every graph.  ``budget`` bounds the
    block of vectors that a task holds.  Of rows with one query id the least
    vector is searched.  ``with_vectors`` joins the vectors of the ranked hits alone.
    """
    ef = max(ef, k)
    vecs = graph.vectors if graph.vectors is not None else corpus_frame(corpus, id_col, vec_col)
    qf = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).cast("array<double>").alias("qv")) \
        .where(F.col("qv").isNotNull() & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("qv").alias("qv"))
    entry = vecs.where(F.col("id").isin(graph.entries)).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").toArrow()
    if not entry.num_rows:
        qf, E = qf.limit(0), np.zeros((0, 0))
    else:
        E = list_matrix(entry.column("vec"))
    buckets = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    lists = _bucketed_table(graph.edges.groupBy("src").agg(F.collect_list("dst").alias("dsts")), "src", buckets, "graph_lists")
    size = (graph.n_vectors, graph.dim) if graph.n_vectors >= 0 else measure(vecs, "vec")
    # the neighbours of a vector that was expanded are all scored, so only the open ones are looked at
    best = beam.search(qf, entry.column("id").to_numpy(), E, [lists], vecs, *size, ef, ef, ef, budget)
    near = F.slice(F.arrays_zip("ids", "d2"), 1, k)
    ranked = best.select("query_id", F.posexplode(near).alias("pos", "h"), "cost",
                         F.size(near).alias("n_hits"))
    ranked = ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("h.ids").alias("id"), safe_sqrt("h.d2").alias("dist"),
                           F.col("h.d2").alias("d2"), "cost", "n_hits")
    return ranked.join(vecs, "id").select(*ranked.columns, "vec") if with_vectors else ranked
