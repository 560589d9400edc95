"""Layered neighbour graph (J10): levels, occlusion-pruned edges, greedy descent and a beam search.

Every distinct vector has a level, geometrically distributed and taken from a hash of its id; layer l holds the
vectors of level l and above.  In each layer a vector's edges are chosen from its nearest candidates (neighbour
descent, or any given table): a candidate that lies nearer to a chosen neighbour than to the vector itself is occluded
by it.  Edges count in both directions, and a vector keeps at most 2 m of them, so no vector is a hub.  Equal vectors are
one node, whose smallest id stands for all; otherwise a crowded vector would fill every list with its copies.

Search: queries descend from the top layer, where they expand the ``reach`` nearest vectors of a layer, and end with a
beam of width ``ef`` in layer 0.  A round expands up to ``width`` vectors per query (see ``beam``).  Edges are bucketed
tables and vectors are dealt into blocks, so a round shuffles the frontier, the queries and the blocks, never a vector per
pair.  Nothing is broadcast but the top layer's few entry vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nnspark.functions.distance import safe_sqrt
from nnspark.functions.hashing import md5_uniform
from nnspark.operators import beam, descent
from nnspark.operators.descent import _written
from nnspark.operators.exact import corpus_frame
from nnspark.operators.gather import measure
from nnspark.operators.graph import _attach, _bucketed_table
from nnspark.operators.kernels import _MAX_BLOCK_CELLS, list_matrix, ltr_sq_dist

DEFAULT_M = 16
DEFAULT_EF = 50
DEFAULT_WIDTH = 8
CANDIDATES = 24       # nearest candidates an edge is chosen from
REACH = 2             # vectors of a beam that the upper layers expand
MAX_ENTRIES = 8
HUB_FACTOR = 4        # nearest edges, as a multiple of m, that a vector's final ones are chosen from
META = "m int, layers int, buckets int"


def level(id_col: str = "id", m: int = DEFAULT_M, seed: str = "layer") -> Column:
    """floor(-log(u) / log(m)) of a uniform value u in (0, 1] from the id's hash."""
    u = F.lit(1.0) - md5_uniform(F.lit(seed), F.col(id_col))
    return F.floor(-F.log(u) / F.lit(math.log(max(m, 2)))).cast("int")


def distinct_vectors(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(nodes: id, vec; members: node, id).  A node is a distinct vector under the smallest id that has it."""
    frame = corpus_frame(corpus, id_col, vec_col).where(F.col("id").isNotNull())
    nodes = _written(frame.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "layered-nodes")
    members = frame.join(nodes.select(F.col("id").alias("node"), "vec"), "vec").select("node", "id")
    return nodes, members


def _keep_unoccluded(d2: np.ndarray, X: np.ndarray, m: int, fill: bool) -> list[int]:
    """Positions kept of candidates sorted by distance ``d2`` to a vector; ``fill`` tops up with the nearest others."""
    kept: list[int] = []
    for i in range(len(d2)):
        if len(kept) >= m:
            break
        if not kept or (ltr_sq_dist(X[kept], X[i][None, :]) > d2[i]).all():
            kept.append(i)
    if fill and len(kept) < m:
        chosen = set(kept)
        kept += [i for i in range(len(d2)) if i not in chosen][:m - len(kept)]
    return kept


def _keep_in_rows(d2: np.ndarray, X: np.ndarray, m: int, fill: bool) -> np.ndarray:
    """``_keep_unoccluded`` of many vectors at once: a row of candidates each, their distances NaN after the last."""
    XT = np.ascontiguousarray(np.moveaxis(X, 2, 0))
    D = np.zeros((*d2.shape, d2.shape[1]))
    for x in XT:
        diff = x[:, :, None] - x[:, None, :]
        D += diff * diff
    there, kept = ~np.isnan(d2), np.zeros(d2.shape, bool)
    for i in range(d2.shape[1]):
        occluded = (kept[:, :i] & ~(D[:, :i, i] > d2[:, i, None])).any(axis=1)
        kept[:, i] = there[:, i] & ~occluded & (kept.sum(axis=1) < m)
    if fill:
        more = there & ~kept
        kept |= more & (np.cumsum(more, axis=1) <= m - kept.sum(axis=1)[:, None])
    return kept


def _occlusion(m: int, fill: bool):
    def run(batches):
        for rb in batches:
            lists = rb.column("near")
            rows, n = lists.flatten(), lists.value_lengths().to_numpy()
            if not len(rows):
                continue
            src, dst, d2 = rb.column("src").to_numpy(), rows.field("dst").to_numpy(), rows.field("d2").to_numpy()
            X, starts = list_matrix(rows.field("vec")), np.cumsum(n) - n
            step = max(1, _MAX_BLOCK_CELLS // int(n.max() * max(n.max(), X.shape[1])))
            for lo in range(0, len(n), step):
                size = n[lo:lo + step]
                cell = np.arange(int(size.max()))[None, :]
                at = np.minimum(starts[lo:lo + step, None] + cell, len(d2) - 1)
                kept = _keep_in_rows(np.where(cell < size[:, None], d2[at], np.nan), X[at], m, fill)
                row, c = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (src[lo:lo + step][row], dst[at[row, c]], d2[at[row, c]])],
                                                 names=["src", "dst", "d2"])
    return run


def occlude(candidates: DataFrame, nodes: DataFrame, m: int, fill: bool = False) -> DataFrame:
    """At most ``m`` of each vector's candidates (src, dst, d2), nearest first, none occluded by one chosen before it.

    A candidate is occluded if a chosen one is as near to it as the vector is, or nearer.  Candidates per vector are
    bounded by the caller.
    """
    near = candidates.join(nodes.select(F.col("id").alias("dst"), "vec"), "dst").groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("d2", "dst", "vec"))).alias("near"))
    return near.mapInArrow(_occlusion(m, fill), descent.LISTS)


def symmetric(edges: DataFrame, nodes: DataFrame, m: int) -> DataFrame:
    """Edges in both directions, at most 2 m a vector: where there are more, the unoccluded of the nearest, then the nearest."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")).distinct()
    nearest = Window.partitionBy("src").orderBy("d2", "dst")
    both = _written(both.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= HUB_FACTOR * m), "layered-both")
    crowded = both.groupBy("src").agg(F.max("r").alias("n")).where(F.col("n") > 2 * m).select("src")
    few = both.join(crowded, "src", "left_anti").select("src", "dst", "d2")
    many = occlude(both.join(crowded, "src", "left_semi").select("src", "dst", "d2"), nodes, 2 * m, fill=True)
    return few.unionByName(many)


@dataclass
class LayeredGraph:
    edges: list[DataFrame]    # per layer: src, dsts (array), bucketed by src
    vectors: DataFrame        # id, vec, bucketed by id
    members: DataFrame        # node, id: every row of the corpus under its node
    entries: DataFrame        # id, vec: a few vectors of the top layer
    m: int
    buckets: int
    evaluations: int = 0      # distances that the descent computed

    def save(self, path: str) -> None:
        """Bucketed edges and vectors, members, entries, and the shape beside them."""
        spark = self.vectors.sparkSession
        for i, e in enumerate(self.edges):
            _bucketed_table(e, "src", self.buckets, "layered_edges", f"{path}/edges-{i}")
        _bucketed_table(self.vectors, "id", self.buckets, "layered_vectors", f"{path}/vectors")
        self.members.write.mode("overwrite").parquet(f"{path}/members")
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        spark.createDataFrame([(self.m, len(self.edges), self.buckets)], META).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LayeredGraph:
        """The saved graph: its buckets are attached, nothing is written."""
        meta = spark.read.parquet(f"{path}/meta").first()
        edges = [_attach(spark, f"{path}/edges-{i}", "src", meta["buckets"], "layered_edges") for i in range(meta["layers"])]
        vectors = _attach(spark, f"{path}/vectors", "id", meta["buckets"], "layered_vectors")
        return cls(edges, vectors, spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/entries"),
                   meta["m"], meta["buckets"])


def layer_edges(nodes: DataFrame, m: int = DEFAULT_M, candidates: DataFrame | None = None,
                n_candidates: int = CANDIDATES) -> tuple[DataFrame, int]:
    """(unoccluded directed edges src, dst, d2 of one layer's nodes, distances computed to find their candidates)."""
    taken = 0
    if candidates is None:
        found = descent.neighbour_lists(nodes, n_candidates)
        candidates, taken = found.lists, found.evaluations
    return occlude(candidates, nodes, m), taken


def build(corpus: DataFrame, m: int = DEFAULT_M, id_col: str = "vec_id", vec_col: str = "embedding",
          buckets: int = 0, n_candidates: int = CANDIDATES, seed: str = "layer") -> LayeredGraph:
    """The layered graph of ``corpus``.  Rows without an id or a vector take no part."""
    spark = corpus.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    nodes, members = distinct_vectors(corpus, id_col, vec_col)
    levelled = _written(nodes.withColumn("level", level("id", m, seed)), "layered-levels")
    top = levelled.agg(F.max("level")).first()[0] or 0
    edges, evaluations = [], 0
    for layer in range(top + 1):
        part = levelled.where(F.col("level") >= layer).select("id", "vec")
        directed, taken = layer_edges(part, m, n_candidates=n_candidates)
        evaluations += taken
        final = symmetric(_written(directed, "layered-directed"), part, m).groupBy("src").agg(
            F.sort_array(F.collect_list("dst")).alias("dsts"))
        edges.append(_bucketed_table(final, "src", buckets, "layered_edges"))
    vectors = _bucketed_table(nodes, "id", buckets, "layered_vectors")
    entries = _written(levelled.where(F.col("level") == top).orderBy("id").limit(MAX_ENTRIES).select("id", "vec"), "layered-entries")
    return LayeredGraph(edges, vectors, _written(members, "layered-members"), entries, m, buckets, evaluations)


def search(graph: LayeredGraph, queries: DataFrame, k: int, ef: int = DEFAULT_EF, *, width: int = DEFAULT_WIDTH,
           query_id_col: str = "query_id", query_vec_col: str = "qv", with_vectors: bool = False) -> DataFrame:
    """The ranked-result contract; cost is the number of distinct vectors scored for the query.

    Ids of equal vectors follow each other by id.  Null queries are dropped; query ids are distinct.
    """
    ef = max(ef, k)
    qf = queries.select(F.col(query_id_col).cast("long").alias("query_id"),
                        F.col(query_vec_col).cast("array<double>").alias("qv")).where(F.col("qv").isNotNull())
    entry = graph.entries.orderBy("id").toArrow()
    if not entry.num_rows:
        return _no_hits(qf, graph, with_vectors)
    entry_ids, E = entry.column("id").to_numpy(), list_matrix(entry.column("vec"))
    found = beam.search(qf, entry_ids, E, graph.edges[::-1], graph.vectors, *measure(graph.vectors, "vec"), ef, width, REACH)
    hits = found.select("query_id", "cost", F.explode(F.slice(F.arrays_zip("ids", "d2"), 1, k)).alias("h")).select(
        "query_id", "cost", F.col("h.ids").alias("node"), F.col("h.d2").alias("d2"))
    copies = Window.partitionBy("node").orderBy("id")
    members = graph.members.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k).select("node", "id")
    ranked = Window.partitionBy("query_id").orderBy("d2", "id")
    out = hits.join(members, "node").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    out = out.withColumn("n_hits", F.count(F.lit(1)).over(Window.partitionBy("query_id")).cast("int"))
    if with_vectors:
        out = out.join(graph.vectors.select(F.col("id").alias("node"), "vec"), "node")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "id", safe_sqrt("d2").alias("dist"), "d2", "cost",
                      "n_hits", *(["vec"] if with_vectors else []))


def _no_hits(qf: DataFrame, graph: LayeredGraph, with_vectors: bool) -> DataFrame:
    out = qf.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("dist"),
                             F.lit(0.0).alias("d2"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("n_hits"))
    return out.withColumn("vec", F.lit(None).cast(graph.vectors.schema["vec"].dataType)) if with_vectors else out
