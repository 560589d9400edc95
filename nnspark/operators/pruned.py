"""Exact search that skips what the triangle inequality rules out.

Vectors are grouped by their nearest centroid and keep their distance to it.  A first pass over the few nearest groups
gives each query an upper bound of its k-th distance.  The second pass compares a query only with groups whose nearest
possible member is within that bound, and in a group only with vectors whose distance to the centroid differs from
the query's by no more than it (where that is most pairs of a block of queries, with all of them).  The rows are those of
``exact.exact_knn``; ``cost`` counts the distances computed per query (to vectors; those to the centroids, one per
group and task, come on top).

How much is skipped depends on the data: clustered vectors leave a few groups, uniform directions in many dimensions
leave nearly all.  Both passes are ``list_scan``: which groups a query needs is told in its task, so there is no table of
queries x groups and none of pairs.  Centroids and rings, about 4 sqrt(N) rows, are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nnspark.operators import ivf, list_scan, quantiser
from nnspark.operators.descent import _written
from nnspark.operators.exact import corpus_frame, finish_topk_with_cost
from nnspark.operators.kernels import list_matrix

FIRST_PASS = 4        # members the first pass looks at, as a multiple of k
SLACK = 1e-6          # relative, for the rounding of distances


@dataclass
class Groups:
    lists: DataFrame      # cell (0), list_id, centroid
    members: DataFrame    # list_id, id, vec, away (distance to the centroid); clustered by list
    rings: DataFrame      # list_id, size, nearest, farthest


def build(corpus: DataFrame, nlist: int | None = None, n_iter: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> Groups:
    vectors = corpus_frame(corpus, id_col, vec_col)
    n = vectors.count()
    nlist = nlist or ivf.default_nlist(n)
    sample = _written(ivf.sample_vectors(corpus, ivf.train_rows(n, nlist), "pruned", id_col, vec_col), "pruned-sample")
    lists = _written(quantiser.seeds(sample, nlist), "pruned-lists")
    lists = quantiser.lloyd(sample.withColumn("cell", F.lit(0)), lists, n_iter)
    placed = quantiser.nearest_lists(vectors.withColumn("cell", F.lit(0)), lists, 1).select(
        "list_id", "id", "vec", F.sqrt("d2").alias("away"))
    members = _written(placed.hint("rebalance", F.col("list_id")).sortWithinPartitions("list_id"), "pruned-members")
    rings = members.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"), F.min("away").alias("nearest"), F.max("away").alias("farthest"))
    return Groups(lists, members, _written(rings, "pruned-rings"))


def _rings(groups: Groups) -> tuple[list_scan.Rings, np.ndarray]:
    """The groups that have members, and their sizes."""
    t = groups.lists.select("list_id", "centroid").join(groups.rings, "list_id").orderBy("list_id").toArrow()
    columns = [t.column(c).to_numpy() for c in ("list_id", "nearest", "farthest", "size")]
    return list_scan.Rings(columns[0], list_matrix(t.column("centroid")), columns[1], columns[2]), columns[3]


def _first_lists(queries: DataFrame, rings: list_scan.Rings, sizes: np.ndarray, want: int) -> DataFrame:
    """(query_id, qv, lists): of every query, its nearest groups until those before have ``want`` members."""
    shared = queries.sparkSession.sparkContext.broadcast((rings, sizes))

    def run(batches):
        rings, sizes = shared.value
        step = max(1, list_scan.PAIR_CELLS // max(len(sizes), 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                rb = whole.slice(lo, step)
                Q, d2 = list_matrix(rb.column("qv")), np.zeros((rb.num_rows, len(sizes)))
                for j in range(Q.shape[1] if len(sizes) else 0):
                    d2 += (Q[:, j, None] - rings.centroids[None, :, j]) ** 2
                order = np.argsort(d2, axis=1, kind="stable")
                size = sizes[order]
                taken = (np.cumsum(size, axis=1) - size < want).sum(axis=1)
                rows, at = np.nonzero(np.arange(len(sizes))[None, :] < taken[:, None])
                offsets = pa.array(np.append(0, np.cumsum(taken)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(rings.list_ids[order[rows, at]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rb.column("query_id"), rb.column("qv"), lists], names=["query_id", "qv", "lists"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))


def search(groups: Groups, queries: DataFrame, k: int, *, query_id_col: str = "query_id", query_vec_col: str = "qv",
           exclude_self: bool = False) -> DataFrame:
    """The ranked-result contract, equal to exact search.  Null queries are dropped."""
    qf = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).alias("qv")).where(F.col("qv").isNotNull())
    rings, sizes = _rings(groups)
    n_first = FIRST_PASS * k // max(1, int(sizes.mean()) if len(sizes) else 1) + 1
    first = _written(_first_lists(qf, rings, sizes, FIRST_PASS * k), "pruned-first")
    members = groups.members.select("list_id", "id", F.lit(0).cast("long").alias("tag"), "away", "vec")
    hits = _written(list_scan.scan(members, first.withColumn("bound", F.lit(float("inf"))), k, n_first, exclude_self, counted=True),
                    "pruned-hits")
    is_hit = F.col("tag") != list_scan.EVALUATED
    kth = hits.where(is_hit).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))).where(F.col("r") == k)
    bounds = kth.select("query_id", (F.sqrt("d2") * (1 + SLACK) + SLACK).alias("bound"))
    rest = first.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    scored = hits.unionByName(_written(list_scan.scan(members, rest, k, n_first, exclude_self, rings, True), "pruned-hits"))
    cost = scored.where(~is_hit).groupBy("query_id").agg(F.sum("id").alias("cost"))
    return finish_topk_with_cost(scored.where(is_hit).select("query_id", "id", "d2"), k, cost, small_cost=False)
