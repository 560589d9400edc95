"""A coarse quantiser held as tables: a k-means tree of cells and lists.

The flat quantiser of ``ivf`` keeps its centroids on the driver.  Here centroids are rows of a written table from the
seeds to the search, and nothing of their number reaches the driver: about sqrt(nlist) cells, and in each cell its
share of the lists.  A vector is compared with the cells and with the lists of its cell, 2 sqrt(nlist) distances
instead of nlist.

Every comparison is one step: vectors and centroids carry a cell; a cell's vectors are cut by hash into groups of
``GROUP_BYTES``, its centroids are copied to each group, and the two meet in a cogroup.  A crowded cell is thus many
groups.  Flat k-means is the same step with a single cell.  A Lloyd round adds partial sums per group, list and
dimension, and a left join keeps the centroid of a list without members.

Coordinates keep ``CENTROID_DECIMALS`` decimals after every round and seeds follow md5 order, so training gives the
same tables under any partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nnspark.operators import ivf
from nnspark.operators.descent import _written
from nnspark.operators.exact import corpus_frame
from nnspark.operators.ivf import CENTROID_DECIMALS, DEFAULT_LIST_BUCKETS
from nnspark.operators.kernels import list_matrix, nearest_rows
from nnspark.session import scratch_path

GROUP_BYTES = 16 << 20     # of vectors (as doubles) that one task compares at a time
LISTS = "cell int, list_id int, centroid array<double>"
META = "buckets int"


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, its rows' places from 0 in the given order: sorted in ranges, numbered from their counts."""
    placed = _written(df.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(starts, "part").withColumn("pos", F.col("start") + F.col("at")).drop("part", "at", "start")


def seeds(sample: DataFrame, nlist: int) -> DataFrame:
    """``LISTS`` of one cell: the first ``nlist`` vectors of ``sample`` (id, vec, h) in md5 order."""
    first = numbered(sample.orderBy("h", "id").limit(nlist).select("id", "vec", "h"), "h", "id")
    return first.select(F.lit(0).alias("cell"), F.col("pos").cast("int").alias("list_id"), _rounded(F.col("vec")).alias("centroid"))


def _rounded(vec) -> F.Column:
    return F.transform(vec.cast("array<double>"), lambda x: F.round(x, CENTROID_DECIMALS))


def _dealt(vectors: DataFrame, lists: DataFrame, group_bytes: int):
    """Both sides with a group number within the cell: vectors by hash, centroids copied to each group of their cell."""
    size = vectors.groupBy("cell").agg((F.sum(F.size("vec").cast("long")) * 8).alias("bytes"))
    parts = _written(size.select("cell", F.ceil(F.col("bytes") / group_bytes).cast("int").alias("parts")), "quantiser-parts")
    left = vectors.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    right = lists.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("cell", "part"), right.groupBy("cell", "part")


def _centroids(right: pa.Table):
    order = np.argsort(right.column("list_id").to_numpy(), kind="stable")
    return right.column("list_id").to_numpy()[order], list_matrix(right.column("centroid"))[order]


def _nearest(n: int, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(left, names).empty_table()
        ids, C = _centroids(right)
        pos, d2 = nearest_rows(list_matrix(left.column("vec")), C, n)
        rows = pa.array(np.repeat(np.arange(left.num_rows), pos.shape[1]))
        out = {c: left.column(c).take(rows) for c in names if c not in ("list_id", "d2")}
        out["list_id"], out["d2"] = pa.array(ids[pos.reshape(-1)].astype(np.int32)), pa.array(d2.reshape(-1))
        return pa.table({c: out[c] for c in names})
    return run


def _empty(left: pa.Table, names: list[str]) -> pa.Schema:
    return pa.schema([("list_id", pa.int32()) if c == "list_id" else ("d2", pa.float64()) if c == "d2" else left.schema.field(c) for c in names])


def nearest_lists(vectors: DataFrame, lists: DataFrame, n: int = 1, carry: tuple[str, ...] = ("vec",),
                  group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The ``n`` nearest lists of its cell for every vector: (id, *carry, list_id, d2).  Vectors are (cell, id, vec, …)."""
    left, right = _dealt(vectors, lists, group_bytes)
    names = ["id", *carry, "list_id", "d2"]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields} | {"list_id": "int", "d2": "double"}
    return left.cogroup(right).applyInArrow(_nearest(n, names), ", ".join(f"{c} {kinds[c]}" for c in names))


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    schema = pa.schema([("list_id", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    ids, C = _centroids(right)
    X = list_matrix(left.column("vec"))
    pos, _ = nearest_rows(X, C, 1)
    order = np.argsort(pos[:, 0], kind="stable")
    touched, start = np.unique(pos[order, 0], return_index=True)
    sums = np.add.reduceat(X[order], start, axis=0)
    count = np.diff(np.append(start, len(order)))
    offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
    return pa.table([pa.array(ids[touched].astype(np.int32)), pa.array(count), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))],
                    schema=schema)


def lloyd_round(vectors: DataFrame, lists: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One k-means round within every cell; a list without members keeps its centroid."""
    left, right = _dealt(vectors, lists, group_bytes)
    part = left.cogroup(right).applyInArrow(_sums, "list_id int, n long, sums array<double>")
    cells = part.select("list_id", "n", F.posexplode("sums").alias("dim", "s")).groupBy("list_id", "dim").agg(
        F.round(F.sum("s") / F.sum("n"), CENTROID_DECIMALS).alias("x"))
    moved = cells.groupBy("list_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("moved"))
    return lists.join(moved, "list_id", "left").select("cell", "list_id", F.coalesce("moved", "centroid").alias("centroid"))


def lloyd(vectors: DataFrame, lists: DataFrame, n_iter: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    for _ in range(n_iter):
        lists = _written(lloyd_round(vectors, lists, group_bytes), "quantiser-lists")
    return lists


@dataclass
class CoarseTree:
    cells: DataFrame     # cell (always 0), list_id (the cell's number), centroid
    lists: DataFrame     # cell, list_id, centroid


def train(corpus: DataFrame, nlist: int | None = None, n_iter: int = 10, train_size: int | None = None, seed: str = "ivf",
          id_col: str = "vec_id", vec_col: str = "embedding", group_bytes: int = GROUP_BYTES) -> CoarseTree:
    """A tree of about ``nlist`` lists, trained on the md5 sample that the flat quantiser takes."""
    n = corpus.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).count()
    nlist = nlist or ivf.default_nlist(n)
    m = ivf.train_rows(n, nlist, train_size)
    sample = _written(ivf.sample_vectors(corpus, m, seed, id_col, vec_col), "quantiser-sample")
    one = sample.withColumn("cell", F.lit(0))
    cells = _written(seeds(sample, min(m, max(1, math.ceil(math.sqrt(nlist))))), "quantiser-cells")
    cells = lloyd(one, cells, n_iter, group_bytes)
    placed = _written(nearest_lists(one, cells, 1, ("vec", "h"), group_bytes).select(
        F.col("list_id").alias("cell"), "id", "vec", "h"), "quantiser-placed")
    # a cell's share of the lists, and the number of its first one: a row per cell
    share = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).select(
        "cell", F.greatest(F.lit(1), F.round(F.col("c") * nlist / F.lit(max(m, 1)))).cast("int").alias("share"))
    before = F.sum("share").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    share = share.withColumn("first", F.coalesce(before, F.lit(0)))
    order = placed.select("cell", "id", "h").join(share, "cell").withColumn(
        "r", F.row_number().over(Window.partitionBy("cell").orderBy("h", "id"))).where(F.col("r") <= F.col("share"))
    chosen = order.select("id", (F.col("first") + F.col("r") - 1).cast("int").alias("list_id"))
    lists = _written(placed.join(chosen, "id").select("cell", "list_id", _rounded(F.col("vec")).alias("centroid")), "quantiser-lists")
    return CoarseTree(cells, lloyd(placed, lists, n_iter, group_bytes))


def assign(corpus: DataFrame, tree: CoarseTree, id_col: str = "vec_id", vec_col: str = "embedding",
           group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Postings (list_id, id, vec): the nearest list of the nearest cell."""
    vectors = corpus_frame(corpus, id_col, vec_col).withColumn("cell", F.lit(0))
    placed = nearest_lists(vectors, tree.cells, 1, ("vec",), group_bytes).select(F.col("list_id").alias("cell"), "id", "vec")
    return nearest_lists(_written(placed, "quantiser-placed"), tree.lists, 1, ("vec",), group_bytes).select("list_id", "id", "vec")


def probe(queries: DataFrame, tree: CoarseTree, nprobe: int, ncells: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(list_id, query_id, probe_rank): the ``nprobe`` nearest lists in the ``ncells`` nearest cells of every query."""
    q = queries.select(F.lit(0).alias("cell"), F.col("query_id").alias("id"), F.col("qv").alias("vec"))
    near = nearest_lists(q, tree.cells, ncells, ("vec",), group_bytes).select(F.col("list_id").alias("cell"), "id", "vec")
    found = nearest_lists(_written(near, "quantiser-near"), tree.lists, nprobe, (), group_bytes)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "list_id"))
    return found.withColumn("probe_rank", rank).where(F.col("probe_rank") <= nprobe).select("list_id", F.col("id").alias("query_id"), "probe_rank")


@dataclass
class TreeIndex:
    """Cells, lists and postings, all written tables."""

    tree: CoarseTree
    postings: DataFrame
    buckets: int

    @property
    def nlist(self) -> int:
        return self.tree.lists.count()

    def list_sizes(self) -> DataFrame:
        return self.postings.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))

    def save(self, path: str) -> None:
        """The three tables and the bucket count."""
        self.tree.cells.write.mode("overwrite").parquet(f"{path}/cells")
        self.tree.lists.write.mode("overwrite").parquet(f"{path}/lists")
        ivf.write_postings(self.postings, f"{path}/postings", self.buckets)
        self.postings.sparkSession.createDataFrame([(self.buckets,)], META).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TreeIndex:
        tree = CoarseTree(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/lists"))
        postings = spark.read.parquet(f"{path}/postings").select("list_id", "id", "vec", "list_bucket")
        return cls(tree, postings, spark.read.parquet(f"{path}/meta").first()["buckets"])


def build(corpus: DataFrame, nlist: int | None = None, n_iter: int = 10, train_size: int | None = None, seed: str = "ivf",
          id_col: str = "vec_id", vec_col: str = "embedding", buckets: int = DEFAULT_LIST_BUCKETS,
          group_bytes: int = GROUP_BYTES) -> TreeIndex:
    spark = corpus.sparkSession
    tree = train(corpus, nlist, n_iter, train_size, seed, id_col, vec_col, group_bytes)
    path = scratch_path(spark, "quantiser-postings")
    ivf.write_postings(assign(corpus, tree, id_col, vec_col, group_bytes), path, buckets)
    return TreeIndex(tree, spark.read.parquet(path), buckets)


def search(index: TreeIndex, queries: DataFrame, k: int, nprobe: int, ncells: int | None = None, *,
           query_id_col: str = "query_id", query_vec_col: str = "qv", with_vectors: bool = False,
           exclude_self: bool = False) -> DataFrame:
    """J8 over the tree: the ``nprobe`` nearest lists of the ``ncells`` nearest cells (default: twice the cells that
    ``nprobe`` lists fill on average), then exact top-k.  With all cells and lists it is exact search."""
    qf = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).alias("qv")).where(F.col("qv").isNotNull())
    shape = index.tree.lists.agg(F.count(F.lit(1)).alias("lists"), F.countDistinct("cell").alias("cells")).first()
    ncells = ncells or max(2, math.ceil(2 * nprobe * shape["cells"] / max(1, shape["lists"])))
    probes = _written(probe(qf, index.tree, nprobe, ncells), "quantiser-probes")
    return ivf.scan_probes(index, qf, probes, k, nprobe, with_vectors=with_vectors, exclude_self=exclude_self)
