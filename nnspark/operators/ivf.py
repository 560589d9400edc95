"""Inverted-list (IVF) index: sampling, training, assignment, probe search.

Index = two ordinary tables: ``centroids(list_id, centroid)`` and
``postings(list_id, id, vec)``.  Everything is deterministic: the training
sample and the seeds come from md5 order, and centroid coordinates are kept
to ``CENTROID_DECIMALS`` decimals after every round, so the trained index is
identical under any partitioning (and in the SQL oracle).

Scale notes
* Training sample (T4): the first m ids in md5 order are found from the counts
  of 65,536 hash ranges: all ranges below the one holding the m-th id are a plain
  filter, and only that range is sorted.  The sample grows with the lists
  (``train_rows``).
* Lloyd round (A12): each task assigns its vectors and emits one partial sum
  per (list, dimension) it touched; ``groupBy(list_id, dim)`` merges them with
  map-side partial aggregation.  The centroid matrix is broadcast after a size
  check; it is nlist x dim and grows with sqrt(N).
* Probe scan (J8): query blocks with their lists and posting groups by hash meet
  in one shuffle (``list_scan``): a hot list is spread over all groups, no row
  per candidate is made, and only each task's top k leaves it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nnspark.functions.hashing import md5_key32
from nnspark.operators import list_scan
from nnspark.operators.exact import corpus_frame, finish_topk_with_cost
from nnspark.operators.gather import DEFAULT_BROADCAST_BYTES, gather_vectors, measure
from nnspark.operators.kernels import list_matrix, nearest_rows

CENTROID_DECIMALS = 9
DEFAULT_TRAIN_SIZE = 100_000
TRAIN_ROWS_PER_LIST = 64
# The driver keeps the centroid matrix between rounds; beyond this training raises.
MAX_DRIVER_CENTROID_BYTES = 4 * 1024 ** 3
PROBE_ROW_BYTES = 32
HASH_RANGE_BITS = 16
DEFAULT_LIST_BUCKETS = 256


def default_nlist(n: int) -> int:
    """nlist = int(4 * sqrt(N)), at least 1 and at most N."""
    return max(1, min(n, int(4 * math.sqrt(max(n, 0)))))


def train_rows(n: int, nlist: int, train_size: int | None = None) -> int:
    """Rows that train ``nlist`` lists: ``train_size`` if given, else 100,000 or 64 a list,
    whichever is more, and never more than the ``n`` there are.  Raises when lists outnumber them."""
    want = max(DEFAULT_TRAIN_SIZE, TRAIN_ROWS_PER_LIST * nlist) if train_size is None else train_size
    m = min(want, n)
    if n and nlist > m:
        raise ValueError(f"{nlist} lists cannot be trained on {m} vectors")
    return m


def _hash_range() -> F.Column:
    return F.shiftright("h", 32 - HASH_RANGE_BITS)


def _range_of_mth(keyed: DataFrame, m: int) -> tuple[int, int] | None:
    """The hash range that holds the m-th row in h order, and how many of its rows are among
    the first m; None when there are no more than m rows.  65,536 counts reach the driver."""
    t = keyed.groupBy(_hash_range().alias("b")).agg(F.count(F.lit(1)).alias("c")).orderBy("b").toArrow()
    counts = t.column("c").to_numpy()
    upto = np.cumsum(counts)
    if not len(upto) or upto[-1] <= m:
        return None
    i = int(np.searchsorted(upto, m))
    return int(t.column("b")[i].as_py()), int(m - (upto[i] - counts[i]))


def sample_ids(corpus: DataFrame, m: int, seed: str = "ivf", id_col: str = "vec_id") -> DataFrame:
    """T4: the first m ids in (md5(seed:id), id) order, as (id, h); only one hash range is sorted."""
    ids = corpus.select(F.col(id_col).cast("long").alias("id")).where(F.col("id").isNotNull())
    keyed = ids.withColumn("h", md5_key32(F.lit(seed), F.col("id")))
    if m <= 0:
        return keyed.limit(0)
    edge = _range_of_mth(keyed, m)
    if edge is None:
        return keyed
    b, rest = edge
    return keyed.where(_hash_range() < b).unionByName(
        keyed.where(_hash_range() == b).orderBy("h", "id").limit(rest))


def sample_vectors(corpus: DataFrame, m: int, seed: str = "ivf", id_col: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """The first m vectors in md5 order, as (id, vec, h): a filter on the hash, and a join for
    the one hash range that is taken in part."""
    keyed = corpus_frame(corpus, id_col, vec_col).withColumn("h", md5_key32(F.lit(seed), F.col("id")))
    if m <= 0:
        return keyed.limit(0)
    edge = _range_of_mth(keyed.select("id", "h"), m)
    if edge is None:
        return keyed
    b, rest = edge
    part = keyed.where(_hash_range() == b)
    ids = part.select("h", "id").orderBy("h", "id").limit(rest).select("id")
    return keyed.where(_hash_range() < b).unionByName(part.join(ids, "id", "left_semi"))


def _round_centroids(c: np.ndarray) -> np.ndarray:
    return np.round(c, CENTROID_DECIMALS)


def seed_centroids(sample: DataFrame, nlist: int, budget: int = DEFAULT_BROADCAST_BYTES) -> np.ndarray:
    """The first nlist sampled vectors in md5 order are the initial centroids."""
    seeds = sample.orderBy("h", "id").limit(nlist)
    seeds = seeds.withColumn("pos", F.row_number().over(Window.orderBy("h", "id")))
    _, C = gather_vectors(seeds, "pos", "vec", budget)
    return _round_centroids(C)


def _partial_sums(sample: DataFrame, C: np.ndarray) -> DataFrame:
    sc = sample.sparkSession.sparkContext
    bc = sc.broadcast(C)

    def run(batches):
        cm = bc.value
        nl, dim = cm.shape
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = list_matrix(rb.column("vec"), dim)
            pos, _ = nearest_rows(X, cm, 1)
            lab = pos[:, 0]
            cnt = np.bincount(lab, minlength=nl)
            sums = np.zeros((nl, dim))
            np.add.at(sums, lab, X)
            touched = np.nonzero(cnt)[0]
            offsets = np.arange(0, (len(touched) + 1) * dim, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(touched.astype(np.int32)),
                    pa.array(cnt[touched].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[touched].reshape(-1))),
                ],
                names=["list_id", "cnt", "sums"],
            )

    return sample.select("vec").mapInArrow(run, "list_id int, cnt long, sums array<double>")


def lloyd_round(sample: DataFrame, C: np.ndarray, budget: int = DEFAULT_BROADCAST_BYTES) -> np.ndarray:
    """One k-means round; an empty list keeps its centroid.

    One aggregation: per (list, dim) the partial sums, with the member count
    riding along as dim = -1; nlist x (dim + 1) rows come back (bounded).
    When the centroids exceed the broadcast budget, the assignment is the
    blocked nearest-list join and the sums are a plain groupBy over it.
    """
    if C.shape[0] * C.shape[1] * 8 > budget:
        lab = _nearest_lists(sample.select("id", "vec"), C, "vec", 1, "id", ["vec"], budget)
        cells = lab.select("list_id", F.lit(-1).alias("dim"), F.lit(1.0).alias("s")).unionByName(
            lab.select("list_id", F.posexplode("vec").alias("dim", "s")).select(
                "list_id", "dim", F.col("s").cast("double").alias("s")))
    else:
        part = _partial_sums(sample, C)
        cells = part.select(
            "list_id",
            F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("dim"), F.col("cnt").cast("double").alias("s"))),
                               F.transform("sums", lambda x, i: F.struct(i.alias("dim"), x.alias("s"))))).alias("c"),
        ).select("list_id", "c.dim", "c.s")
    tbl = cells.groupBy("list_id", "dim").agg(F.sum("s").alias("s")).toArrow()
    lid = tbl.column("list_id").to_numpy()
    dim = tbl.column("dim").to_numpy()
    val = tbl.column("s").to_numpy()
    cnt = np.zeros(C.shape[0])
    is_cnt = dim < 0
    cnt[lid[is_cnt]] = val[is_cnt]
    sums = np.zeros_like(C)
    sums[lid[~is_cnt], dim[~is_cnt]] = val[~is_cnt]
    newc = C.copy()
    filled = cnt > 0
    newc[filled] = sums[filled] / cnt[filled][:, None]
    return _round_centroids(newc)


def train(corpus: DataFrame, nlist: int | None = None, n_iter: int = 10, train_size: int | None = None,
          seed: str = "ivf", id_col: str = "vec_id", vec_col: str = "embedding",
          budget: int = DEFAULT_BROADCAST_BYTES) -> np.ndarray:
    """Train exactly ``nlist`` centroids on the md5 sample of ``train_rows`` vectors."""
    n, _ = measure(corpus.where(F.col(vec_col).isNotNull()), vec_col)
    nlist = nlist or default_nlist(n)
    m = train_rows(n, nlist, train_size)
    sample = sample_vectors(corpus, m, seed, id_col, vec_col)
    spark = corpus.sparkSession
    from nnspark.session import scratch_path
    path = scratch_path(spark, "ivf-sample")
    sample.write.parquet(path)
    sample = spark.read.parquet(path).cache()
    C = seed_centroids(sample, nlist, MAX_DRIVER_CENTROID_BYTES)
    for _ in range(n_iter):
        C = lloyd_round(sample, C, budget)
    sample.unpersist()
    return C


def _assign(df: DataFrame, C: np.ndarray, vec: str, n: int, out_schema: str, key_cols: list[str],
            with_rank: bool = False, offset: int = 0, with_d2: bool = False) -> DataFrame:
    sc = df.sparkSession.sparkContext
    bc = sc.broadcast(C)

    def run(batches):
        cm = bc.value
        dim = cm.shape[1]
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = list_matrix(rb.column(vec), dim)
            pos, dd = nearest_rows(X, cm, n)
            nn = pos.shape[1]
            cols = [pa.array((pos.reshape(-1) + offset).astype(np.int32))]
            names = ["list_id"]
            if with_d2:
                cols.append(pa.array(dd.reshape(-1)))
                names.append("_cd2")
            take = pa.array(np.repeat(np.arange(rb.num_rows), nn))
            for c in key_cols:
                cols.append(rb.column(c).take(take))
                names.append(c)
            if with_rank:
                cols.append(pa.array(np.tile(np.arange(1, nn + 1, dtype=np.int32), rb.num_rows)))
                names.append("probe_rank")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, out_schema)


def _nearest_lists(df: DataFrame, C: np.ndarray, vec: str, n: int, key: str, carry: list[str],
                   budget: int) -> DataFrame:
    """(list_id, key, *carry, probe_rank) of the n nearest centroids per row.

    One broadcast of C when it fits ``budget``; otherwise C is cut into blocks
    that fit, each block gives its n nearest with distances, and an exact
    window (distance, list_id) keeps the global n per row.
    """
    carry_schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)
    key_type = df.schema[key].dataType.simpleString()
    base = f"list_id int, {key} {key_type}" + (f", {carry_schema}" if carry else "")
    per_block = max(1, budget // (8 * max(C.shape[1], 1)))
    if C.shape[0] <= per_block:
        return _assign(df, C, vec, n, base + ", probe_rank int", [key, *carry], with_rank=True)
    parts = []
    for start in range(0, C.shape[0], per_block):
        blk = C[start:start + per_block]
        parts.append(_assign(df.select(key, vec), blk, vec, n, f"list_id int, _cd2 double, {key} {key_type}",
                             [key], offset=start, with_d2=True))
    allc = parts[0]
    for p in parts[1:]:
        allc = allc.unionByName(p)
    w = Window.partitionBy(key).orderBy("_cd2", "list_id")
    top = allc.withColumn("probe_rank", F.row_number().over(w).cast("int")).where(F.col("probe_rank") <= n) \
        .drop("_cd2")
    if carry:
        top = top.join(df.select(key, *carry), key)
    return top.select("list_id", key, *carry, "probe_rank")


def assign(corpus: DataFrame, C: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding",
           budget: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Postings (list_id, id, vec): every vector in its nearest list."""
    cf = corpus_frame(corpus, id_col, vec_col)
    return _nearest_lists(cf, C, "vec", 1, "id", ["vec"], budget).drop("probe_rank")


def probe_lists(queries: DataFrame, C: np.ndarray, nprobe: int, budget: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Each query's nprobe nearest lists: (list_id, query_id, probe_rank)."""
    return _nearest_lists(queries.select("query_id", "qv"), C, "qv", nprobe, "query_id", [], budget)


def _bucket_count(postings: DataFrame) -> int:
    return int(postings.agg(F.max("list_bucket")).first()[0] or 0) + 1


@dataclass
class IvfIndex:
    """Trained centroids (driver-side, bounded) plus the postings table."""

    centroids: np.ndarray
    postings: DataFrame
    buckets: int = 0

    @property
    def nlist(self) -> int:
        return int(self.centroids.shape[0])

    def list_sizes(self) -> DataFrame:
        return self.postings.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))

    def centroid_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, "list_id int, centroid array<double>")

    def save(self, path: str, buckets: int | None = None) -> None:
        """Persist as Parquet; postings partitioned by list bucket."""
        spark = self.postings.sparkSession
        self.centroid_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        write_postings(self.postings, f"{path}/postings", buckets or self.buckets or DEFAULT_LIST_BUCKETS)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "IvfIndex":
        cent = spark.read.parquet(f"{path}/centroids").orderBy("list_id").toArrow()
        C = list_matrix(cent.column("centroid"))
        postings = spark.read.parquet(f"{path}/postings").select("list_id", "id", "vec", "list_bucket")
        return cls(C, postings, _bucket_count(postings))


def write_postings(postings: DataFrame, path: str, buckets: int = DEFAULT_LIST_BUCKETS) -> None:
    """Postings on disk: directory per list bucket (pmod(list_id, B)), rows
    clustered by list inside, so a probe touches few files.  The rows are
    rebalanced by bucket: adaptive execution splits the bucket of a hot list
    over several tasks and files, and merges small buckets into one task."""
    p = postings.select("list_id", "id", "vec").withColumn("list_bucket", F.pmod(F.col("list_id"), F.lit(buckets)))
    p.hint("rebalance", F.col("list_bucket")).sortWithinPartitions("list_bucket", "list_id").write.mode("overwrite") \
        .partitionBy("list_bucket").parquet(path)


def build(corpus: DataFrame, nlist: int | None = None, n_iter: int = 10, train_size: int | None = None,
          seed: str = "ivf", id_col: str = "vec_id", vec_col: str = "embedding",
          buckets: int = DEFAULT_LIST_BUCKETS, budget: int = DEFAULT_BROADCAST_BYTES) -> IvfIndex:
    """Train, assign every vector, and write the postings as a table in the
    checkpoint folder (searches read it; they never re-assign the corpus)."""
    from nnspark.session import scratch_path

    spark = corpus.sparkSession
    C = train(corpus, nlist, n_iter, train_size, seed, id_col, vec_col, budget)
    path = scratch_path(spark, "ivf-postings")
    nb = max(1, min(buckets, C.shape[0]))
    write_postings(assign(corpus, C, id_col, vec_col, budget), path, nb)
    return IvfIndex(C, spark.read.parquet(path), nb)


def search(index: IvfIndex, queries: DataFrame, k: int, nprobe: int, *, query_id_col: str = "query_id",
           query_vec_col: str = "qv", with_vectors: bool = False, exclude_self: bool = False,
           budget: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Scan only the nprobe nearest lists of each query, then exact top-k.

    cost = number of candidates (sum of the probed list sizes); n_hits can be
    below k when the probed lists hold fewer vectors (no sentinel rows).
    """
    qf = queries.select(F.col(query_id_col).cast("long").alias("query_id"),
                        F.col(query_vec_col).alias("qv")).where(F.col("qv").isNotNull())
    nprobe = max(1, min(nprobe, index.nlist))
    probes = probe_lists(qf, index.centroids, nprobe, budget).cache()
    return scan_probes(index, qf, probes, k, nprobe, with_vectors=with_vectors, exclude_self=exclude_self, budget=budget)


def scan_probes(index, qf: DataFrame, probes: DataFrame, k: int, nprobe: int, *, with_vectors: bool = False,
                exclude_self: bool = False, budget: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """The ranked hits of ``qf`` (query_id, qv) in the probed lists (list_id, query_id) of an index
    that has ``postings``, ``buckets``, ``nlist`` and ``list_sizes()``."""
    nq = qf.count()
    small_probes = nq * nprobe * PROBE_ROW_BYTES <= budget
    post = index.postings
    if "list_bucket" in post.columns:
        # static partition pruning: the probed buckets (at most nb values) become a
        # PartitionFilter, so unprobed bucket directories are never listed or read
        nb = index.buckets or _bucket_count(post)
        probed = [r[0] for r in probes.select(F.pmod(F.col("list_id"), F.lit(nb))).distinct().collect()]
        if len(probed) < nb:
            post = post.where(F.col("list_bucket").isin(probed))
    small_lists = index.nlist * PROBE_ROW_BYTES <= budget
    lists = probes.select("list_id").distinct()
    post = post.join(F.broadcast(lists) if small_lists else lists, "list_id", "left_semi")
    # a hit finds its vector again by id and the hash of the vector, as an id may repeat
    post = post.select("list_id", "id", F.xxhash64("vec").alias("tag"), "vec")
    cand = list_scan.topk(post, qf, probes, k, nprobe, exclude_self)
    sizes = index.list_sizes()
    cost = probes.join(F.broadcast(sizes) if small_lists else sizes, "list_id") \
        .groupBy("query_id").agg(F.sum("size").alias("cost"))
    ranked = finish_topk_with_cost(cand, k, cost, small_cost=small_probes)
    if not with_vectors:
        return ranked.drop("tag")
    vectors = post.select("id", "tag", "vec").dropDuplicates(["id", "tag"])
    return ranked.join(vectors, ["id", "tag"]).select(*[c for c in ranked.columns if c != "tag"], "vec")
