"""Exact k-nearest-neighbour search.

Plan shape::

    corpus scan (id, vector; pruned)  --mapInArrow-->  per-task top-k per query
        --shuffle by query_id (tasks x queries x k rows)-->  row_number() <= k

A query table whose measured size, with the hits kept for it, fits a block is broadcast.  A larger one never
reaches the driver: query blocks and corpus groups, both by hash, meet in one
shuffle, a task per (block, group) that holds the block and streams the group.
Where very many tasks find hits of one query, they are merged in two levels.  No
cross join is planned: every (query, vector) distance is computed inside a task and
only ids and distances of its top-k leave it; vectors of the final hits are joined after ranking.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnspark.functions.distance import safe_sqrt
from nnspark.operators.gather import DEFAULT_BROADCAST_BYTES, gather_vectors, measure
from nnspark.operators.kernels import batch_topk, list_matrix, near_pairs
from nnspark.session import scratch_path

PARTIAL_SCHEMA = "query_id long, id long, d2 double, n_eval long, part long"
MERGE_PARTS = 64
GRID_BLOCK_BYTES = 32 << 20    # of queries and of the hits kept for them, per task
BATCH_ROWS = 1 << 16
GRID_GROUP_BYTES = 512 << 20
MERGE_CELLS = 1 << 20
LAST_ID = np.iinfo(np.int64).max
FIRST_ROWS = 512        # vectors that a list starts with
PART_ROWS = 1 << 13     # vectors that a list meets at a time
PAIR_CELLS = 1 << 24     # of a step, so that few of them prepare the vectors
GRID_PARTITIONS = 1 << 16
RANKED_COLUMNS = ["query_id", "rank", "id", "dist", "d2", "cost", "n_hits"]


def corpus_frame(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Project the corpus to (id, vec) and drop rows without a vector."""
    return corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("vec").isNotNull()
    )


class _RunningTopk:
    """The k nearest vectors seen so far of every query of a block."""

    def __init__(self, q_ids: np.ndarray, q_mat: np.ndarray, k: int):
        self.q_ids, self.q_mat, self.k = q_ids, q_mat, k
        self.d = self.i = None
        self.seen = 0

    def add(self, ids: np.ndarray, V: np.ndarray) -> None:
        lo = 0
        while lo < len(ids):  # growing parts, so that all but a few vectors meet lists that already rule most out
            hi = lo + max(FIRST_ROWS, self.k, min(self.seen, PART_ROWS))
            (self._fill if self.d is None or self.d.shape[1] < self.k else self._replace)(ids[lo:hi], V[lo:hi])
            self.seen += len(ids[lo:hi])
            lo = hi

    def _fill(self, ids: np.ndarray, V: np.ndarray) -> None:
        nq, kk = len(self.q_ids), min(self.k, len(ids))
        had = 0 if self.d is None else self.d.shape[1]
        width = min(self.k, had + kk)
        grown = np.empty((nq, width)), np.empty((nq, width), dtype=np.int64)
        for new, old in zip(grown, (self.d, self.i)):
            if had:
                new[:, :had] = old
        self.d, self.i = grown
        step = max(1, BATCH_ROWS // width)
        for lo in range(0, nq, step):
            at = slice(lo, lo + step)
            q = self.q_mat[at]
            _, rpos, d2 = batch_topk(q, V, ids, self.k)
            d, i = np.hstack([self.d[at, :had], d2.reshape(len(q), kk)]), np.hstack([self.i[at, :had], ids[rpos].reshape(len(q), kk)])
            order = np.lexsort((i, d), axis=-1)[:, :width]
            self.d[at], self.i[at] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

    def _replace(self, ids: np.ndarray, V: np.ndarray) -> None:
        """Only pairs within a query's k-th distance are looked at; the queries that have some are merged."""
        step = max(1, PAIR_CELLS // len(ids))
        for lo in range(0, len(self.q_ids), step):
            at = slice(lo, lo + step)
            q, r, d2 = near_pairs(self.q_mat[at], V, np.where(np.isnan(self.d[at, -1]), np.inf, self.d[at, -1]))
            if not len(q):
                continue
            n = np.bincount(q)
            some = np.argsort(n, kind="stable")[np.count_nonzero(n == 0):]
            first = np.cumsum(n) - n
            at = 0
            while at < len(some):  # rows of a like number of new hits are sorted together
                rows = some[at:at + max(1, MERGE_CELLS // int(self.k + n[some[min(at + BATCH_ROWS, len(some)) - 1]]))][:BATCH_ROWS]
                at += len(rows)
                cell = np.arange(int(n[rows[-1]]))[None, :]
                pos = np.minimum(first[rows, None] + cell, len(q) - 1)
                d = np.hstack((self.d[lo + rows], np.where(cell < n[rows, None], d2[pos], np.nan)))
                i = np.hstack((self.i[lo + rows], ids[r[pos]]))
                order = np.argsort(d, axis=1)
                near = np.take_along_axis(d, order, 1)
                tied = np.flatnonzero(~(near[:, :self.k] < near[:, 1:self.k + 1]).all(axis=1))
                order = order[:, :self.k]
                order[tied] = np.lexsort((np.where(np.arange(d.shape[1])[None, :] < self.k + n[rows[tied], None], i[tied], LAST_ID), d[tied]),
                                         axis=-1)[:, :self.k]
                self.d[lo + rows], self.i[lo + rows] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

    def batches(self, part: int):
        """The result as Arrow batches (PARTIAL_SCHEMA) of about ``BATCH_ROWS`` rows."""
        if self.d is None or not len(self.q_ids):
            return
        kk = self.d.shape[1]
        step = max(1, BATCH_ROWS // max(kk, 1))
        for lo in range(0, len(self.q_ids), step):
            q, i, d = (x[lo:lo + step] for x in (self.q_ids, self.i, self.d))
            n_eval = np.zeros(d.shape, dtype=np.int64)
            n_eval[:, 0] = self.seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q, kk)), pa.array(i.reshape(-1)), pa.array(d.reshape(-1)),
                 pa.array(n_eval.reshape(-1)), pa.array(np.full(d.size, part, dtype=np.int64))],
                names=["query_id", "id", "d2", "n_eval", "part"])


def _partition_topk(corpus: DataFrame, qids: np.ndarray, Q: np.ndarray, k: int) -> DataFrame:
    """Per-task exact top-k of each query of a broadcast block; output <= queries x k rows per task."""
    bq = corpus.sparkSession.sparkContext.broadcast((qids, Q))

    def run(batches):
        best = _RunningTopk(*bq.value, k)
        for rb in batches:
            if rb.num_rows:
                best.add(rb.column("id").to_numpy(), list_matrix(rb.column("vec"), Q_dim))
        yield from best.batches(TaskContext.get().partitionId())

    Q_dim = Q.shape[1]
    return corpus.mapInArrow(run, PARTIAL_SCHEMA)


def grid_shape(spark, need: int, corpus_bytes: int, room: int = GRID_BLOCK_BYTES) -> tuple[int, int]:
    """(query blocks, corpus groups): a block within ``room``, and tasks for every core.  Each group has hits of its own
    for every query, and a corpus is copied once per block whatever its groups, so there are few of them."""
    n_groups = max(1, math.ceil(corpus_bytes / GRID_GROUP_BYTES))
    return max(math.ceil(need / room), math.ceil(2 * spark.sparkContext.defaultParallelism / n_groups)), n_groups


def _grid_topk(corpus: DataFrame, qf: DataFrame, k: int, n_blocks: int, n_groups: int, dim: int) -> DataFrame:
    """The same per (query block, corpus group), where the query table is too large to broadcast."""
    kind = dict(qf.dtypes)["qv"] if dict(qf.dtypes)["qv"] == dict(corpus.dtypes)["vec"] else "array<double>"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = qf.select(hashed("query_id", n_blocks).alias("block"), every(n_groups).alias("group"), F.lit(0).alias("role"),
                      F.col("query_id").alias("id"), F.col("qv").cast(kind).alias("vec"))
    held = corpus.select(every(n_blocks).alias("block"), hashed("id", n_groups).alias("group"), F.lit(1).alias("role"),
                         "id", F.col("vec").cast(kind).alias("vec"))
    dealt = (asked.unionByName(held).repartition(min(2 * n_blocks * n_groups, GRID_PARTITIONS), "block", "group")
             .sortWithinPartitions("block", "group", "role"))

    def run(batches):
        at, asked, best = None, [], None
        for rb in batches:
            keys = [rb.column(c).to_numpy() for c in ("block", "group", "role")]
            ids = rb.column("id").to_numpy()
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1 if rb.num_rows else []
            edges = [0, *change, rb.num_rows] if rb.num_rows else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                cell, V = (keys[0][lo], keys[1][lo]), list_matrix(rb.column("vec").slice(lo, hi - lo), dim)
                if cell != at:
                    if best is not None:
                        yield from best.batches(int(at[1]))
                    at, asked, best = cell, [], None
                if keys[2][lo] == 0:
                    asked.append((ids[lo:hi], V))
                elif asked or best is not None:
                    if best is None:
                        best = _RunningTopk(*[np.concatenate(c) for c in zip(*asked)], k)
                        asked = []
                    best.add(ids[lo:hi], V)
        if best is not None:
            yield from best.batches(int(at[1]))

    return dealt.mapInArrow(run, PARTIAL_SCHEMA)


def _estimated_tasks(df: DataFrame) -> int:
    """Scan tasks of a table by the optimizer's size estimate; it only steers how the work is cut, never results."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return min(max(1, math.ceil(size / split)), 1 << 20)


def _merge_level(partial: DataFrame, k: int) -> DataFrame:
    """Per query the top k of every ``MERGE_PARTS`` tasks, and the evaluations of all of them."""
    group = Window.partitionBy("query_id", "part")
    merged = partial.withColumn("part", F.floor(F.col("part") / MERGE_PARTS))
    merged = merged.withColumn("n_eval", F.sum("n_eval").over(group)).withColumn(
        "_r", F.row_number().over(group.orderBy("d2", "id"))).where(F.col("_r") <= k)
    return merged.withColumn("n_eval", F.when(F.col("_r") == 1, F.col("n_eval")).otherwise(F.lit(0))).drop("_r")


def finish_topk(partial: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """Global top-k per query from partial candidates (W1 + T1).

    ``partial`` has query_id, id, d2 and optionally n_eval (distance
    evaluations) and vec.  Ties in distance are broken by id (Q14).
    """
    per_query = Window.partitionBy("query_id")
    if "n_eval" in partial.columns:
        partial = partial.withColumn("cost", F.sum("n_eval").over(per_query)).drop("n_eval")
    else:
        partial = partial.withColumn("cost", F.count(F.lit(1)).over(per_query))
    if exclude_self:
        partial = partial.where(F.col("id") != F.col("query_id"))
    ranked = partial.withColumn("rank", F.row_number().over(per_query.orderBy("d2", "id"))).where(
        F.col("rank") <= k
    )
    ranked = ranked.withColumn("n_hits", F.count(F.lit(1)).over(per_query).cast("int"))
    extra = [c for c in ranked.columns if c not in RANKED_COLUMNS and c not in ("dist",)]
    return ranked.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "id",
        safe_sqrt("d2").alias("dist"),
        "d2",
        F.col("cost").cast("long").alias("cost"),
        "n_hits",
        *extra,
    )


def finish_topk_with_cost(cand: DataFrame, k: int, cost: DataFrame, small_cost: bool = True) -> DataFrame:
    """Global top-k when the per-query cost is known separately.

    Only a row_number() window sits on the candidates, so Catalyst plants a
    partial WindowGroupLimit before the shuffle: each task ships at most k
    candidates per query, however many it scanned.
    """
    per_query = Window.partitionBy("query_id")
    ranked = cand.withColumn("rank", F.row_number().over(per_query.orderBy("d2", "id"))).where(F.col("rank") <= k)
    ranked = ranked.withColumn("n_hits", F.count(F.lit(1)).over(per_query).cast("int"))
    ranked = ranked.join(F.broadcast(cost) if small_cost else cost, "query_id", "left")
    extra = [c for c in ranked.columns if c not in RANKED_COLUMNS and c != "dist"]
    return ranked.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "id",
        safe_sqrt("d2").alias("dist"),
        "d2",
        F.coalesce(F.col("cost"), F.lit(0)).cast("long").alias("cost"),
        "n_hits",
        *extra,
    )


def in_query_blocks(qf: DataFrame, budget: int, run_block, salt: int = 0) -> DataFrame:
    """Run ``run_block(block_df)`` on hash blocks of the query table small
    enough to broadcast, and union the results (one block when it all fits)."""
    nq, dq = measure(qf, "qv")
    need = nq * max(dq, 1) * 8
    if need <= budget or nq <= 1:
        return run_block(qf)
    nblocks = max(2, math.ceil(1.5 * need / budget))
    bucket = F.pmod(F.xxhash64(F.col("query_id"), F.lit(salt)), F.lit(nblocks))
    parts = [in_query_blocks(qf.where(bucket == b), budget, run_block, salt + 1) for b in range(nblocks)]
    return reduce(DataFrame.unionByName, parts)


def exact_knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "qv",
    with_vectors: bool = False,
    exclude_self: bool = False,
    budget: int = DEFAULT_BROADCAST_BYTES,
) -> DataFrame:
    """Exact L2 top-k of every query over the whole corpus.

    Returns the ranked-result contract: query_id, rank, id, dist, d2, cost
    (distance evaluations for the query), n_hits (<= k; fewer when the corpus
    is smaller, never a sentinel), plus vec when ``with_vectors``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    cf = corpus_frame(corpus, id_col, vec_col)
    qf = queries.select(
        F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).alias("qv")
    ).where(F.col("qv").isNotNull())
    nq, dq = measure(qf, "qv")
    k_scan = k + 1 if exclude_self else k
    need = nq * (max(dq, 1) * 8 + k_scan * 16)   # a task holds the queries and their hits so far
    room = min(budget, GRID_BLOCK_BYTES)
    if nq == 0:
        n_tasks, partial = 0, spark.createDataFrame([], PARTIAL_SCHEMA)
    elif need <= room:
        n_tasks = _estimated_tasks(cf)
        partial = _partition_topk(cf, *gather_vectors(qf, "query_id", "qv", budget, (nq, dq)), k_scan)
    else:
        n, d = measure(cf, "vec")
        n_blocks, n_tasks = grid_shape(spark, need, n * d * 8, room)
        partial = _grid_topk(cf, qf, k_scan, n_blocks, n_tasks, dq)
    if n_tasks > MERGE_PARTS:
        partial = _merge_level(partial, k_scan)
    ranked = finish_topk(partial.drop("part"), k, exclude_self)
    # only the final hits fetch their vectors
    return ranked.join(cf, "id").select(*ranked.columns, "vec") if with_vectors else ranked


def self_queries(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every stored vector as a query (the kNN self-join over the whole table)."""
    return corpus.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("qv"))


def k_sweep(ranked_max: DataFrame, ks: list[int]) -> DataFrame:
    """Results for every k from one top-max(k) pass (prefixes of the ranking)."""
    ks = sorted(set(int(k) for k in ks))
    return (
        ranked_max.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        .where(F.col("rank") <= F.col("k"))
        .withColumn("n_hits", F.least(F.col("n_hits"), F.col("k")).cast("int"))
    )


def with_text(ranked: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text",
              default_prefix: str = "ID ", hits_bound: int | None = None,
              max_broadcast_ids: int = 5_000_000) -> DataFrame:
    """Attach the text of each hit, with a default when the id has none.

    The text table can be as large as the corpus; the hits are at most
    queries x k.  When that bound (``hits_bound``) is known and small, the
    distinct hit ids are broadcast to semi-join the text table, so the text
    table is never shuffled; otherwise Spark (AQE) picks the join.  The hits are
    written once, so that the search behind them runs once.
    """
    path = scratch_path(ranked.sparkSession, "ranked-hits")
    ranked.write.parquet(path)
    ranked = ranked.sparkSession.read.parquet(path)
    hit_ids = ranked.select(F.col("id").alias("_tid")).distinct()
    t = texts.select(F.col(id_col).cast("long").alias("_tid"), F.col(text_col).alias("_text"))
    if hits_bound is not None and hits_bound <= max_broadcast_ids:
        t = t.join(F.broadcast(hit_ids), "_tid", "left_semi")
    else:
        t = t.join(hit_ids, "_tid", "left_semi")
    out = ranked.join(t, ranked["id"] == t["_tid"], "left")
    return out.withColumn(
        "text", F.coalesce(F.col("_text"), F.concat(F.lit(default_prefix), F.col("id").cast("string")))
    ).drop("_tid", "_text")
