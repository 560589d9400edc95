"""Top k of every query over the lists that it probes (J8), without a row per candidate.

Query blocks and posting groups, both by hash, meet in one shuffle, as in ``exact._grid_topk``.  A task holds its
queries, the lists of each, and the hits kept so far; the postings of its group stream by in list order, and each run of
a list is compared at once with the queries that probe it.  With ``Rings`` the lists of a query are those that it has
done already, and it probes the others that its bound lets it not skip.  Only the ids and distances of a task's top k leave it, so what
is shuffled grows with queries x groups x k, however many lists are probed and however long they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.operators.exact import BATCH_ROWS, GRID_PARTITIONS, grid_shape
from nnspark.operators.gather import measure
from nnspark.operators.kernels import batch_topk, list_matrix, ltr_sq_dist, near_pairs

HITS = "query_id long, id long, tag long, d2 double"
KEPT_ROWS = 1 << 20     # hits that wait before they are merged with those kept
PAIR_CELLS = 1 << 20    # distances computed at a time
RING_CELLS = 1 << 17    # the same where a query skips members
DENSE = 0.5             # share of a block's pairs within their rings from which all are compared
EVALUATED = -1          # tag of a row that has, as its id, the distances computed for the query


@dataclass
class Rings:
    """What a list without members within a query's bound is told by: rows by ascending list id."""

    list_ids: np.ndarray
    centroids: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray


class _Hits:
    """The ``k`` nearest hits (query, id, tag, d2) seen so far of every query of a block."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.worst = k, np.full(n_queries, np.inf)
        self.kept, self.waiting, self.n_waiting = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64)], [], 0

    def add(self, q: np.ndarray, ids: np.ndarray, tags: np.ndarray, d2: np.ndarray) -> None:
        near = ~(d2 > self.worst[q])
        self.waiting.append((q[near], ids[near], tags[near], d2[near]))
        self.n_waiting += len(self.waiting[-1][0])
        if self.n_waiting > max(KEPT_ROWS, len(self.kept[0])):
            self.merge()

    def merge(self) -> None:
        q, ids, tags, d2 = (np.concatenate(c) for c in zip(self.kept, *self.waiting))
        order = np.lexsort((ids, d2, q))
        q = q[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        order, q, rank = order[rank < self.k], q[rank < self.k], rank[rank < self.k]
        self.kept, self.waiting, self.n_waiting = [q, ids[order], tags[order], d2[order]], [], 0
        full = rank == self.k - 1
        self.worst[q[full]] = self.kept[3][full]


class _Block:
    """The queries of a cell with their lists, by list, and their bounds."""

    def __init__(self, asked: list, k: int, exclude_self: bool, rings: Rings | None):
        self.ids, self.Q, self.bound, lists, counts = (np.concatenate(c) for c in zip(*asked))
        by_list = np.argsort(lists, kind="stable")
        self.lists, self.rows = lists[by_list], np.repeat(np.arange(len(self.ids), dtype=np.int32), counts)[by_list]
        self.k, self.exclude_self, self.rings, self.at = k, exclude_self, rings, None
        self.hits, self.evaluated = _Hits(len(self.ids), k), np.zeros(len(self.ids), np.int64)
        if rings is not None:   # what lies beyond a query's bound is no hit
            self.hits.worst = np.square(self.bound) * (1 + 1e-9)

    def _probing(self, list_id: int) -> np.ndarray:
        rows = self.rows[slice(*np.searchsorted(self.lists, [list_id, list_id + 1]))]
        if self.rings is None:
            return rows
        i = np.searchsorted(self.rings.list_ids, list_id)
        self.away = np.sqrt(ltr_sq_dist(self.Q, self.rings.centroids[i]))
        open_ = (self.away - self.rings.farthest[i] <= self.bound) & (self.rings.nearest[i] - self.away <= self.bound)
        open_[rows] = False
        return np.flatnonzero(open_)

    def scan(self, list_id: int, ids: np.ndarray, tags: np.ndarray, away: np.ndarray, V: np.ndarray) -> None:
        if list_id != self.at:
            self.at, self.probing = list_id, self._probing(list_id)
        k = self.k + (int(np.unique(ids, return_counts=True)[1].max()) if self.exclude_self else 0)
        step = max(1, PAIR_CELLS // min(len(ids), k) if self.rings is None else RING_CELLS // len(ids))
        for lo in range(0, len(self.probing), step):
            part = self.probing[lo:lo + step]
            inside = None
            if self.rings is not None:
                inside = np.abs(away[None, :] - self.away[part, None]) <= self.bound[part, None]
            if inside is None or inside.mean() > DENSE:
                q, r, d2 = self._nearest(part, V, ids, k)
                np.add.at(self.evaluated, part, len(ids))
            else:
                q, r = np.nonzero(inside)
                d2 = ltr_sq_dist(self.Q[part[q]], V[r])
                self.evaluated[part] += inside.sum(axis=1)
            q = part[q].astype(np.int64)
            if self.exclude_self:
                other = self.ids[q] != ids[r]
                q, r, d2 = q[other], r[other], d2[other]
            self.hits.add(q, ids[r], tags[r], d2)

    def _nearest(self, part: np.ndarray, V: np.ndarray, ids: np.ndarray, k: int):
        """The k nearest of each query, or, where it has k hits already, those not farther than its k-th."""
        worst = self.hits.worst[part]
        full = np.isfinite(worst)
        found = []
        for some, near in ((np.flatnonzero(~full), False), (np.flatnonzero(full), True)):
            if len(some):
                q, r, d2 = near_pairs(self.Q[part[some]], V, worst[some]) if near else batch_topk(self.Q[part[some]], V, ids, k)
                found.append((some[q], r, d2))
        return tuple(np.concatenate(c) for c in zip(*found))

    def batches(self, counted: bool):
        if self.hits.waiting:
            self.hits.merge()
        q, ids, tags, d2 = self.hits.kept
        names = ["query_id", "id", "tag", "d2"]
        for lo in range(0, len(q), BATCH_ROWS):
            at = slice(lo, lo + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[q[at]], ids[at], tags[at], d2[at])], names=names)
        some = np.flatnonzero(self.evaluated) if counted else []
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[some]), pa.array(self.evaluated[some]), pa.array(np.full(len(some), EVALUATED)),
                 pa.nulls(len(some), pa.float64())], names=names)


def topk(postings: DataFrame, queries: DataFrame, probes: DataFrame, k: int, n_probes: int, exclude_self: bool = False) -> DataFrame:
    """``HITS``: at least the ``k`` nearest postings (list_id, id, tag, vec) of every query (query_id, qv) in the lists
    of ``probes`` (query_id, list_id), a few times over where posting groups are several.

    A list that ``probes`` names twice for a query counts twice.
    """
    wanted = queries.dropDuplicates(["query_id"]).join(probes.groupBy("query_id").agg(F.collect_list("list_id").alias("lists")), "query_id")
    return scan(postings.withColumn("away", F.lit(0.0)), wanted.withColumn("bound", F.lit(0.0)), k, n_probes, exclude_self)


def scan(postings: DataFrame, queries: DataFrame, k: int, n_probes: int, exclude_self: bool = False, rings: Rings | None = None,
         counted: bool = False) -> DataFrame:
    """``topk`` where each query row (query_id, qv, lists, bound) has its lists, and a posting (…, away) its distance
    to its centroid; with ``counted`` also a row tagged ``EVALUATED`` per query and task."""
    nq, dim = measure(queries, "qv")
    n, held_dim = measure(postings, "vec")
    dim = dim or held_dim
    n_blocks, n_groups = grid_shape(queries.sparkSession, nq * (dim * 8 + k * 64 + n_probes * 16), n * dim * 8)
    kind = dict(queries.dtypes)["qv"] if dict(queries.dtypes)["qv"] == dict(postings.dtypes)["vec"] else "array<double>"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select(hashed("query_id", n_blocks).alias("block"), every(n_groups).alias("group"), F.lit(-1).alias("list_id"),
                           F.col("query_id").alias("id"), F.lit(0).cast("long").alias("tag"), F.col("bound").alias("away"),
                           F.col("qv").cast(kind).alias("vec"), F.col("lists").cast("array<int>").alias("lists"))
    held = postings.select(every(n_blocks).alias("block"), hashed("id", n_groups).alias("group"), "list_id", "id", "tag", "away",
                           F.col("vec").cast(kind).alias("vec"), F.lit(None).cast("array<int>").alias("lists"))
    dealt = (asked.unionByName(held).repartition(min(2 * n_blocks * n_groups, GRID_PARTITIONS), "block", "group")
             .sortWithinPartitions("block", "group", "list_id"))
    shared = queries.sparkSession.sparkContext.broadcast(rings)

    def run(batches):
        at, asked, block = None, [], None
        for rb in batches:
            if not rb.num_rows:
                continue
            keys = [rb.column(c).to_numpy() for c in ("block", "group", "list_id")]
            ids, tags, away = (rb.column(c).to_numpy() for c in ("id", "tag", "away"))
            edges = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1), rb.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if (keys[0][lo], keys[1][lo]) != at:
                    if block is not None:
                        yield from block.batches(counted)
                    at, asked, block = (keys[0][lo], keys[1][lo]), [], None
                V = list_matrix(rb.column("vec").slice(lo, hi - lo), dim)
                if keys[2][lo] < 0:
                    lists = rb.column("lists").slice(lo, hi - lo)
                    asked.append((ids[lo:hi], V, away[lo:hi], lists.flatten().to_numpy(), lists.value_lengths().to_numpy()))
                elif asked or block is not None:
                    if block is None:
                        block, asked = _Block(asked, k, exclude_self, shared.value), []
                    block.scan(keys[2][lo], ids[lo:hi], tags[lo:hi], away[lo:hi], V)
        if block is not None:
            yield from block.batches(counted)

    return dealt.mapInArrow(run, HITS)
