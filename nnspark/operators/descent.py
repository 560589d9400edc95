"""Neighbour lists by neighbour descent (after Dong, Moses and Li, 2011), without comparing all pairs.

A vector's list starts with vectors that fall on the same side of some random planes.  Each round, every vector
looks at pairs among its neighbours and the vectors that have it as a neighbour: neighbours of a vector are likely
to be neighbours of each other.  A pair is looked at when at least one of the two came in since it was last a member,
so the work falls as the lists settle.  Rounds end when they change next to nothing.

Plan of a round: members of each centre (forward and reverse, ``sample`` of each kind, chosen by hash) by two windows
whose row limits apply before their shuffles, so that a vector that is a neighbour of very many is no hot key;
member vectors by a join on the id; one kernel call per centre, which emits only distances that beat the member's
worst; a group by (src, dst) and a window keep the best ``k``.  Each round is a written table.  Where the vectors and the
members fit ``held.HELD_BYTES``, tasks hold both: each vector looks up whom it meets, so no vector is joined and at most
``k`` distances a vector leave a task, with the same lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from nnspark.operators import held
from nnspark.operators.kernels import list_matrix, ltr_sq_dist
from nnspark.session import scratch_path

LEAF = 32             # vectors compared with each other at the start
STARTS = 2            # times that the vectors are dealt into such groups
SAMPLE = 10           # members of each kind a centre takes in a round
SETTLED = 0.02        # share of list places below which a round's changes end the descent
LISTS = "src long, dst long, d2 double"


@dataclass
class Descent:
    lists: DataFrame      # src, dst, d2: the nearest found
    evaluations: int      # distances computed
    rounds: int


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _signatures(vectors: DataFrame, planes: int, dim: int, seed: int) -> DataFrame:
    """``vectors`` with the side of each of ``planes`` random planes, as a number."""
    normals = np.random.default_rng(seed).normal(size=(dim, planes))
    weights = (1 << np.arange(planes)).astype(np.int64)

    def run(batches):
        for rb in batches:
            side = (list_matrix(rb.column("vec"), dim) @ normals > 0) @ weights if rb.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("vec"), pa.array(side.astype(np.int64))],
                                             names=["id", "vec", "sig"])

    return vectors.select("id", "vec").mapInArrow(run, vectors.select("id", "vec").schema.add("sig", "long"))


def _within(k: int):
    """The ``k`` nearest of each vector among those of its group."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        X = list_matrix(table.column("vec"))
        src, dst, d2 = [], [], []
        for i in range(len(ids)):
            d = ltr_sq_dist(X[i], X)
            order = np.lexsort((ids, d))
            order = order[order != i][:k]
            src.append(np.full(len(order), ids[i]))
            dst.append(ids[order])
            d2.append(d[order])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "d2": np.concatenate(d2)})
    return run


def _best(lists: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("src").orderBy("d2", "dst")
    return lists.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).drop("r")


def _starts(vectors: DataFrame, k: int, n: int, dim: int, leaf: int, starts: int):
    """First lists, and the distances that they took."""
    planes = max(0, int(math.log2(max(1, n / leaf))))
    parts, taken = [], 0
    for s in range(starts):
        dealt = _signatures(vectors, planes, dim, s)
        # a crowded side is cut by hash, so that a group stays near ``leaf``, however the vectors lie
        sizes = dealt.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
        cut = F.ceil(F.col("n") / leaf).cast("long")
        grouped = dealt.join(sizes.select("sig", cut.alias("parts")), "sig").withColumn(
            "part", F.pmod(F.xxhash64("id", F.lit(s)), F.col("parts")))
        counted = grouped.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("c")).select(F.sum(F.expr("c * (c - 1) / 2"))).first()[0]
        taken += int(counted or 0)
        parts.append(grouped.groupBy("sig", "part").applyInArrow(_within(k), LISTS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _best(out.groupBy("src", "dst").agg(F.min("d2").alias("d2")), k), taken


def _sampled(edges: DataFrame, centre: str, member: str, sample: int, salt: int) -> DataFrame:
    """At most ``sample`` fresh and ``sample`` older members of each centre, by hash."""
    drawn = Window.partitionBy(centre, "fresh").orderBy(F.xxhash64("src", "dst", F.lit(salt)))
    return edges.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= sample).select(
        F.col(centre).alias("centre"), F.col(member).alias("member"), "fresh")


def _pairs(batches):
    """Distances among a centre's members that beat the worst place of one of the two."""
    for rb in batches:
        out = []
        offsets = rb.column("members").offsets.to_numpy()
        rows = rb.column("members").flatten()
        ids, fresh = rows.field("member").to_numpy(), rows.field("fresh").to_numpy(zero_copy_only=False)
        worst = rows.field("worst").to_numpy()
        X = list_matrix(rows.field("vec")) if len(rows) else None
        for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]):
            order = np.lexsort((ids[a:b], ~fresh[a:b])) + a      # fresh members first
            n_new = int(fresh[a:b].sum())
            if b - a < 2 or not n_new:
                continue
            new = order[:n_new]
            d = ltr_sq_dist(X[new][:, None, :], X[order][None, :, :])
            i, j = np.nonzero(np.arange(len(order))[None, :] > np.arange(n_new)[:, None])
            d, u, v = d[i, j], new[i], order[j]
            for x, y in ((u, v), (v, u)):
                better = d < worst[x]
                out.append((ids[x[better]], ids[y[better]], d[better]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["src", "dst", "d2"])


def _held_rounds(vectors: DataFrame, lists: DataFrame, k: int, n: int, sample: int, settled: float, evaluations: int) -> Descent:
    """The rounds of ``neighbour_lists`` where tasks hold all vectors, and the members of a round."""
    spark, rounds = vectors.sparkSession, 0
    shared = spark.sparkContext.broadcast(held.gather(vectors))
    first = lists.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("d2", "dst"))).alias("l"))
    lists = _written(vectors.select(F.col("id").alias("src")).join(first, "src", "left").select(
        "src", F.coalesce("l.dst", F.array().cast("array<long>")).alias("dst"), F.coalesce("l.d2", F.array().cast("array<double>")).alias("d2"),
        F.coalesce(F.transform("l", lambda e: F.lit(True)), F.array().cast("array<boolean>")).alias("fresh")), "descent-lists")
    while True:
        rounds += 1
        rows = lists.select(F.col("src").alias("key"), F.col("dst").alias("members"), F.col("fresh").alias("flags"))
        met = held.members(spark, shared.value.ids, held.gather_lists(rows, shared, len(shared.value.ids)), sample, rounds)
        evaluations += held.pairs_met(*met)
        met = spark.sparkContext.broadcast(met)
        lists = _written(held.descend(lists, shared, met, k, sample, rounds), "descent-lists")
        met.destroy()
        if (lists.agg(F.sum("come")).first()[0] or 0) <= settled * n * k:
            break
    shared.destroy()
    rows = lists.select("src", F.explode(F.arrays_zip("dst", "d2")).alias("e")).select("src", "e.dst", "e.d2")
    return Descent(rows, evaluations, rounds)


def neighbour_lists(vectors: DataFrame, k: int, *, sample: int = SAMPLE, leaf: int = LEAF, starts: int = STARTS,
                    settled: float = SETTLED) -> Descent:
    """The ``k`` nearest other vectors of every row of ``vectors`` (id, vec), as far as the descent finds them.

    Null vectors take no part; ids are distinct.  A table of up to ``leaf`` vectors is compared whole, so its lists are exact.
    """
    vectors = _written(vectors.where(F.col("vec").isNotNull()).select("id", "vec"), "descent-vectors")
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, dim = shape["n"], shape["d"] or 0
    first, evaluations = _starts(vectors, k, n, dim, max(leaf, 2), starts if n > leaf else 1)
    lists = _written(first.withColumn("fresh", F.lit(True)), "descent-lists")
    if n > leaf and held.vector_bytes(vectors, n, dim) + 16 * sample * n <= held.HELD_BYTES:
        return _held_rounds(vectors, lists, k, n, sample, settled, evaluations)
    rounds = 0
    while n > leaf:
        rounds += 1
        forward = _sampled(lists, "src", "dst", sample, rounds)
        reverse = _sampled(lists, "dst", "src", sample, rounds)
        members = forward.unionByName(reverse).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
        state = vectors.join(lists.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.max("d2").alias("d")),
                             F.col("id") == F.col("src"), "left").select(
            F.col("id").alias("member"), "vec", F.when(F.col("c") >= k, F.col("d")).otherwise(float("inf")).alias("worst"))
        sizes = Observation()
        new, old = F.count_if("m.fresh"), F.count_if(~F.col("m.fresh"))
        centres = members.join(state, "member").select("centre", F.struct("member", "fresh", "worst", "vec").alias("m")).groupBy(
            "centre").agg(F.collect_list("m").alias("members"), new.alias("new"), old.alias("old")).where("new > 0")
        centres = centres.observe(sizes, F.sum(F.expr("new * (new - 1) / 2 + new * old")).alias("pairs"))
        found = centres.select("members").mapInArrow(_pairs, LISTS)
        # fresh members that were drawn are older from now on
        drawn = forward.where("fresh").select(F.col("centre").alias("src"), F.col("member").alias("dst"), F.lit(True).alias("drawn"))
        kept = lists.join(drawn, ["src", "dst"], "left").select(
            "src", "dst", "d2", F.struct(F.lit(0).alias("come"), (F.col("fresh") & F.col("drawn").isNull()).alias("fresh")).alias("s"))
        came = found.select("src", "dst", "d2", F.struct(F.lit(1).alias("come"), F.lit(True).alias("fresh")).alias("s"))
        merged = kept.unionByName(came).groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.min("s").alias("s"))
        lists = _written(_best(merged, k).select("src", "dst", "d2", "s.fresh", "s.come"), "descent-lists")
        changed = lists.agg(F.sum("come")).first()[0] or 0
        evaluations += int(sizes.get["pairs"] or 0)
        lists = lists.drop("come")
        if changed <= settled * n * k:
            break
    return Descent(lists.select("src", "dst", "d2"), evaluations, rounds)
