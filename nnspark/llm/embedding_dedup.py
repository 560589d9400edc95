"""Embedding near-duplicates by an exact metric range join (operator 2).

Vectors of one label (and one length) are compared by cosine; on unit vectors cosine >= ``threshold`` is a
Euclidean distance of at most r = sqrt(2 - 2 * threshold).

1. Equal vectors collapse into a class with a count.
2. Pivots, the home classes of lowest hash, split a cell that holds more than ``CELL`` classes.  A class's home is the
   cell of its nearest pivot; the triangle inequality says which other cells can hold
   the home of a neighbour (their pivot is at most 2r further away, and the class is
   within r of the bisector), and it is replicated there.  Cells split again while
   that at least halves the comparisons without replicating more than ``MAX_COPIES``
   times; a cell for which it does not (a dense group, or directions without
   structure) stays whole.
3. Every cell is joined on its own: its home classes, in blocks of ``BLOCK``, against all its
   members, as matrix products in double precision.  Home classes see all
   their neighbours, so links are counted without another shuffle, and no pair is ever
   emitted: a block gives counts per class and a spanning forest of its links.
4. Components of the forests' edges come from written star rounds.

Pivots travel to the points with the shuffle (they sort before the points of their cell),
so nothing is broadcast or collected, and crowded cells are salted.

Defined cases: null, empty or zero vectors, and vectors with null or non-finite components, link with nothing;
nor do vectors with a null label or a null id.  Vectors of different lengths never link.
Repeated rows are separate vectors of one class (rows of one id are one node); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nnspark.llm.common import connected_components, cut, drop_table, spanning_forest

THRESHOLD = 0.98
CELL = 4096
BLOCK = 4096
PIVOTS = 16
MAX_COPIES = 4.0
SALT_ROWS = 32_768
CHUNK = 512
SLACK = 1e-9


def _unit(vectors) -> np.ndarray:
    """Unit vectors (double) of an Arrow list slice whose vectors have one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def comparable(vec: Column) -> Column:
    """Whether a vector has a direction: not null or zero, all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _runs(*keys: np.ndarray):
    """(begin, end) of stretches of equal keys."""
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys[0])]))
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def _assign(radius: float):
    """Points after their cell's pivots -> one row per (point, child cell)."""
    def run(batches):
        import pyarrow as pa

        at, pivots, apart = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cell, salt = (col[n].to_numpy() for n in ("cell", "salt"))
            role = col["role"].to_numpy()
            for lo, hi in _runs(cell, salt, role):
                x = _unit(col["vec"].slice(lo, hi - lo))
                if role[lo] == 0:
                    if (cell[lo], salt[lo]) != at:
                        at, pivots = (cell[lo], salt[lo]), x
                    else:  # a cell's pivots may end in another batch
                        pivots = np.vstack((pivots, x))
                    apart = None
                    continue
                if (cell[lo], salt[lo]) != at:
                    raise ValueError("a cell's points came without its pivots")
                if apart is None:
                    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
                d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
                own = d.argmin(axis=1)
                near = d[np.arange(len(d)), own][:, None]
                to = apart[own]
                # d(v, q) - d(v, p) <= 2r, and within r of the bisector of p and q
                goes = (d <= near + 2 * radius + SLACK) & ((d * d - near * near) <= 2 * to * (radius + SLACK) + SLACK)
                goes[np.arange(len(d)), own] = True
                row, child = np.nonzero(goes)
                take = pa.array(row + lo)
                home = col["home"].take(take).to_numpy(zero_copy_only=False) & (child == own[row])
                yield pa.RecordBatch.from_arrays(
                    [col["cell"].take(take), pa.array(child.astype(np.int32)), pa.array(home),
                     *[col[n].take(take) for n in ("size", "k1", "k2", "rep", "n", "vec")]],
                    names=["cell", "child", "home", "size", "k1", "k2", "rep", "n", "vec"])

    return run


def _join(threshold: float):
    """Home block rows, then all members of the cell -> link counts (kind 0) and forest edges (kind 1)."""
    def run(batches):
        import pyarrow as pa

        block = None

        def closed():
            if block is None:
                return
            k1, k2, rep, x, total, linked = block
            i, j = np.nonzero(linked)
            a, b = spanning_forest(rep[i], rep[j])
            zero = np.zeros(len(a), np.int64)
            for kind, c in ((0, (k1, k2, total, total)), (1, (a, b, zero, zero))):
                if len(c[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(c[0]), kind, np.int32)), *[pa.array(v) for v in c[:3]]], names=["kind", "a", "b", "links"])

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cell, part, role = (col[n].to_numpy() for n in ("cell", "part", "role"))
            k1, k2, rep, n = (col[c].to_numpy() for c in ("k1", "k2", "rep", "n"))
            for lo, hi in _runs(cell, part, role):
                x = _unit(col["vec"].slice(lo, hi - lo))
                if role[lo] == 0:
                    if (cell[lo], part[lo]) != at:
                        yield from closed()
                        at = (cell[lo], part[lo])
                        parts = [(k1[lo:hi], k2[lo:hi], rep[lo:hi], x)]
                    else:
                        parts.append((k1[lo:hi], k2[lo:hi], rep[lo:hi], x))
                    columns = [np.concatenate(c) for c in zip(*parts)]
                    h = len(columns[0])
                    block = (*columns, np.zeros(h, np.int64), np.zeros((h, h), bool))
                    continue
                _, _, reps, home, total, linked = block
                for s in range(lo, hi, CHUNK):
                    e = min(hi, s + CHUNK)
                    close = home @ x[s - lo:e - lo].T >= threshold
                    total += close @ n[s:e]
                    first = close.argmax(axis=0)
                    some = close[first, np.arange(e - s)]
                    i, j = np.nonzero(close)
                    linked[i, first[j]] = True
                    a, b = reps[first[some]], rep[s:e][some]
                    apart = a != b
                    if apart.any():
                        zero = np.zeros(int(apart.sum()), np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.ones(len(zero), np.int32)), pa.array(a[apart]), pa.array(b[apart]), pa.array(zero)],
                            names=["kind", "a", "b", "links"])
        yield from closed()

    return run


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row with its content key, and one row per distinct comparable vector of a label."""
    vec = F.col(vec_col)
    valid = comparable(vec) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    key = [F.when(valid, F.xxhash64(F.lit(seed), F.col(label_col), vec)) for seed in (1, 2)]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"),
                          key[0].alias("k1"), key[1].alias("k2"))
    found = (rows.filter("k1 is not null").groupBy("label", "k1", "k2")
             .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")))
    cell = F.xxhash64("label", F.size("vec"))
    return rows.select("id", "k1", "k2"), found.select(
        cell.alias("cell"), F.lit(True).alias("home"), "k1", "k2", "rep", "n", "vec")


def cells(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes dealt to the cells that are joined, with replicas (``home`` false)."""
    spark = found.sparkSession
    radius = math.sqrt(2 - 2 * threshold)
    columns = ["cell", "home", "k1", "k2", "rep", "n", "vec"]
    state, _ = cut(found, "vectors-cells")
    done: list[DataFrame] = []
    level = 0
    while True:
        level += 1
        sizes = state.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.count_if("home").alias("homes"))
        large, large_path = cut(sizes.filter(F.col("size") > CELL), "vectors-large")
        if large.isEmpty():
            drop_table(spark, large_path)
            done.append(state)
            break
        done.append(state.join(large.select("cell"), "cell", "left_anti").select(*columns))
        # a cell that is all replicas but for one home has nothing to split and stays whole
        points = state.join(large.filter("homes > 1").drop("homes"), "cell")
        # the lowest hashes among a cell's homes; Spark takes the lowest of every task before it shuffles
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("k1", "k2", F.lit(level)), "k1", "k2"))
        pivots = points.filter("home").withColumn("place", place).filter(F.col("place") <= PIVOTS)
        salts = F.ceil(F.col("size") / SALT_ROWS).cast("int")
        dealt = points.select(*columns, "size", F.lit(1).alias("role"), F.pmod(F.xxhash64("k2"), salts).cast("int").alias("salt"))
        leads = pivots.select(*columns, "size", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        split, _ = cut(
            dealt.union(leads).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "role")
            .mapInArrow(_assign(radius), "cell bigint, child int, home boolean, size bigint, k1 bigint, k2 bigint, "
                                         f"rep {dict(found.dtypes)['rep']}, n bigint, vec {dict(found.dtypes)['vec']}"), "vectors-split")
        gain = (split.groupBy("cell", "size", "child").agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("h"))
                .groupBy("cell", "size").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("h")).alias("after"), F.sum("h").alias("homes")))
        better = (F.col("rows") <= MAX_COPIES * F.col("size")) & (2 * F.col("after") <= F.col("size") * F.col("homes"))
        kept, _ = cut(gain.filter(better).select("cell"), "vectors-kept")
        done.append(state.join(large.select("cell"), "cell", "left_semi").join(kept, "cell", "left_anti").select(*columns))
        state, _ = cut(split.join(kept, "cell", "left_semi").withColumn("cell", F.xxhash64("cell", "child", F.lit(level))).select(*columns), "vectors-cells")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def links(found: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, n_links) per class, and edges (a, b) of ids that connect all linked vectors."""
    dealt, _ = cut(cells(found, threshold), "vectors-dealt")
    parts = dealt.filter("home").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = dealt.join(parts, "cell")
    columns = ["cell", "k1", "k2", "rep", "n", "vec"]
    homes = rows.filter("home").select(*columns, F.lit(0).alias("role"), F.pmod(F.xxhash64("k1", "k2"), "parts").cast("int").alias("part"))
    members = rows.select(*columns, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # a block without homes has no use for members: hashing may leave one empty
    used = homes.select("cell", "part").distinct()
    members = members.join(used, ["cell", "part"], "left_semi").select(*homes.columns)
    joined = (homes.union(members).repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
              .mapInArrow(_join(threshold), "kind int, a bigint, b bigint, links bigint"))
    out, _ = cut(joined, "vectors-links")
    counts = out.filter("kind = 0").select(F.col("a").alias("k1"), F.col("b").alias("k2"), (F.col("links") - 1).alias("n_links"))
    return counts, out.filter("kind = 1").select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: id, n_links, component_id (smallest linked id, itself included), kept."""
    rows, found = classes(vectors, id_col, vec_col, label_col)
    found, _ = cut(found.withColumn("rep", F.col("rep").cast("long")), "vectors-classes")
    counts, edges = links(found, threshold)
    parent = connected_components(edges)
    named = (found.select("k1", "k2", "rep").join(counts, ["k1", "k2"]).join(parent, found["rep"] == parent["node"], "left")
             .select("k1", "k2", "n_links", F.coalesce("component", "rep").alias("component")))
    of, _ = cut(named, "vectors-components")
    component = F.coalesce("component", F.col("id").cast("long"))
    return rows.join(of, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
