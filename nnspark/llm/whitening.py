"""Whitening of embeddings: coordinates along the covariance's eigenvectors, each with variance one.

1. Entries become whole numbers, x = floor(64 c) + 1000000, so that counts, sums S and deviations n x - S are exact.
2. One pass sums x, a second one the products of the centred entries (n x - S) / n.  A task keeps one matrix and emits
   it once; Spark adds them up.  Only that matrix, dims x dims, reaches the driver.
3. There ``eigenpairs`` solves it: eigenvectors in single precision, corrected by the matrix-multiplication iteration of
   Ogita and Aishima in extended precision.  Eigenvalues closer than the iteration can tell apart form clusters; a
   cluster's part of the matrix, shifted by the cluster's mean, is solved by itself and turns its vectors.
4. A third pass measures the covariance of the whitened vectors against the identity, and ``transform`` adds the
   whitened vector to each row.

Defined results: vectors that are null, empty, or hold a null, a non-finite entry or one of 2^40 or more in size are
dropped; so are vectors of another width than most have (of equally frequent widths, the larger one counts).  Null and repeated ids are rows like any other.  Components
without variance are left out, so one vector, or equal vectors, have none; no vectors give an empty result.  A deviation
that a long cannot hold is null.  Further columns are carried by ``transform``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nnspark import ship
from nnspark.llm.common import TAG

SCALE = 64
SHIFT = 1_000_000
LARGEST = 2.0 ** 40
COMPONENTS = 32
MAX_ROUNDS = 40
SAFETY = 8      # an off-diagonal entry is divided by a gap at least so many times larger

_WIDE = np.longdouble


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of sorted ``values`` whose neighbours are at most ``near`` apart, where they hold two or more."""
    order = np.argsort(values)
    runs = np.split(order, np.flatnonzero(np.diff(values[order]) > near) + 1)
    return [r for r in runs if len(r) > 1]


def _turn_cluster(a: np.ndarray, x: np.ndarray, values: np.ndarray, members: np.ndarray) -> None:
    """Solve the cluster's own small problem, shifted so that its differences are not lost, and turn its vectors."""
    part = x[:, members]
    shift = values[members].mean()
    small = part.T @ (a @ part - shift * part)
    _, turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))
    turn = turn.astype(_WIDE)
    turn = turn + turn @ (np.eye(len(members), dtype=_WIDE) - turn.T @ turn) / 2
    x[:, members] = part @ turn


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix by falling eigenvalue, to double precision."""
    d = len(matrix)
    size = float(np.abs(matrix).max()) if d else 0.0
    if not size:
        return np.zeros(d), np.eye(d)
    a = matrix.astype(_WIDE) / _WIDE(size)
    _, start = np.linalg.eigh((matrix / size).astype(np.float32))
    x = start.astype(_WIDE)
    eye = np.eye(d, dtype=_WIDE)
    norm = float(np.linalg.norm(a.astype(np.float64), 2))
    tiny = float(np.finfo(np.float64).eps)
    floor = 64 * d * float(np.finfo(_WIDE).eps) * norm
    for _ in range(MAX_ROUNDS):
        lack = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding over a small gap costs orthogonality
        values = np.diag(s) / (1 - np.diag(lack))
        off = s - np.diag(np.diag(s))
        near = 2 * (np.linalg.norm(off.astype(np.float64)) + norm * np.linalg.norm(lack.astype(np.float64)))
        groups = _clusters(values, SAFETY * near)
        group = np.arange(d)
        for members in groups:
            group[members] = members[0]
        together = group[:, None] == group[None, :]
        gap = np.where(together, 1, values[None, :] - values[:, None])
        step = np.where(together, lack / 2, (s + values[None, :] * lack) / gap)
        x = x + x @ step
        for members in groups:
            _turn_cluster(a, x, values, members)
        if float(np.abs(step).max()) <= tiny / 4 and (not groups or near <= floor):
            break  # groups that are left are equal to the last digit: any basis of them will do
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * _WIDE(size)).astype(np.float64), x[:, order].astype(np.float64)


def _entries(col: pa.Array, width: int | None = None):
    """(kept rows, their entries x as long, widths of all kept rows' vectors); with ``width``, x is a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = col.offsets.to_numpy().astype(np.int64)
    values = col.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0]:offsets[-1]]
    size = np.diff(offsets)
    with np.errstate(invalid="ignore"):
        bad = np.concatenate(([0], np.cumsum(~(np.abs(flat) < LARGEST))))
    at = offsets - offsets[0]
    good = (bad[at[1:]] == bad[at[:-1]]) & (size > 0) & np.asarray(col.is_valid())
    if width is not None:
        good &= size == width
    rows = np.flatnonzero(good)
    kept = np.repeat(good, size)
    x = np.floor(SCALE * flat[kept]).astype(np.int64) + SHIFT
    return rows, (x.reshape(-1, width) if width is not None else x), size[rows]


def _sum_entries(batches):
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        _, x, sizes = _entries(batch.column(0))
        start = np.concatenate(([0], np.cumsum(sizes)))
        for width in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == width)
            part = x[start[rows][:, None] + np.arange(width)]
            n, total = found.get(width, (0, np.zeros(width, np.int64)))
            found[width] = n + len(rows), total + part.sum(axis=0)
    for width, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))],
            names=["width", "n", "total"])


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once: the numerator is exact."""
    return (n * x - total).astype(np.float64) / n


def _sum_products(make_rows):
    """A task's sum of products of the rows that ``make_rows`` returns, one output row per matrix row."""
    def run(batches):
        products = None
        for batch in batches:
            r = make_rows(batch.column(0))
            if len(r):
                products = r.T @ r if products is None else products + r.T @ r
        if products is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(products), dtype=np.int32)), pa.array(products.tolist(), pa.list_(pa.float64()))],
                names=["i", "products"])
    return run


def _product_sum(vectors: DataFrame, make_rows, width: int) -> np.ndarray:
    """Sum over all tasks, brought to the driver: width x width numbers."""
    parts = vectors.mapInArrow(_sum_products(make_rows), "i int, products array<double>")
    cells = parts.select("i", F.posexplode("products").alias("j", "v")).filter("j >= i").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


@dataclass
class Whitening:
    n: int
    total: np.ndarray          # sums of x, exact
    projection: np.ndarray     # width x components: eigenvectors over the root of their eigenvalue
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.total)


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of ``vectors``; None if there are none."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(f"`{vec_col}`").alias("v"))
    sums = v.mapInArrow(_sum_entries, "width int, n long, total array<long>")
    most = sums.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return None
    n, width = most["n"], most["width"]
    cells = sums.filter(F.col("width") == width).select(F.posexplode("total").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"))
    total = np.zeros(width, np.int64)
    for r in cells.collect():
        total[r["j"]] = r["v"]
    covariance = _product_sum(v, lambda col: _centred(_entries(col, width)[1], n, total), width) / n
    values, directions = eigenpairs(covariance)
    varied = values > values[0] * width * np.finfo(np.float64).eps
    k = min(components, int(varied.sum()))
    found = Whitening(n, total, directions[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(covariance) if k else np.zeros(0))
    if k:
        projection = found.projection
        check = _product_sum(v, lambda col: _centred(_entries(col, width)[1], n, total) @ projection, k) / n
        found.identity_error = float(np.abs(check - np.eye(k)).max())
    return found


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> pa.Array:
    """Sum of (n x - S)^2 per row, exact; null where it needs more than a long."""
    d = n * x - total
    if not len(d) or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0 ** 62:
        return pa.array((d * d).sum(axis=1), pa.int64())
    exact = [sum(e * e for e in row) for row in d.tolist()]
    return pa.array([e if e < 2 ** 63 else None for e in exact], pa.int64())


def transform(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> DataFrame:
    """The rows of ``vectors`` that have a whitened form, plus ``TAG``: a struct of deviation and whitened (array)."""
    names = list(vectors.columns)
    inner = vectors.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{vec_col}`").alias("v"))
    schema = T.StructType([*inner.schema.fields[:-1], *T._parse_datatype_string("deviation long, whitened array<double>").fields])
    n, total, projection = model.n, model.total, model.projection
    width, fields = model.width, schema.fieldNames()

    def run(batches):
        for batch in batches:
            rows, x, _ = _entries(batch.column(len(names)), width)
            if not len(rows):
                continue
            white = _centred(x, n, total) @ projection
            k = white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * k + 1, max(k, 1), dtype=np.int32) if k
                                                      else np.zeros(len(rows) + 1, np.int32)), pa.array(white.ravel()))
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*[c.take(taken) for c in batch.columns[:len(names)]], _deviations(x, n, total), lists],
                                             names=fields)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.struct("deviation", "whitened").alias(TAG))


ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, vec_col, components)
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    if model is None:
        fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ROWS).fields]
        return rows.limit(0).select("vec_id", *fields)
    shares = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.expr("cast(array() as array<double>)")
    white = transform(rows, model, "v").select("vec_id", f"{TAG}.deviation", F.posexplode(f"{TAG}.whitened").alias("at", "whitened"))
    return white.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                        "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
                        F.lit(model.identity_error).alias("identity_error"))
