"""Per-batch numpy kernels used inside ``mapInArrow``.

Spark partitions and shuffles the work; these functions only turn one Arrow
batch of vectors into a small result (a partial top-k, an arg-min, partial
sums), so what leaves each task is bounded by queries x k or by the number of
centroids, never by the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Cells of the largest array of a step (rows x columns of distances, rows x shortlist x dimension of vectors); rows
# are handled in steps that keep to it, however few or many the columns are.
_MAX_BLOCK_CELLS = 2_000_000


def list_matrix(arr, dim: int | None = None) -> np.ndarray:
    """A list<float> Arrow column with equal lengths -> (rows, dim) float64."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    if arr.null_count:
        raise ValueError("null vector in a vector column; filter nulls first")
    offsets = np.asarray(arr.offsets)
    lengths = np.diff(offsets)
    d = int(lengths[0])
    if dim is not None and d != dim:
        raise ValueError(f"vector length {d} does not match dimension {dim}")
    if not np.all(lengths == d):
        raise ValueError("vectors of different lengths in one column")
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(n, d)


def ltr_sq_dist(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared L2 over the last axis, summed left to right in double.

    Same summation order as ``aggregate(zip_with(...), 0D, (s, x) -> s + x)``
    in Spark and ``list_sum`` in the SQL oracle, so results are bit-equal.
    """
    diff = q - v
    acc = np.zeros(diff.shape[:-1], dtype=np.float64)
    for j in range(diff.shape[-1]):
        dj = diff[..., j]
        acc += dj * dj
    return acc


def _rank_rows(d2: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column order of the k smallest (d2, id) per row."""
    order = np.lexsort((ids, d2), axis=-1)
    return order[:, :k]


def batch_topk(Q: np.ndarray, V: np.ndarray, ids: np.ndarray, k: int, slack: int = 8):
    """Exact top-k of every query row of Q over the rows of V.

    Shortlist by the product form |q|^2 + |v|^2 - 2 q.v, then recompute the
    shortlist exactly.  A query whose shortlist boundary is within rounding
    error of its k-th value is recomputed over the whole batch, so the result
    is always the exact (distance, id) order.

    Returns (query_pos, row_pos, d2) arrays of length Q * min(k, B).
    """
    nq, B = Q.shape[0], V.shape[0]
    kk = min(k, B)
    if nq == 0 or B == 0 or kk == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.float64)
    qn = np.einsum("ij,ij->i", Q, Q)
    vn = np.einsum("ij,ij->i", V, V)
    m = min(B, kk + slack)
    step = max(1, _MAX_BLOCK_CELLS // max(B, m * Q.shape[1]))
    out_q, out_r, out_d = [], [], []
    for s in range(0, nq, step):
        Qb = Q[s : s + step]
        nb = Qb.shape[0]
        if m < B:
            P = qn[s : s + step, None] + vn[None, :] - 2.0 * (Qb @ V.T)
            part = np.argpartition(P, m - 1, axis=1)[:, :m]
            pv = np.sort(np.take_along_axis(P, part, 1), axis=1)
            tol = 1e-9 * (1.0 + qn[s : s + step] + vn.max())
            risky = np.nonzero(pv[:, m - 1] - pv[:, kk - 1] <= 2.0 * tol)[0]
            cand = part
        else:
            risky = np.zeros(0, dtype=np.int64)
            cand = np.broadcast_to(np.arange(B), (nb, B))
        d2 = ltr_sq_dist(Qb[:, None, :], V[cand])
        sel = _rank_rows(d2, ids[cand], kk)
        rows = np.take_along_axis(cand, sel, 1)
        dsel = np.take_along_axis(d2, sel, 1)
        if len(risky):
            rows = rows.copy()
            dsel = dsel.copy()
            for i in risky:
                full = ltr_sq_dist(Qb[i][None, :], V)
                o = np.lexsort((ids, full))[:kk]
                rows[i] = o
                dsel[i] = full[o]
        out_q.append(np.repeat(np.arange(s, s + nb), kk))
        out_r.append(rows.reshape(-1))
        out_d.append(dsel.reshape(-1))
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


def near_pairs(Q: np.ndarray, V: np.ndarray, worst: np.ndarray):
    """(query_pos, row_pos, d2) of the pairs whose distance is not above the query's ``worst``, by query, then row.

    Single-precision products rule pairs out, with a margin that exceeds their rounding; distances of the others are
    those of ``ltr_sq_dist``.  Values beyond single precision are compared one by one.
    """
    nq, n = len(Q), len(V)
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not nq or not n:
        return empty
    qn, vn = np.einsum("ij,ij->i", Q, Q), np.einsum("ij,ij->i", V, V)
    plain = bool(qn.max() < 1e30 and vn.max() < 1e30)   # not so with a NaN
    if plain:
        left = np.empty((nq, Q.shape[1] + 1), np.float32)
        left[:, :-1], left[:, -1] = Q, 1
        right = np.empty((Q.shape[1] + 1, n), np.float32)
        right[:-1], right[-1] = -2 * V.T, vn
        margin = (Q.shape[1] + 8) * np.finfo(np.float32).eps * (qn + 2 * vn.max() + np.where(np.isfinite(worst), worst, 0)) + 1e-30
        with np.errstate(over="ignore"):
            bound = (worst - qn + margin).astype(np.float32)
    step, block = max(1, _MAX_BLOCK_CELLS // n), max(1, _MAX_BLOCK_CELLS // max(1, 8 * Q.shape[1]))
    out = []
    for lo in range(0, nq, step):
        if plain:
            cells = np.flatnonzero(left[lo:lo + step] @ right <= bound[lo:lo + step, None])
        else:
            cells = np.arange(min(step, nq - lo) * n)
        for b in range(0, len(cells), block):
            q, r = np.divmod(cells[b:b + block], n)
            q += lo
            d2 = ltr_sq_dist(Q[q], V[r])
            near = ~(d2 > worst[q])
            out.append((q[near], r[near], d2[near]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else empty


def nearest_rows(X: np.ndarray, C: np.ndarray, n: int = 1):
    """For each row of X, the n nearest rows of C by exact (distance, index).

    Returns (positions (rows, n), squared distances (rows, n)).
    """
    rows = X.shape[0]
    nc = C.shape[0]
    n = min(n, nc)
    if rows == 0 or nc == 0:
        return np.zeros((rows, 0), dtype=np.int64), np.zeros((rows, 0))
    idx = np.arange(nc)
    pos_parts, d_parts = [], []
    cn = np.einsum("ij,ij->i", C, C)
    slack = 4
    m = min(nc, n + slack)
    step = max(1, _MAX_BLOCK_CELLS // max(nc, m * X.shape[1]))
    for s in range(0, rows, step):
        Xb = X[s : s + step]
        xn = np.einsum("ij,ij->i", Xb, Xb)
        if m < nc:
            P = xn[:, None] + cn[None, :] - 2.0 * (Xb @ C.T)
            part = np.argpartition(P, m - 1, axis=1)[:, :m]
            pv = np.sort(np.take_along_axis(P, part, 1), axis=1)
            tol = 1e-9 * (1.0 + xn + cn.max())
            risky = np.nonzero(pv[:, m - 1] - pv[:, n - 1] <= 2.0 * tol)[0]
            cand = part
        else:
            risky = np.zeros(0, dtype=np.int64)
            cand = np.broadcast_to(idx, (Xb.shape[0], nc))
        d2 = ltr_sq_dist(Xb[:, None, :], C[cand])
        sel = _rank_rows(d2, cand, n)
        pos = np.take_along_axis(cand, sel, 1)
        dd = np.take_along_axis(d2, sel, 1)
        if len(risky):
            pos = pos.copy()
            dd = dd.copy()
            for i in risky:
                full = ltr_sq_dist(Xb[i][None, :], C)
                o = np.lexsort((idx, full))[:n]
                pos[i] = o
                dd[i] = full[o]
        pos_parts.append(pos)
        d_parts.append(dd)
    return np.concatenate(pos_parts), np.concatenate(d_parts)


def with_sq_l2(df, pairs, keep=None):
    """Add squared L2 columns for row-wise vector pairs with a numpy kernel.

    ``pairs`` is a list of (left vector column, right vector column, output
    column).  Output is NULL where either vector is NULL.  Same left-to-right
    summation as ``functions.distance.sq_l2``, so values are identical; the
    kernel avoids interpreted higher-order functions on the per-pair hot path.
    """
    from pyspark.sql import types as T

    vec_cols = {c for a, b, _ in pairs for c in (a, b)}
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in vec_cols]
    in_cols = keep + [c for c in dict.fromkeys(c for a, b, _ in pairs for c in (a, b)) if c not in keep]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(o, T.DoubleType()) for _, _, o in pairs])
    names = keep + [o for _, _, o in pairs]

    def run(batches):
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            outs = []
            for a, b, _ in pairs:
                ca, cb = rb.column(a), rb.column(b)
                valid = ~(np.asarray(ca.is_null()) | np.asarray(cb.is_null()))
                d = np.full(n, np.nan)
                if valid.all():
                    d = ltr_sq_dist(list_matrix(ca), list_matrix(cb))
                elif valid.any():
                    idx = pa.array(np.nonzero(valid)[0])
                    d[valid] = ltr_sq_dist(list_matrix(ca.take(idx)), list_matrix(cb.take(idx)))
                outs.append(pa.array(d, mask=~valid))
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + outs, names=names)

    return df.select(*in_cols).mapInArrow(run, schema)


def with_query_sq_l2(df, qids: np.ndarray, Q: np.ndarray, pairs, keep, query_col: str = "query_id"):
    """Like ``with_sq_l2`` but the left vector is the query's, looked up by
    ``query_col`` in a broadcast (ids sorted, matrix) pair, so candidate rows
    never carry a copy of the query vector.  ``pairs`` is a list of
    (vector column, output column)."""
    from pyspark.sql import types as T

    sc = df.sparkSession.sparkContext
    bq = sc.broadcast((qids, Q))
    in_cols = list(dict.fromkeys(list(keep) + [query_col] + [c for c, _ in pairs]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(o, T.DoubleType()) for _, o in pairs])
    names = list(keep) + [o for _, o in pairs]

    def run(batches):
        ids, qm = bq.value
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            qpos = np.searchsorted(ids, rb.column(query_col).to_numpy(zero_copy_only=False))
            outs = []
            for c, _ in pairs:
                col = rb.column(c)
                valid = ~np.asarray(col.is_null())
                d = np.full(n, np.nan)
                if valid.all():
                    d = ltr_sq_dist(qm[qpos], list_matrix(col))
                elif valid.any():
                    idx = np.nonzero(valid)[0]
                    d[valid] = ltr_sq_dist(qm[qpos[idx]], list_matrix(col.take(pa.array(idx))))
                outs.append(pa.array(d, mask=~valid))
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + outs, names=names)

    return df.select(*in_cols).mapInArrow(run, schema)
