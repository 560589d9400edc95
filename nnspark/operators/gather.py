"""Size-checked gathering of small tables for broadcast.

Only tables with a proven size bound are broadcast: the row count and vector
width are measured first and compared with a budget.  Callers that can exceed
the budget split the work into blocks that each fit (see ``exact.py``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.operators.kernels import list_matrix

# Default budget for one broadcast vector block (bytes, as float64 in Python).
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


class BroadcastTooLarge(ValueError):
    pass


def measure(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """(rows, dimension) of a vector table in one aggregate job."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(vec_col)).alias("dmax"),
        F.min(F.size(vec_col)).alias("dmin"),
    ).first()
    n = int(row["n"] or 0)
    if n and row["dmax"] != row["dmin"]:
        raise ValueError(f"{vec_col}: vectors have lengths {row['dmin']}..{row['dmax']}")
    return n, int(row["dmax"] or 0)


def gather_vectors(df: DataFrame, id_col: str, vec_col: str, budget: int = DEFAULT_BROADCAST_BYTES,
                   rows_dim: tuple[int, int] | None = None):
    """Collect (ids, matrix) of a table known to fit in ``budget`` bytes."""
    n, d = rows_dim if rows_dim is not None else measure(df, vec_col)
    need = n * max(d, 1) * 8
    if need > budget:
        raise BroadcastTooLarge(f"{n} x {d} vectors need {need} bytes > budget {budget}")
    tbl = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).toArrow()
    ids = tbl.column("id").to_numpy()
    mat = list_matrix(tbl.column("v"), d if n else None)
    if n == 0:
        mat = np.zeros((0, d), dtype=np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], mat[order]


def narrowed(mat: np.ndarray) -> np.ndarray:
    """The matrix as float32 if that loses nothing: half of the memory that each worker holds."""
    small = mat.astype(np.float32)
    return small if np.array_equal(small, mat, equal_nan=True) else mat
