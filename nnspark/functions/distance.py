"""Distance and score expressions (JVM-side, no Python).

Spark has no built-in vector functions, so the squared L2 distance is a
higher-order expression over the two array columns.  The sum runs left to
right over the dimensions, in double, which is what the numpy kernels and the
SQL oracle do too, so all three agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_l2(a, b) -> Column:
    """Squared L2 distance of two equal-length numeric arrays."""
    a = _col(a).cast("array<double>")
    b = _col(b).cast("array<double>")
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda s, x: s + x)


def safe_sqrt(d2) -> Column:
    """Squared distance to distance; a product-form value can dip below 0."""
    return F.sqrt(F.greatest(_col(d2), F.lit(0.0)))


def l2(a, b) -> Column:
    """L2 distance."""
    return safe_sqrt(sq_l2(a, b))


def sq_norm(a) -> Column:
    a = _col(a).cast("array<double>")
    return F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0).cast("double"), lambda s, x: s + x)


def inflation_pct(cand, base) -> Column:
    """A3: distance inflation in percent; 0 when the baseline is not positive."""
    cand, base = _col(cand), _col(base)
    return F.when(base > 0, (cand - base) / base * 100.0).otherwise(F.lit(0.0))


def speedup(base_cost, cand_cost) -> Column:
    """A4: baseline cost over candidate cost; 1 when the candidate cost is not positive."""
    base_cost, cand_cost = _col(base_cost), _col(cand_cost)
    return F.when(cand_cost > 0, base_cost.cast("double") / cand_cost.cast("double")).otherwise(F.lit(1.0))


def normalised_similarity(d, max_d) -> Column:
    """1 - d / max, with max 0 replaced by 1e-9."""
    max_d = _col(max_d)
    return F.lit(1.0) - _col(d) / F.when(max_d == 0, F.lit(1e-9)).otherwise(max_d)
