"""Deterministic hash keys used for sampling, seeding and splits.

``md5_key32(parts...)`` is the first 32 bits of md5 of the parts joined with
':' as an unsigned integer.  The same value in SQL (DuckDB) is
``('0x' || substr(md5(s), 1, 8))::bigint``; in Spark it is
``conv(substr(md5(s), 1, 8), 16, 10)``.  Results therefore do not depend on
partitioning, row order or the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _part(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str) and c.startswith("="):
        return F.lit(c[1:])
    return F.col(c).cast("string")


def hash_string(*parts) -> Column:
    """Parts joined with ':'; a string starting with '=' is a literal."""
    return F.concat_ws(":", *[_part(p) for p in parts])


def md5_key32(*parts) -> Column:
    """First 32 bits of md5 of the joined parts, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(hash_string(*parts)), 1, 8), 16, 10).cast("long")


def md5_uniform(*parts) -> Column:
    """A uniform value in [0, 1) derived from md5 of the joined parts."""
    return md5_key32(*parts) / F.lit(TWO_POW_32)
