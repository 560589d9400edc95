"""nnspark: nearest-neighbour analytics on Spark DataFrames.

DataFrames in, DataFrames out.  Python workers need the package too; on a
cluster ship it with ``--py-files`` or call :func:`ship` once per session.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.1.0"

_SHIPPED: set[int] = set()


def ship(spark) -> None:
    """Make this package importable in the session's Python workers (once)."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="nnspark-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
