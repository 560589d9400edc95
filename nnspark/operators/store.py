"""Stored inverted-list indexes: load or build, validity, and appended vectors.

An index lives under one path as numbered versions.  A version is a small manifest table written last: the fingerprint
of the vectors it covers, the build's parameters, and the paths of its centroids and postings.  A version without its
manifest does not exist, so a build that dies half way leaves the index as it was.  ``load_or_build`` opens the newest
version whose fingerprint and parameters are those of the corpus; if the corpus holds all indexed vectors and further
ones, only those are assigned to the trained lists, and their postings become one more path of a new version; otherwise
it builds anew.  A search reads all postings of its version as one table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnspark.operators import ivf
from nnspark.operators.exact import corpus_frame
from nnspark.operators.kernels import list_matrix

MANIFEST = "version long, n long, mark string, params string, centroids string, postings array<string>, buckets int"


@dataclass
class Stored:
    index: ivf.IvfIndex
    version: int
    how: str            # opened, appended or built
    n_new: int          # vectors assigned by this call


def fingerprint(vectors: DataFrame) -> tuple[int, str]:
    """(rows, mark) of (id, vec) rows: two sums of row hashes, so order and partitioning do not matter."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.xxhash64("id", "vec", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]).first()
    return row["n"], f"{row['s0'] or 0}:{row['s1'] or 0}"


def _versions(spark: SparkSession, path: str) -> list:
    """Manifests, newest first.  Each is one row in a folder of its own; a folder whose write was not committed is skipped."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [str(s.getPath()) for s in fs.listStatus(root)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    rows = spark.read.schema(MANIFEST).parquet(*done).collect() if done else []
    return sorted(rows, key=lambda r: -r["version"])


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/v{row[0]:08d}-{uuid.uuid4().hex[:8]}")


def _open(spark: SparkSession, row) -> ivf.IvfIndex:
    cent = spark.read.parquet(row["centroids"]).orderBy("list_id").toArrow()
    parts = [spark.read.parquet(p).select("list_id", "id", "vec", "list_bucket") for p in row["postings"]]
    return ivf.IvfIndex(list_matrix(cent.column("centroid")), reduce(DataFrame.unionByName, parts), row["buckets"])


def load_or_build(corpus: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding", **params) -> Stored:
    """The index of ``corpus`` at ``path``: opened, extended by the new vectors, or built (``params`` go to the build)."""
    spark = corpus.sparkSession
    vectors = corpus_frame(corpus, id_col, vec_col)
    wanted = json.dumps(params, sort_keys=True)
    n, mark = fingerprint(vectors)
    versions = _versions(spark, path)
    newest = versions[0] if versions else None
    for row in versions:
        if (row["n"], row["mark"], row["params"]) == (n, mark, wanted):
            return Stored(_open(spark, row), row["version"], "opened", 0)
    version = newest["version"] + 1 if newest else 0
    folder = f"{path}/data-{uuid.uuid4().hex[:12]}"
    if newest and newest["params"] == wanted and newest["n"] < n:
        index = _open(spark, newest)
        known = index.postings.select("id")
        if fingerprint(vectors.join(known, "id", "left_semi")) == (newest["n"], newest["mark"]):
            fresh = vectors.join(known, "id", "left_anti")
            ivf.write_postings(ivf.assign(fresh, index.centroids, "id", "vec"), f"{folder}/postings", newest["buckets"])
            row = (version, n, mark, wanted, newest["centroids"], [*newest["postings"], f"{folder}/postings"], newest["buckets"])
            _commit(spark, path, row)
            return Stored(_open(spark, _versions(spark, path)[0]), version, "appended", n - newest["n"])
    index = ivf.build(corpus, id_col=id_col, vec_col=vec_col, **params)
    index.save(folder)
    _commit(spark, path, (version, n, mark, wanted, f"{folder}/centroids", [f"{folder}/postings"], index.buckets))
    return Stored(_open(spark, _versions(spark, path)[0]), version, "built", n)
