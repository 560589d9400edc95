"""Helpers shared by the operators: table reads, lineage cuts, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nnspark import ship
from nnspark.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Later stages then depend on a table that every executor can read, not on
    the shuffle files of an executor that may be lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`cut` that nothing reads any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as a table under the checkpoint folder, bucketed by ``key``: joins on ``key`` shuffle the other side only."""
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key)
     .option("path", scratch_path(df.sparkSession, name)).saveAsTable(table))
    return df.sparkSession.table(table)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def _stamp(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` that is not its component's smallest.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    round hangs every node's larger neighbours, then its smaller ones, on the
    smallest node it sees, until the edge set is a star per component.  All
    steps are DataFrame joins and aggregates; a hub's rows are combined map-side
    and its join partition can be split by AQE.  Each round is a written table,
    and the round before it is dropped.  Null ends and self-loops are ignored.
    """
    spark = edges.sparkSession
    e, path = cut(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("hi > lo").distinct(), "components")
    stamp = _stamp(e)
    while stamp[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(parent, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo")
                 .union(parent.select("hi", "m")).distinct())
        new, new_path = cut(small, "components")
        new_stamp = _stamp(new)
        drop_table(spark, path)
        e, path = new, new_path
        if new_stamp == stamp:
            break
        stamp = new_stamp
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star per component of the links at hand."""
    if not len(a):
        return a, b
    nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = codes[:len(a)], codes[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    ends = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[ends]], nodes[ends]


TAG = "__tag"


def tag_rows(docs: DataFrame, text_col: str, make_kernel, fields: list[tuple[str, str]],
             cols: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``cols`` of it) plus a struct column ``TAG`` that a kernel computes from the text.

    ``make_kernel()`` runs once per task and returns a function from an Arrow text
    column to one Arrow array per field of ``fields`` (name, type).  Columns
    travel under positional names, so names of the input never clash with the
    kernel's.  Batches are bounded by Spark's own limit on Arrow batch bytes.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    names = list(docs.columns) if cols is None else list(cols)
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    inner = docs.select(*carried, F.col(f"`{text_col}`").alias("text_in"))
    tags = T._parse_datatype_string(", ".join(f"t{i} {kind}" for i, (_, kind) in enumerate(fields)))
    schema = T.StructType([*inner.schema.fields[:-1], *tags.fields])
    out_names = schema.fieldNames()

    def run(batches):
        kernel = make_kernel()
        for batch in batches:
            arrays = [*batch.columns[:-1], *kernel(batch.columns[-1])]
            yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    out = inner.mapInArrow(run, schema)
    tag = F.struct(*[F.col(f"t{i}").alias(name) for i, (name, _) in enumerate(fields)])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], tag.alias(TAG))
