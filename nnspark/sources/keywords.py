"""Keyword corpus source (S1, P1, P2, A14) and entity lists (S3).

A keyword corpus is text with one ``<integer id><whitespace><text>`` per line.
Rows are numbered in file order without a global sort: a file split is read
whole by one task, so a row's place in its split is a difference of
``monotonically_increasing_id``, and the splits' row counts are summed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nnspark.functions.text import keyword_id, keyword_id_token, keyword_text, py_strip


def _numbered(rows: DataFrame, value: str, number: str) -> DataFrame:
    """(number, value): rows of a file scan, numbered from 0 by path, then by place in the file.

    Counts are summed within each file first, then over the files: no window holds more than one
    row per split of a file or one row per file.
    """
    placed = rows.select(value, F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_file_n"))
    before = F.sum("_file_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_file_base"))
    inside = F.sum("_n").over(
        Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    bases = splits.withColumn("_base", F.coalesce(inside, F.lit(0))).join(files, "_file").select(
        "_file", "_block", (F.col("_file_base") + F.col("_base") - F.col("_first")).alias("_shift"))
    return placed.join(bases, ["_file", "_block"]).select((F.col("_at") + F.col("_shift")).alias(number), value)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) in file order, across files in path order."""
    return _numbered(spark.read.text(path), "value", "line_no").withColumnRenamed("value", "line")


def parse_lines(lines: DataFrame, line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """P1 + P2: split off the id; returns (parsed, rejects).

    Lines with fewer than two parts are dropped silently (as the reference
    does); lines whose first part is not an integer go to ``rejects``.
    """
    tok = keyword_id_token(line_col)
    txt = keyword_text(line_col)
    two_parts = (tok != "") & (txt != "")
    cols = [c for c in lines.columns if c != line_col]
    staged = lines.select(*cols, F.col(line_col), two_parts.alias("_two"), keyword_id(line_col).alias("id"),
                          txt.alias("text"))
    parsed = staged.where(F.col("_two") & F.col("id").isNotNull()).select(*cols, "id", "text")
    rejects = staged.where(F.col("_two") & F.col("id").isNull()).select(
        *cols, F.col(line_col), F.lit("id is not an integer").alias("reason")
    )
    return parsed, rejects


def keep_last(parsed: DataFrame, key: str = "id", value: str = "text", order: str = "line_no") -> DataFrame:
    """One value per key, from the last line (largest ``order``)."""
    return parsed.groupBy(key).agg(F.max_by(value, order).alias(value))


def read_keyword_corpus(spark: SparkSession, path: str) -> DataFrame:
    """id -> text map of a keyword file (last line wins for a repeated id)."""
    parsed, _ = parse_lines(read_lines(spark, path))
    return keep_last(parsed)


def read_entity_list(spark: SparkSession, path: str) -> DataFrame:
    """S3 + U2: first CSV column, stripped, distinct in order of first appearance: (entity, ord, n).

    Every file starts with a header; blank lines are skipped, rows with a blank name are kept, and
    quoted fields may hold line breaks (so a file is read by one task; a list may have many files).
    """
    rows = (spark.read.schema("entity string").option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))
    listed = _numbered(rows, "entity", "ord")
    return first_seen(listed.select(py_strip(F.coalesce("entity", F.lit(""))).alias("entity"), "ord"), "entity", "ord")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Order-preserving distinct: each value once, at its first position."""
    return df.groupBy(value).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n"))
