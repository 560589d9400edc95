"""Result files: ranked results, comparisons, vectors, sweep tables.

Parquet is the default storage.  The CSV layouts of the reference's reports
are available for exchange: a ranked-result CSV has the columns below
(6 columns; 5 in the oldest form without time, 7 with the spread), and the
reader tolerates blank separator lines and a missing time column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nnspark.functions.distance import safe_sqrt

# Column headers of the ranked-result and comparison CSV files.
RANKED_CSV_COLUMNS = ["Query", "Rank", "Matched Keyword", "Matched ID", "Distance", "Search Time (ms)",
                      "Internal Similarity"]
COMPARISON_CSV_COLUMNS = ["Query", "FAISS Sum Distance", "Annoy Sum Distance", "% Distance Diff",
                          "FAISS Time (ms)", "Annoy Time (ms)", "Speedup"]

RANKED_CSV_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("dist", T.DoubleType()),
    T.StructField("time_ms", T.DoubleType()),
    T.StructField("spread", T.DoubleType()),
])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector table (id, embedding array<float>, ...) from Parquet."""
    return spark.read.parquet(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors and their ids in one Parquet table (no positional alignment)."""
    df.write.mode(mode).parquet(path)


def write_ranked(ranked: DataFrame, path: str, partition_by: tuple[str, ...] = ("algo", "k"),
                 mode: str = "overwrite") -> None:
    """Ranked results of every (algo, k), partitioned by those columns."""
    cols = [c for c in partition_by if c in ranked.columns]
    w = ranked.write.mode(mode)
    (w.partitionBy(*cols) if cols else w).parquet(path)


def write_ranked_csv(ranked: DataFrame, path: str, with_spread: bool = True) -> None:
    """S6 (report layout, P6 formatting): query, rank, text, id, distance with 6
    decimals, time with 3 decimals, spread with 6 decimals."""
    time_col = F.col("time_ms") if "time_ms" in ranked.columns else F.col("cost").cast("double")
    cols = [
        F.col("query").alias(RANKED_CSV_COLUMNS[0]),
        F.col("rank").alias(RANKED_CSV_COLUMNS[1]),
        F.col("text").alias(RANKED_CSV_COLUMNS[2]),
        F.col("id").alias(RANKED_CSV_COLUMNS[3]),
        F.format_string("%.6f", F.col("dist")).alias(RANKED_CSV_COLUMNS[4]),
        F.format_string("%.3f", time_col).alias(RANKED_CSV_COLUMNS[5]),
    ]
    if with_spread:
        cols.append(F.format_string("%.6f", F.coalesce(F.col("spread"), F.lit(0.0))).alias(RANKED_CSV_COLUMNS[6]))
    ranked.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_ranked_csv_checked(spark: SparkSession, path: str, squared: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of ranked-result CSVs, by position (5, 6 or 7 columns).

    Blank lines are skipped and a missing or empty time is 0.0; ``squared`` converts squared L2 values to L2 with the
    negative guard (P4).  A row whose rank is no integer, whose distance is no finite number, or whose id, time or spread
    is given but cannot be read, is a reject: its fields as read, the file, and ``reason``, the first field at fault.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in RANKED_CSV_SCHEMA.fields])
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(raw).csv(path).where(F.col("query").isNotNull())
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    typed = {f.name: F.trim(F.col(f.name)).try_cast(f.dataType) for f in RANKED_CSV_SCHEMA.fields if f.name not in ("query", "text")}
    number = lambda c: typed[c].isNotNull() & ~F.isnan(typed[c]) & (F.abs(typed[c]) != float("inf"))
    reason = (F.when(typed["rank"].isNull(), "rank").when(given("id") & typed["id"].isNull(), "id")
              .when(~F.coalesce(number("dist"), F.lit(False)), "dist")
              .when(given("time_ms") & ~F.coalesce(number("time_ms"), F.lit(False)), "time_ms")
              .when(given("spread") & ~F.coalesce(number("spread"), F.lit(False)), "spread"))
    judged = df.withColumn("reason", reason)
    dist = safe_sqrt(typed["dist"]) if squared else typed["dist"]
    rows = judged.where(F.col("reason").isNull()).select(
        "query", typed["rank"].alias("rank"), "text", typed["id"].alias("id"), dist.alias("dist"),
        F.coalesce(typed["time_ms"], F.lit(0.0)).alias("time_ms"), typed["spread"].alias("spread"))
    rejects = judged.where(F.col("reason").isNotNull()).select(F.col("_metadata.file_path").alias("file"), *raw.fieldNames(), "reason")
    return rows, rejects


def read_ranked_csv(spark: SparkSession, path: str, squared: bool = False) -> DataFrame:
    """The rows of :func:`read_ranked_csv_checked` alone."""
    return read_ranked_csv_checked(spark, path, squared)[0]


def result_metrics(ranked_csv: DataFrame) -> DataFrame:
    """A1 + A2 over a ranked-result file: per query, the distance sum and the
    time of its first-ranked row."""
    return ranked_csv.groupBy("query").agg(
        F.sum("dist").alias("sum_dist"),
        F.min_by("time_ms", "rank").alias("cost"),
        F.count(F.lit(1)).cast("int").alias("n_hits"),
    )


def write_comparison_csv(cmp: DataFrame, path: str) -> None:
    """One row per query in the report layout (sums 4 dp, % 2 dp, times 3 dp, speedup 2 dp + 'x')."""
    cmp.select(
        F.col("query").alias(COMPARISON_CSV_COLUMNS[0]),
        F.format_string("%.4f", "base_sum").alias(COMPARISON_CSV_COLUMNS[1]),
        F.format_string("%.4f", "cand_sum").alias(COMPARISON_CSV_COLUMNS[2]),
        F.concat(F.format_string("%.2f", "pct_diff"), F.lit("%")).alias(COMPARISON_CSV_COLUMNS[3]),
        F.format_string("%.3f", F.col("base_cost").cast("double")).alias(COMPARISON_CSV_COLUMNS[4]),
        F.format_string("%.3f", F.col("cand_cost").cast("double")).alias(COMPARISON_CSV_COLUMNS[5]),
        F.concat(F.format_string("%.2f", "speedup"), F.lit("x")).alias(COMPARISON_CSV_COLUMNS[6]),
    ).write.mode("overwrite").option("header", True).csv(path)


def write_sweep_tables(summary: DataFrame, diffs: DataFrame, path: str) -> None:
    """The sweep's two sheets (values only) as two Parquet tables."""
    summary.write.mode("overwrite").parquet(f"{path}/Summary")
    diffs.write.mode("overwrite").parquet(f"{path}/Diffs")
