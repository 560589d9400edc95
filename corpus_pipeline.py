"""A corpus pipeline: five stages, each one operator of ``nnspark.llm`` over all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All stages but the last return the columns of documents.

1. toxicity: documents the classifier rejects go.
2. simhash: of each group of near-duplicates the document with the smallest id stays.
3. decontamination: documents that the contamination rule marks go.
4. secrets: secrets are masked in the text, and ``n_chars`` follows; no document goes.
5. mix: sources are mixed to their target weights; one row per document says how many of its words are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnspark.llm import decontamination, mixing, secrets, simhash, toxicity
from nnspark.llm.common import cut, read_table

SHINGLE_WORDS = 3
MAX_BITS = 3

#: The stages hold a trained classifier, components of a graph and an automaton: SQL cannot state them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, shingle=SHINGLE_WORDS, radius=MAX_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = docs.withColumn("__masked", secrets.redact(F.col("text")))
    changed = F.col("__masked") != F.col("text")
    return masked.select(*[
        F.col("__masked").alias("text") if c == "text"
        else F.when(changed, F.length("__masked").cast(kind)).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(c) for c, kind in docs.dtypes])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is a written table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
