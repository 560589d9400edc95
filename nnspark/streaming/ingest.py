"""Streamed keyword ingestion: the chunked ``id text`` -> vectors job as a stream.

Text files dropped into ``in_dir`` are read with the file source, parsed
(P1, P2), embedded (X1) and appended to a Parquet vector table (S8).  Every
line becomes one vector; duplicates are kept, as in the batch job (the
keep-last rule applies to the text map, which needs global line order and is
a batch operator).  Rejected lines go to a second sink.  Progress and
exactly-once output come from the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nnspark.functions.text import keyword_id, keyword_id_token, keyword_text
from nnspark.operators.embed import DEFAULT_DIM, trigram_udf


def keyword_vectors_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                           rejects_dir: str | None = None, dim: int = DEFAULT_DIM,
                           max_files_per_trigger: int = 16, trigger_once: bool = False):
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(in_dir)
    tok, txt, kid = keyword_id_token("value"), keyword_text("value"), keyword_id("value")
    staged = lines.select(
        ((tok != "") & (txt != "")).alias("two"), kid.alias("vec_id"), txt.alias("text"), F.col("value").alias("line")
    )
    good = staged.where(F.col("two") & F.col("vec_id").isNotNull()).select(
        "vec_id", "text", trigram_udf(dim)(F.col("text")).cast("array<float>").alias("embedding")
    )
    w = good.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", f"{checkpoint}/vectors")
    w = w.trigger(availableNow=True) if trigger_once else w
    queries = [w.start()]
    if rejects_dir:
        bad = staged.where(F.col("two") & F.col("vec_id").isNull()).select("line")
        wr = bad.writeStream.format("parquet").option("path", rejects_dir) \
            .option("checkpointLocation", f"{checkpoint}/rejects")
        wr = wr.trigger(availableNow=True) if trigger_once else wr
        queries.append(wr.start())
    return queries
