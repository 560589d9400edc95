"""Text embedding.

The default encoder needs no model and runs entirely as Spark expressions:
lower-cased character trigrams, each hashed (md5) into one of ``dim``
buckets, counted, and scaled to unit L2 norm.  It is a stand-in with the same
interface as a learned sentence encoder; retrieval quality is not comparable.

A learned encoder plugs in through ``embed_with_model``: Spark's
``predict_batch_udf`` calls ``make_predict_fn`` once per Python worker and
feeds it Arrow batches of ``batch_size`` texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 64


def trigram_buckets(text, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of every character trigram of lower(text) (the whole text if shorter)."""
    s = F.lower(F.col(text) if isinstance(text, str) else text)
    n = F.greatest(F.length(s) - 2, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, 3))
    return F.transform(
        grams,
        lambda g: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("tri:"), g)), 1, 8), 16, 10).cast("long"),
                         F.lit(dim)).cast("int"),
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body).getItem(0)


def trigram_weights(text, dim: int = DEFAULT_DIM) -> Column:
    """Unit-norm bucket counts in double.

    Buckets are counted in one pass over the trigram list and every
    intermediate is bound once, so the hashing runs once per trigram.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("double"), dim)

    def count(buckets):
        return F.aggregate(buckets, zeros,
                           lambda acc, x: F.transform(acc, lambda c, j: F.when(j == x, c + 1.0).otherwise(c)))

    def scale(counts):
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0).cast("double"), lambda a, c: a + c * c))
        return F.transform(counts, lambda c: F.when(norm > 0, c / norm).otherwise(F.lit(0.0)))

    return _let(_let(trigram_buckets(text, dim), count), scale)


def _trigram_batch(texts, dim: int):
    import hashlib

    import numpy as np

    out = []
    for t in texts:
        if t is None:
            out.append(np.zeros(dim))
            continue
        s = t.lower()
        grams = [s[i:i + 3] for i in range(max(len(s) - 2, 1))]
        b = [int(hashlib.md5(("tri:" + g).encode("utf-8")).hexdigest()[:8], 16) % dim for g in grams]
        c = np.bincount(b, minlength=dim).astype(np.float64)
        n = np.sqrt((c * c).sum())
        out.append(c / n if n > 0 else c)
    return out


def trigram_udf(dim: int = DEFAULT_DIM):
    """The same encoder as ``trigram_weights`` as an Arrow-batched pandas UDF
    (array<double>): one hash per trigram and a bincount per text."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(_trigram_batch(texts, dim))

    return encode


def embed_texts(df: DataFrame, text_col: str = "text", out_col: str = "embedding", dim: int = DEFAULT_DIM,
                jvm: bool = False) -> DataFrame:
    """X1 with the built-in encoder: adds ``out_col array<float>``.

    ``jvm=True`` uses the pure-expression form (no Python workers)."""
    w = trigram_weights(text_col, dim) if jvm else trigram_udf(dim)(F.col(text_col))
    return df.withColumn(out_col, w.cast("array<float>"))


def embed_with_model(df: DataFrame, make_predict_fn: Callable, dim: int, text_col: str = "text",
                     out_col: str = "embedding", batch_size: int = 1024) -> DataFrame:
    """X1 with a learned encoder (e.g. an ONNX sentence model loaded inside
    ``make_predict_fn``); batches of ``batch_size`` texts per call."""
    from pyspark.ml.functions import predict_batch_udf

    enc = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return df.withColumn(out_col, enc(F.col(text_col)))


def embed_queries(queries: DataFrame, text_col: str = "query", id_col: str = "query_id", dim: int = DEFAULT_DIM,
                  encoder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same encoder applied to query strings -> (query_id, query, qv)."""
    if encoder is None:
        out = embed_texts(queries, text_col, "qv", dim)
    else:
        out = encoder(queries).withColumnRenamed("embedding", "qv")
    return out.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("query"), "qv")
