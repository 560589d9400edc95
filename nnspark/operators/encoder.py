"""A text encoder fitted on the corpus itself (X1): a sketched factorisation of term co-occurrence.

Words are hashed to ``FEATURES`` terms.  A text's terms weigh (1 + log tf) idf, scaled to a length of ``SCALE`` and rounded to
whole numbers.  With a random sign matrix S of a few more columns than ``dim``, the product C S of the co-occurrence
matrix C = sum over texts of w w' is summed in one pass, text by text, without C; its left singular vectors span the
strongest directions of C (Halko, Martinsson and Tropp, 2011).  All sums are of whole numbers, so the encoder is the same
under any partitioning.  Only the sums, ``FEATURES`` x (dim + ``MORE``), reach the driver; tasks add up their own first.

The encoder is a table of term vectors (1 MB at 64 dimensions) and goes to ``embed.embed_with_model`` as the function that
``predict_batch_udf`` calls.  Null texts and texts without words have the zero vector.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnspark.operators import embed

FEATURES = 4096
MORE = 16            # columns of the sketch beyond the dimensions that are kept
SCALE = 64
DECIMALS = 7
TERMS = "feature int, idf double, vector array<float>"
_WORD = re.compile(r"\w+")
# of ASCII bytes letters are lowered and what is no word character is a blank; the others stay
_SPLIT = bytes(c if chr(c).isalnum() or c == 95 else 32 for c in bytes(range(128)).lower()) + bytes(range(128, 256))


def _words(text: str) -> list[bytes]:
    """``\\w+`` of the lower-cased text, as UTF-8.  Only what holds other letters than ASCII takes the regular expression."""
    if "\u03a3" in text:   # a capital sigma is lowered by its neighbours, also across punctuation
        return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())]
    found = text.encode("utf-8", "surrogatepass").translate(_SPLIT).split()
    if text.isascii():
        return found
    plain = [w for w in found if w.isascii()]
    other = b" ".join([w for w in found if not w.isascii()]).decode("utf-8", "surrogatepass")
    return plain + [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(other.lower())]


def terms(text: str | None, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, counts) of a text, terms ascending."""
    words = _words(text or "")
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % features, return_counts=True)


def weights(u: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Whole-number weights of a text's terms, of length ``SCALE`` up to rounding."""
    w = (1 + np.log(tf)) * idf[u]
    size = math.sqrt(float((w * w).sum()))
    return np.rint(SCALE * w / size).astype(np.int64) if size else np.zeros(len(u), np.int64)


def _each_task(kernel, shape: tuple[int, int]):
    """One row per term that a task's texts touched: (feature, sums)."""
    def run(batches):
        sums, touched = np.zeros(shape, np.int64), np.zeros(shape[0], bool)
        for rb in batches:
            for text in rb.column(0).to_pylist():
                u, tf = terms(text, shape[0])
                if len(u):
                    touched[u] = True
                    kernel(sums, u, tf)
        rows = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(sums[rows].tolist(), pa.list_(pa.int64()))],
                                         names=["feature", "sums"])
    return run


def _summed(texts: DataFrame, kernel, shape: tuple[int, int]) -> np.ndarray:
    parts = texts.mapInArrow(_each_task(kernel, shape), "feature int, sums array<long>")
    cells = parts.select("feature", F.posexplode("sums").alias("j", "s")).groupBy("feature", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(shape, np.int64)
    out[cells.column("feature").to_numpy(), cells.column("j").to_numpy()] = cells.column("s").to_numpy()
    return out


@dataclass
class Encoder:
    idf: np.ndarray        # per term
    vectors: np.ndarray    # terms x dim

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]

    def encode(self, text: str | None) -> np.ndarray:
        u, tf = terms(text, len(self.idf))
        v = weights(u, tf, self.idf) @ self.vectors[u] if len(u) else np.zeros(self.dim)
        size = math.sqrt(float((v * v).sum()))
        return (v / size if size else v).astype(np.float32)

    def predict_fn(self, spark: SparkSession):
        """What ``embed_with_model`` takes; the term vectors are a broadcast of a fixed size."""
        shared = spark.sparkContext.broadcast(self)

        def make():
            model = shared.value

            def predict(texts: np.ndarray) -> np.ndarray:
                return np.stack([model.encode(t if isinstance(t, str) else None) for t in texts.ravel()])

            return predict

        return make

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        return embed.embed_with_model(df, self.predict_fn(df.sparkSession), self.dim, text_col, out_col)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), [float(x) for x in v]) for i, (w, v) in enumerate(zip(self.idf, self.vectors))]
        spark.createDataFrame(rows, TERMS).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Encoder:
        t = spark.read.parquet(path).orderBy("feature").toPandas()
        return cls(t["idf"].to_numpy(), np.stack(t["vector"].to_list()).astype(np.float32))


def fit(texts: DataFrame, text_col: str = "text", dim: int = 64, features: int = FEATURES, seed: int = 7) -> Encoder:
    """The encoder of all texts of a table."""
    texts = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def count(sums, u, tf):
        sums[u, 0] += 1

    df = _summed(texts, count, (features, 1))[:, 0]
    idf = np.round(np.log((1 + texts.count()) / (1 + df)) + 1, DECIMALS)
    signs = np.random.default_rng(seed).integers(0, 2, (features, dim + MORE)) * 2 - 1

    def sketch(sums, u, tf):
        w = weights(u, tf, idf)
        sums[u] += w[:, None] * (w @ signs[u])

    y = _summed(texts, sketch, (features, dim + MORE)).astype(np.float64)
    left, strength, _ = np.linalg.svd(y, full_matrices=False)
    left = left[:, :dim] * (strength[:dim] > strength[0] * 1e-12 if strength[0] > 0 else 0)
    flip = np.sign(left[np.abs(left).argmax(axis=0), np.arange(left.shape[1])])
    return Encoder(idf, np.round(left * np.where(flip == 0, 1, flip), DECIMALS).astype(np.float32))
