"""Small fixtures and brute-force versions that the operators are held against."""

import re

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOWER))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, extra=None, first=0):
    """A documents table of the given texts; ids count up from ``first``."""
    rows = [(first + i, t, "en", sources[i] if sources else "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, DOCS)
    return out.repartition(3)


def rows(df, *key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[k] is not None, r[k]) for k in key))
