"""Suffix arrays and repeated byte strings against brute force; edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers_llm import docs, rows
from pyspark.sql import functions as F

from nnspark.llm import suffix_dedup
from nnspark.llm.common import TAG
from nnspark.llm.suffix_array import suffix_array

SF001 = "/root/testdata/sf0.001"


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 4, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    a, b = [1], [1, 2]
    while len(b) < 2000:
        a, b = b, b + a
    for s in (b + [0], [1] * 500 + [0], [3, 1, 2] * 300 + [0]):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array([]) == []


def covered(texts, length):
    """Per text: the covered places, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = True
        out.append((b, hit))
    return out


def digest_rows(texts, length):
    out = []
    for b, hit in covered(texts, length):
        starts = int(np.sum(hit[1:] & ~hit[:-1])) + int(bool(len(hit)) and bool(hit[0]))
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((len(b), int(hit.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def found_rows(df, length, **kw):
    tagged = suffix_dedup.find_repeats(df, length=length, **kw).select(
        "doc_id", f"{TAG}.n_bytes", f"{TAG}.n_removed", F.size(f"{TAG}.spans").alias("n_spans"), F.sha2(f"{TAG}.kept", 256).alias("sha"))
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in rows(tagged, "doc_id")]


def planted(seed, length):
    """Random texts with passages copied among and within them, whole copies, runs of one letter and non-ASCII text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(5, 40)) for _ in range(6)]
    texts = [None, "", "x", "a" * (length * 3), "a" * (length - 1), "b" * length, "ab" * length]
    for _ in range(40):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 6):], text(rng.randint(0, 20))]
        texts.append("".join(parts))
    return texts + [texts[-1], texts[-1], texts[-2] + "tail", "head" + texts[-3]]


@pytest.mark.parametrize("length", [7, 40, 100])
def test_repeats_match_brute_force(spark, length):
    texts = planted(length, length)
    assert found_rows(docs(spark, texts), length) == digest_rows(texts, length)


def test_hot_anchors_give_the_same_rows(spark):
    texts = planted(3, 40)
    passage = "the passage that every other document holds, with changing words around it. "
    texts += [f"{i} {passage}{i * 7919} {passage[:50]}{i % 3}" for i in range(60)]
    want = digest_rows(texts, 40)
    for hot in (4000, 400, 0):  # anchors are split; their parts are split; every window is counted
        assert found_rows(docs(spark, texts), 40, bucket_bytes=2000, hot_bytes=hot) == want


def test_a_piece_cut_by_a_slice_is_joined(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 1200, 1200, 1230, 5000])
    whole = suffix_dedup.Cutter(50).pieces(data, offsets)
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    parts = suffix_dedup.Cutter(50).pieces(data, offsets)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    starts = np.concatenate([np.arange(b, b + c) for b, c in zip(whole[0], whole[1])])
    want = [p for s, e in zip(offsets[:-1], offsets[1:]) for p in range(s, e - 50 + 1)]
    assert starts.tolist() == want


def test_empty_table_clashing_columns_null_and_repeated_ids(spark):
    empty = docs(spark, ["x"]).filter("false")
    assert suffix_dedup.remove_repeats(empty).collect() == []
    text = "y" * 30 + "z" * 500
    table = docs(spark, [text, text, "short", None])
    table = table.withColumn("doc_id", F.when(F.col("doc_id") > 0, (F.col("doc_id") / 2).cast("long")))
    for name in ("row", "body", "c0", "kept", "spans", "anchor", "hits"):
        table = table.withColumn(name, F.lit(name))
    tagged = suffix_dedup.find_repeats(table)
    got = sorted((r[TAG]["n_bytes"], r[TAG]["n_removed"], r["row"], r["kept"]) for r in tagged.collect())
    assert got == [(0, 0, "row", "kept"), (5, 0, "row", "kept"), (530, 530, "row", "kept"), (530, 530, "row", "kept")]


def test_whole_table_matches_brute_force(spark):
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = table.orderBy("doc_id").collect()
    want = digest_rows([t["text"] for t in texts], 400)
    found = rows(suffix_dedup.remove_repeats(table), "doc_id")
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found] == want
    assert sum(w[1] for w in want) > 0
