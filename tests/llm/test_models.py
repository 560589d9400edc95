"""Toxicity and quality classifiers: kernel values, exact scoring, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
import pytest
from helpers_llm import docs, rows
from pyspark.sql import functions as F

from nnspark.llm import quality, toxicity

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


# ---------------------------------------------------------------- toxicity

def _squeezed(token):
    out = []
    for b in token.encode("utf-8", "surrogatepass"):
        code = int(toxicity._CODES[b])
        if code:
            out.append(code)
    return out


def _slow_kernel(token, landmark):
    """The gap-weighted kernel from its definition, divided by the landmark's own."""
    def phi(s):
        c, out = _squeezed(s), {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, len(c)):
                    if k - i - 2 <= toxicity.MAX_GAP:
                        u = (c[i], c[j], c[k])
                        out[u] = max(out.get(u, 0), toxicity.DECAY ** (k - i + 1))
        return out

    a, b = phi(token), phi(landmark)
    return sum(w * b.get(u, 0) for u, w in a.items()) / sum(w * w for w in b.values())


WORDS = ["idiot", "IDIOT", "idiiot", "i.d.i.o.t", "1d10t", "idiotisch", "ridiotous", "xidxiot", "id", "", "iiiidddiiioootttt",
         "clown", "clowner", "c-l-o-w-n", "the", "moron", "oron", "oronoron", "ünïdiot", "loweiä", "a" * 300]


def test_sentence_values_follow_the_kernel():
    model = toxicity.Model.over(["idiot", "clown", "moron", "lowei"])
    for w in WORDS:
        place, values = model.sentences(np.frombuffer(f"some words {w} here".encode(), np.uint8))
        want = np.array([_slow_kernel(w, x) for x in model.landmarks])
        want[want < toxicity.MIN_KERNEL] = 0
        got = values.max(axis=0) if len(values) else np.zeros(4)
        assert got == pytest.approx(want, abs=1e-6), w


def test_single_letters_run_together_and_sentences_part():
    model = toxicity.Model.over(["idiot", "clown"])
    _, values = model.sentences(np.frombuffer(b"you i d i o t. A clown there! nothing\nclown idiot", np.uint8))
    assert values.round(6).tolist() == [[1, 0], [0, 1], [1, 1]]


def test_long_texts_are_cut_without_loss(monkeypatch):
    model = toxicity.Model.over(["idiot", "clown"])
    model.weights, model.bias = np.array([1.0, 2.0]), -0.5
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["fine", "day.", "idiot", "idixot!", "clown."]) if rng.random() < .2 else "word" for _ in range(rng.randrange(400))).encode()
             for _ in range(50)] + [b"", b"x" * 5000, b"idiot"]
    whole = toxicity.margins_of(model, texts)
    monkeypatch.setattr(toxicity, "PIECE", 600)
    assert toxicity.margins_of(model, texts) == pytest.approx(whole)


def _labelled(rng, n):
    """Invented prose; toxic documents hold two or more disguised insults."""
    syllables = ["ra", "ten", "ish", "lo", "vin", "que", "mar", "dor", "ell", "un"]
    insults = ["blorghead", "grumptwit", "fizznork"]

    def disguise(w):
        how = rng.randrange(4)
        at = rng.randrange(2, len(w) - 2)
        return w if how < 2 else w[:at] + rng.choice("xz") + w[at:] if how == 2 else ".".join(w)

    out = []
    for i in range(n):
        text = [["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 12))] for _ in range(rng.randrange(3, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 4)):
                rng.choice(text).append(disguise(rng.choice(insults)))
        out.append((i, " ".join(" ".join(s).capitalize() + "." for s in text), int(toxic)))
    return out


def test_training_learns_disguised_insults(spark):
    data = _labelled(random.Random(1), 900)
    table = docs(spark, [t for _, t, _ in data]).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    assert all(any(part in w or w in part for w in ("blorghead", "grumptwit", "fizznork")) for part in model.landmarks[:3])
    found = rows(toxicity.score(table, model), "doc_id")
    held = [(r, y) for r, (_, _, y) in zip(found, data) if r["held_out"]]
    assert {r["doc_id"] for r, _ in held} == {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == y for r, y in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["predicted"]}


def test_training_reads_long_sentences_to_their_end(spark):
    texts = ["", "word " * 300 + "blorghead", "x" * 1234 + " y", "short one. " + "é" * 500 + ". last", "z" * 500]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:len(texts)]
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    found = [s for _, s in toxicity.training_sentences(table, labels)]
    assert all(len(x) <= toxicity.MAX_SENTENCE_CHARS for s in found for x in s)
    count = lambda parts: sorted(c for x in parts for c in x if not c.isspace())
    assert sorted(count(s) for s in found) == sorted(count([t]) for t in texts)
    assert any("blorghead" in x.split() for s in found for x in s)


def test_held_out_labels_change_nothing(spark):
    data = _labelled(random.Random(2), 300)
    table = docs(spark, [t for _, t, _ in data])
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in data]
    a = toxicity.train(table, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    b = toxicity.train(table, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert a.landmarks == b.landmarks and np.array_equal(a.weights, b.weights) and a.offset == b.offset


def test_odd_labels_and_empty_tables(spark):
    table = docs(spark, [None, "", "fine words", "x"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        found = toxicity.score(table, toxicity.train(table, labels)).collect()
        assert len(found) == 4 and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in found)
    assert toxicity.score(table.filter("false"), toxicity.Model()).count() == 0


def test_toxicity_with_few_labels(spark):
    """Held-out accuracy where some 350 toxic rows train (1.00 on check_s): AUC 0.954, recall 0.87, 0.7 % of clean rows wrong.

    The rest holds no word that sets toxic training texts apart; of the texts with one of these words nearly all are found.
    """
    from nnspark.llm import queries

    plain = "scum clown stupid idiot loser moron trash pathetic worthless disgusting".split()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text").collect()}
    found = [r for r in queries.op1_toxicity(spark, SF1).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = np.array([r["score"] for r in found if labels[r["doc_id"]]])
    clean = np.array([r["score"] for r in found if not labels[r["doc_id"]]])
    marked = [r["predicted"] for r in found if labels[r["doc_id"]] and any(w in texts[r["doc_id"]].lower() for w in plain)]
    assert np.mean([np.mean(toxic > c) + 0.5 * np.mean(toxic == c) for c in clean]) >= 0.95
    assert np.mean(toxic >= 0.5) >= 0.86 and np.mean(clean >= 0.5) <= 0.01
    assert len(marked) > 50 and np.mean(marked) >= 0.97


# ----------------------------------------------------------------- quality

def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    k, n = len(quality.HEURISTICS), 20_000
    truth = rng.random(n) < 0.8
    right = np.linspace(0.65, 0.95, k)
    counts = {}
    for y in truth:
        votes = "".join("-" if rng.random() < 0.3 else "g" if (rng.random() < a) == y else "b" for a in right)
        counts[votes] = counts.get(votes, 0) + 1
    posterior, table = quality.estimate(counts)
    assert table[1, :, 2] == pytest.approx(right, abs=0.03)
    assert table[0, :, 0] == pytest.approx(right, abs=0.05)
    assert all(0 <= p <= 1 for p in posterior.values())


def test_quality_against_gold_labels_it_never_reads(spark):
    from nnspark.llm import queries

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    found = queries.op4_quality(spark, SF01).collect()
    assert len(found) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in found if labels.get(r["doc_id"]) is not None]
    good = [p for p, y in pairs if y == 1]
    assert np.mean([p == y for p, y in pairs]) >= 0.95 and np.mean(good) >= 0.97


def test_the_fit_reads_whole_texts(spark, monkeypatch):
    """Long texts whose fault comes after a clean head are trained by the votes and features of the whole."""
    rng = random.Random(5)
    clean = [" ".join(rng.choice(["the", "of", "and", "to", f"word{rng.randrange(9)}", f"thing{rng.randrange(900)}"]) for _ in range(300)) for _ in range(60)]
    texts = clean + [" ".join(clean[i:i + 16])[:22_000] + " la" * 9000 for i in range(20)]
    seen = {}
    fit = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda x, y: seen.update(x=x, y=y) or fit(x, y))
    posterior, _ = quality.train(docs(spark, texts))
    stats = [quality.statistics(t) for t in texts]
    want = sorted((posterior[quality.votes_of(s)], *quality.features(t, s)) for t, s in zip(texts, stats))
    assert len(seen["y"]) == len(texts)
    assert np.array(sorted((y, *x) for x, y in zip(seen["x"], seen["y"]))) == pytest.approx(np.array(want), abs=1e-6)


def test_quality_of_odd_texts(spark):
    texts = [None, "", " ", "!!!! ####", "the and of " * 50, "la " * 5000, "x" * 100_000, "Of the many words in this plain text some are common and others not."]
    table = docs(spark, texts).withColumn("votes", F.lit(1)).withColumn("id", F.lit("clash"))
    table = table.union(table)
    found = quality.score(table, *quality.train(table)).collect()
    assert len(found) == 16
    by = {}
    for r in found:
        assert by.setdefault(r["doc_id"], (r["votes"], r["score"])) == (r["votes"], r["score"])
        assert 0 <= r["score"] <= 1 and len(r["votes"]) == len(quality.HEURISTICS)
    empty = table.filter("false")
    assert quality.score(empty, *quality.train(empty)).count() == 0
