"""Licence scans by diagonal voting (operator 3), DataFrame functions only.

Templates (the base phrases, and public licence notices) and documents are cut into
rolling word 2-grams.  A gram's hash joins document positions with template
positions; a match votes for its offset diagonal (document word - template word).
A phrase stands at a place when its diagonal has a vote for every gram.  For
notices, each diagonal is merged with those up to ``MAX_SHIFT`` words further (words inserted or left out), and the
span is verified: read in the document's order, its votes must go forward in the notice, no further from one to the
next than the document does by more than ``MAX_SHIFT`` words, and weigh ``MIN_COVERAGE`` of the notice's grams.  So a
span is at most ``MAX_SHIFT`` words longer than the notice, and words that are scattered or out of order make none.  The
words themselves are compared, not only their hashes.

All grams vote.  A gram weighs 1, half of that with one very common word and a tenth with two, so that common pairs
alone carry no notice.  The template table has a fixed size and is broadcast; document grams are never
shuffled, only matches are.  Common pairs, which match nearly everywhere, vote in a second pass over the documents where
the other grams of a notice, wherever they stand, leave room for a span; elsewhere their votes can change nothing.

Defined cases: null texts are empty (0 words, no labels, score 0); rows with the same id but
different texts are separate; equal rows give equal results; null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nnspark.llm.common import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening notices of public licences, as their authors publish them.
NOTICES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation, either version 3 of the License",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
            "Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
           "was not distributed with this file",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
# Very common words; grams that hold one or two of them weigh less.
COMMON = frozenset("a above all an and any are as at be by copy either following for from if in is it may not of on or "
                   "or other p provided that the this to use was with without you your".split())
WEIGHTS = (1.0, 0.5, 0.1)   # of a gram with none, one and two common words
MIN_COVERAGE = 0.6
MAX_SHIFT = 4
EPSILON = 1e-9
SIZES = -1       # no template: marks the row that brings a document's word count


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_grams() -> list[tuple[int, str, bool, float, float, int, str, str]]:
    """(template, label, is_phrase, weight of all grams, weight, position, first word, second word)."""
    rows = []
    entries = [(text, label, True) for text, label in PHRASES.items()]
    entries += [(text, label, False) for label, text in NOTICES.items()]
    for t, (text, label, phrase) in enumerate(entries):
        words = _template_words(text)
        grams = [(1.0 if phrase else WEIGHTS[(a in COMMON) + (b in COMMON)], i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
        rows += [(t, label, phrase, sum(g[0] for g in grams), *g) for g in grams]
    return rows


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased.

    ``lower`` also changes letters beyond A-Z, which no template holds; none of them turns into a
    separator, so places and counts are those of the ASCII rule.  The Kelvin sign, the one
    other character with an ASCII lower case, is kept out first.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("å")))


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


GRAMS = "template int, label string, phrase boolean, total double, weight double, t_at int, w0 string, w1 string"


def _grams(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame(template_grams(), GRAMS).withColumn("gram", F.xxhash64("w0", "w1"))


def gram_matches(rows: DataFrame, grams: DataFrame, with_sizes: bool = False) -> DataFrame:
    """(id, text_hash, template, label, phrase, total, weight, at, t_at, n_words): document gram ``at`` equals template gram ``t_at``.

    ``rows`` are (id, text_hash, text); ``grams`` has a fixed size.  ``with_sizes`` adds one row per document, of template
    ``SIZES``, so that its words are counted in the same pass.
    """
    words = rows.select("id", "text_hash", words_of(F.col("text")).alias("words"))
    hashes = F.when(F.size("words") >= K, F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1))))
    hashes = F.coalesce(hashes, F.array().cast("array<bigint>"))
    if with_sizes:  # the gram of two empty words, which no text holds
        hashes = F.concat(hashes, F.array(F.xxhash64(F.lit(""), F.lit(""))))
        sizes = [(SIZES, "", False, 0.0, 0.0, 0, "", "")]
        grams = grams.unionByName(grams.sparkSession.createDataFrame(sizes, GRAMS).withColumn("gram", F.xxhash64("w0", "w1")))
    rolled = words.select("id", "text_hash", "words", F.posexplode(hashes).alias("at", "gram"))
    same = (F.get("words", F.col("at")) == F.col("w0")) & (F.get("words", F.col("at") + 1) == F.col("w1"))
    last = (F.col("template") == SIZES) & (F.col("at") == F.greatest(F.size("words") - 1, F.lit(0)))
    return rolled.join(F.broadcast(grams), "gram").filter(same | last).select(
        "id", "text_hash", "template", "label", "phrase", "total", "weight", "at", "t_at",
        F.when(F.col("template") == SIZES, F.size("words").cast("long")).alias("n_words"))


def in_order(votes: str) -> Column:
    """Weight of the votes (at, t_at, weight; sorted) that go forward in document and template alike."""
    start = F.struct(F.lit(-1).cast("int").alias("at"), F.lit(-1).cast("int").alias("t_at"), F.lit(0.0).alias("sum"))

    def step(s: Column, v: Column) -> Column:
        forward = (v["at"] > s["at"]) & (v["t_at"] > s["t_at"]) & (
            (s["at"] < 0) | (F.abs((v["t_at"] - s["t_at"]) - (v["at"] - s["at"])) <= MAX_SHIFT))
        taken = F.struct(v["at"].cast("int").alias("at"), v["t_at"].cast("int").alias("t_at"), (s["sum"] + v["weight"]).alias("sum"))
        return F.when(forward, taken).otherwise(s)

    return F.aggregate(votes, start, step, lambda s: s["sum"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    doc = ["id", "text_hash"]
    key = [*doc, "template", "label", "phrase", "total"]
    diagonal = (F.col("at") - F.col("t_at")).alias("diagonal")
    # equal rows vote for the same places, so distinct votes count
    distinct = lambda m: m.groupBy(*key, "weight", "t_at", diagonal).agg(F.lit(1).alias("one")).drop("one")
    grams = _grams(docs)
    # first the grams that are not common pairs, with the weight that common pairs might add
    pairs = grams.filter(~F.col("phrase")).groupBy("template").agg(
        F.sum(F.when(F.col("weight") <= WEIGHTS[2], F.col("weight")).otherwise(0.0)).alias("spare"))
    seen, _ = cut(gram_matches(rows, grams.filter(F.col("phrase") | (F.col("weight") > WEIGHTS[2])), with_sizes=True), "license-votes")
    base = seen.filter(F.col("template") == SIZES).select("id", "text_hash", "n_words")
    telling = distinct(seen.filter(F.col("template") != SIZES))
    wanted = telling.filter("not phrase").groupBy(*key, "t_at").agg(F.max("weight").alias("weight")).groupBy(*key).agg(
        F.sum("weight").alias("all")).join(F.broadcast(pairs), "template")  # a row per template
    wanted, _ = cut(wanted.filter(F.col("all") + F.col("spare") >= MIN_COVERAGE * F.col("total") - EPSILON).select(
        F.col("id").alias("w_id"), F.col("text_hash").alias("w_hash"), F.col("template").alias("w_template")), "license-wanted")
    mine = [F.col("id").eqNullSafe(F.col("w_id")), F.col("text_hash") == F.col("w_hash")]
    # then all grams of a notice, in the documents that can hold it
    again = rows.join(wanted.select("w_id", "w_hash").distinct(), mine, "left_semi")
    full = distinct(gram_matches(again, grams.filter(~F.col("phrase"))).join(
        wanted, [*mine, F.col("template") == F.col("w_template")], "left_semi"))
    phrases = telling.filter("phrase").groupBy(*key, "diagonal").agg((F.sum("weight") / F.first("total")).alias("coverage")).select(
        *key, F.col("diagonal").alias("first"), "coverage")
    notes = full.groupBy(*key, "diagonal").agg(F.collect_list(
        F.struct((F.col("diagonal") + F.col("t_at")).alias("at"), "t_at", "weight")).alias("seen"))
    near = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, MAX_SHIFT)
    notes = notes.withColumn("near", F.array_sort(F.flatten(F.collect_list("seen").over(near)))).select(
        *key, F.col("diagonal").alias("first"), (in_order("near") / F.col("total")).alias("coverage"))
    spans = phrases.unionByName(notes)
    coverage = F.col("coverage")
    place = F.col("phrase") & (coverage >= 1 - EPSILON)
    named = place | (~F.col("phrase") & (coverage >= MIN_COVERAGE - EPSILON))
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    verdicts = spans.groupBy(*doc).agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("first"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"), joined(named).alias("labels"),
        F.max(F.when(named, F.least(coverage, F.lit(1.0)))).alias("score"))
    b, v = base.alias("b"), verdicts.alias("v")
    return b.join(v, F.col("b.id").eqNullSafe(F.col("v.id")) & (F.col("b.text_hash") == F.col("v.text_hash")), "left").select(
        F.col("b.id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
