"""Mixing sources to target weights with a low-discrepancy schedule (operator 10).

1. Target words per source: source ``weights`` by rank, ``share`` of all words
   in total, at most ``max_repeat`` times a source's own words, the excess
   shared again by weight until no target is above its limit.
2. Every source's documents are put in an order that depends only on
   their content (md5 of id), and their words are cut into blocks of
   ``block_words``.  Prefix sums are taken in two levels (hash buckets, as
   many as a source needs, then rows of a bucket), so no source is ever ordered in one task.
3. Slot i of the schedule is the golden-ratio point frac(i * phi), mapped through
   the cumulative targets to a source.  Slots of a source are ranked (again in
   two levels), and rank r takes the source's block r, wrapping round for the
   second pass.
4. Blocks and document pieces meet in one join on (source, block), whose keys are
   spread evenly.  Where the schedule is a block or two off a source's target,
   settling slots close the gap and the last block is cut.

DataFrame functions only: no UDF, pandas, Arrow or RDD.  The driver sees
scalars (totals, the water level of the targets) and nothing per source.

Defined cases: null text has size 0; null ids and null sources are ordinary values
(null sources are one source, last in order); documents without words take 0;
repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nnspark.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 256
KEY_BITS = 60
ROWS_PER_BUCKET = 1_000   # of one source
SLOTS_PER_CHUNK = 16_384
SLOT_LOW_BITS = 20

getcontext().prec = 50
_PHI = (Decimal(5).sqrt() - 1) / 2


def golden_point(i: Column) -> Column:
    """frac(i * phi), with i in two parts so that large i keeps its precision."""
    step = float((_PHI * 2 ** SLOT_LOW_BITS) % 1)
    high = F.shiftright(i, SLOT_LOW_BITS) * F.lit(step)
    low = i.bitwiseAND(F.lit(2 ** SLOT_LOW_BITS - 1)) * F.lit(float(_PHI))
    x = (high - F.floor(high)) + (low - F.floor(low))
    return x - F.floor(x)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, key): word count and the shuffling key of each document."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10)
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        key.cast("long").alias("key"))


def source_targets(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """(source, src, n_docs, source_size, weight, target) from :func:`sized` rows; src is the rank by code point."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # Ranks without a one-task window: the sort's range partitions are numbered
    # in order, so a row's rank is its place in its partition plus the earlier partitions' rows.
    placed, _ = cut(totals.orderBy(F.asc_nulls_last("source")).select(
        "source", "source_size", "n_docs", F.spark_partition_id().alias("p"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "mix-sources")
    parts = placed.groupBy("p").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("p", F.coalesce(before, F.lit(0)).alias("before"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked, _ = cut(placed.join(parts, "p").withColumn("src", F.col("i") + F.col("before")).select(
        "source", "src", "n_docs", "source_size", weight.alias("weight")), "mix-ranked")

    first = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total = share * (first["s"] or 0)
    rest, weight_left, n_full = total, first["w"] or 0, 0
    while weight_left:
        full = F.col("weight") * F.lit(float(rest)) / F.lit(weight_left) > max_repeat * F.col("source_size")
        row = ranked.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("s"),
            F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if row["n"] == n_full or not row["w"]:
            break
        n_full, rest, weight_left = row["n"], total - max_repeat * (row["s"] or 0), row["w"]
    fair = F.col("weight") * F.lit(float(rest)) / F.lit(weight_left or 1)
    return ranked.withColumn("target", F.least(fair, F.lit(float(max_repeat)) * F.col("source_size")))


def place(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's first word's position among its source's shuffled words (column ``at``)."""
    # a source's buckets are prefixes of the shuffling key, twice as many with every doubling of its documents
    bits = F.greatest(F.ceil(F.log2(F.col("n_docs") / ROWS_PER_BUCKET)), F.lit(0)).cast("int")
    joined = docs.join(sources, docs["source"].eqNullSafe(sources["source"])).select(
        "id", "size", "key", "src", "source_size", "target", bits.alias("bits"))
    rows, _ = cut(joined.withColumn("bucket", F.expr(f"shiftright(key, {KEY_BITS} - bits)")).drop("bits"), "mix-rows")
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("src", "bucket", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.sum("size").over(
        Window.partitionBy("src", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, ["src", "bucket"])
            .withColumn("at", F.col("earlier") + F.col("inside")).drop("bucket", "earlier", "inside", "key"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, src, rank, pass, block, words): which block every slot of the mix takes, and how much of it.

    ``slot`` is null for the settling slots that follow the schedule.
    """
    spark = sources.sparkSession
    per_chunk = 1000
    chunked = sources.withColumn("chunk", F.floor(F.col("src") / per_chunk))
    sums = chunked.groupBy("chunk").agg(F.sum("target").alias("t"))
    earlier = F.sum("t").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("chunk", F.coalesce(earlier, F.lit(0.0)).alias("earlier"))
    inside = F.sum("target").over(Window.partitionBy("chunk").orderBy("src").rowsBetween(Window.unboundedPreceding, -1))
    size, words = F.col("source_size"), F.col("words")
    blocks = F.ceil(size / block_words)
    plan, _ = cut(chunked.withColumn("inside", F.coalesce(inside, F.lit(0.0))).join(sums, "chunk")
                  .withColumn("words", F.least(F.round("target").cast("long"), 2 * size))
                  .select("src", "source_size", "target", "words", blocks.alias("blocks"),
                          F.when(words <= size, F.ceil(words / block_words))
                          .otherwise(blocks + F.ceil((words - size) / block_words)).alias("needed"),
                          (F.col("earlier") + F.col("inside")).alias("begin")), "mix-plan")
    row = plan.agg(F.sum("target").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n_sources = row["t"] or 0.0, row["n"]
    n_slots = math.ceil(total / block_words)
    cells = 1 << max(2, (4 * max(1, n_sources)).bit_length())
    edge = lambda c: F.least(F.floor(c / F.lit(total or 1.0) * cells), F.lit(cells - 1))
    spans = plan.filter("target > 0").withColumn("end", F.col("begin") + F.col("target")).withColumn(
        "cell", F.explode(F.sequence(edge(F.col("begin")), edge(F.col("end")))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (golden_point(F.col("id")) * F.lit(total)).alias("x"))
    slots = (slots.withColumn("cell", F.floor(F.col("x") / F.lit(total or 1.0) * cells)).join(spans, "cell")
             .filter("x >= begin and x < end")
             .select("slot", "src", F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("part")))
    slots, _ = cut(slots, "mix-slots")
    counts = slots.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    prior = F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("src", "part", "n", F.coalesce(prior, F.lit(0)).alias("prior"))
    place_in = F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1
    ranked = (slots.withColumn("place", place_in).join(counts.drop("n"), ["src", "part"])
              .select("slot", "src", (F.col("prior") + F.col("place")).alias("rank")))
    have = counts.groupBy("src").agg(F.sum("n").alias("have"))
    settle = (plan.join(have, "src", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < needed")
              .select(F.lit(None).cast("long").alias("slot"), "src", F.explode(F.sequence("have", F.col("needed") - 1)).alias("rank")))
    taken = ranked.union(settle).join(plan, "src").filter("rank < needed")
    second = F.floor(F.col("rank") / F.col("blocks"))
    block = F.col("rank") % F.col("blocks")
    start = F.col("pass") * F.col("source_size") + F.col("block") * block_words
    return (taken.withColumn("pass", second).withColumn("block", block)
            .withColumn("used", F.least(F.lit(block_words), (F.col("pass") + 1) * F.col("source_size") - start,
                                        F.col("words") - start))
            .select("slot", "src", "rank", "pass", "block", F.col("used").alias("words")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=(3, 1, 2), share: float = 1.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, at most twice the size)."""
    rows, _ = cut(sized(docs, id_col, text_col, source_col), "mix-sized")
    sources, _ = cut(source_targets(rows, weights, share), "mix-targets")
    placed, _ = cut(place(rows, sources), "mix-placed")
    uses = schedule(sources, block_words).groupBy("src", "block").agg(
        F.max(F.when(F.col("pass") == 0, F.col("words"))).alias("w0"),
        F.max(F.when(F.col("pass") == 1, F.col("words"))).alias("w1"))
    last = F.floor((F.col("at") + F.col("size") - 1) / block_words)
    pieces = (placed.filter("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), last)))
              .withColumn("lo", F.greatest(F.col("at") - F.col("block") * block_words, F.lit(0)))
              .withColumn("hi", F.least(F.col("at") + F.col("size") - F.col("block") * block_words, F.lit(block_words))))
    overlap = [F.greatest(F.lit(0), F.least(F.col("hi"), F.coalesce(w, F.lit(0))) - F.col("lo")) for w in ("w0", "w1")]
    # (src, at) names a document with words: no two of a source begin at the same word.
    summed = (pieces.join(uses, ["src", "block"]).groupBy("src", "at").agg(F.sum(overlap[0] + overlap[1]).alias("taken")))
    key = [F.when(F.col("size") > 0, F.col("at")).alias("at")]
    out = (placed.select("id", "size", "src", "source_size", "target", *key)
           .join(summed, ["src", "at"], "left"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
