"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 5).

Two fingerprints that differ in at most ``radius`` = 3 bits share a variant that is at most
half the radius from either: one bit from the one and two bits from the other.  A
pair at distance 3 (or 1) has one fingerprint with an odd and one with an even number
of set bits, so odd fingerprints emit every variant within 1 bit (half, rounded down)
and even ones every variant within 2 (rounded up): 65 and 2081 variants.  Pairs
at distance 2 meet within one bit of each.  So every linked pair collides.

Shuffling 2081 rows per fingerprint would move many times the input.  Variants are therefore
shuffled in bundles: all variants of a fingerprint that agree in ``route`` routing bits
travel as one row, keyed by those bits (137 or 17 rows, not 2081 or 65), and the bundle is opened in the
task that receives it.  ``route`` grows with the number of fingerprints, so a
key's share stays bounded; keys that still hold more than ``MAX_GROUP`` bundles (many close
fingerprints) are routed on by the next bits, until the whole variant is
the key.  A whole variant has at most 2081 + 65 emitters.

Copies collapse first: one row per distinct fingerprint.  A variant's emitters are not
paired up: each is verified against the variant's centre and linked to it.

* emitters one bit away are within 2 bits of each other, so any of them is a centre;
* two bits and one bit away: within 3 bits;
* without an emitter at one bit or less there is nothing to verify that another variant
  does not bring up.

Components of the links come from written star rounds.  Nothing is collected.

Defined cases: null, empty and blank texts have fingerprint zero and link like any
other; null ids join in like other ids, but do not name a component; repeated rows share their component.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.llm.common import TAG, connected_components, cut, spanning_forest, tag_rows

SHINGLE = 3
RADIUS = 3
SEED = 42
MAX_GROUP = 4096
PIECE_SHINGLES = 1 << 15
CHUNK_VARIANTS = 1 << 22


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit majority vote over the XXH64 of the text's word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    hash_of, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, PIECE_SHINGLES):
        part = words[at:at + PIECE_SHINGLES + shingle - 1]
        grams = zip(*(part[k:] for k in range(min(shingle, len(words)))))
        h = np.fromiter((hash_of(b" ".join(g), SEED) for g in grams), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(shingle: int):
    def make():
        import pyarrow as pa

        return lambda texts: [pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())]

    return make


def tag_fingerprints(docs: DataFrame, text_col: str = "text", cols: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (or ``cols``) plus struct ``TAG`` with ``fingerprint`` (signed 64 bits)."""
    return tag_rows(docs, text_col, _fingerprints(shingle), [("fingerprint", "bigint")], cols)


def _flips(bits: int, at: int, most: int) -> list[int]:
    """Masks that flip at most ``most`` of the ``bits`` bits from bit ``at`` on, as signed longs."""
    one = [1 << (at + i) for i in range(bits)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    masks = [0] + (one if most > 0 else []) + (two if most > 1 else [])
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _route(rows: DataFrame, at: int, bits: int) -> DataFrame:
    """Bundles keyed by the variants' bits up to ``at + bits``: (fp, key, left).

    ``key`` holds the routed bits of the variant, the rest being zero; ``left`` is how many more bits may flip.
    """
    field = ((1 << bits) - 1) << at
    field = field - (1 << 64) if field >= 1 << 63 else field
    masks = F.when(F.col("left") >= 2, F.lit(_flips(bits, at, 2))).when(
        F.col("left") == 1, F.lit(_flips(bits, at, 1))).otherwise(F.lit([0]))
    return (rows.select("fp", "key", "left", F.explode(masks).alias("flip"))
            .select("fp", F.col("key").bitwiseOR(F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(field))).alias("key"),
                    (F.col("left") - F.bit_count("flip")).alias("left")))


def bundles(fingerprints: DataFrame, n: int) -> DataFrame:
    """(fp, key, left, at): bundles of variants; ``at`` is the number of bits the key fixes."""
    bits = min(32, max(8, math.ceil(math.log2(max(2, n))) - 4))
    even = F.bit_count("fp") % 2 == 0
    rows = fingerprints.select("fp", F.lit(0).cast("long").alias("key"), F.when(even, 2).otherwise(1).alias("left"))
    at, done = 0, []
    while True:
        bits = min(bits, 64 - at)
        rows = _route(rows, at, bits)
        at += bits
        if at >= 64:
            break
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > MAX_GROUP).select("key")
        crowded, _ = cut(sizes, "simhash-crowded")
        if crowded.isEmpty():
            break
        done.append(rows.join(crowded, "key", "left_anti").select("fp", "key", "left", F.lit(at).alias("at")))
        # routing again is cheaper than keeping bundles: the crowded ones only
        rows, _ = cut(rows.join(crowded, "key", "left_semi").select("fp", "key", "left"), "simhash-bundles")
        bits = 8
    done.append(rows.select("fp", "key", "left", F.lit(at).alias("at")))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _open(fp: np.ndarray, key: np.ndarray, left: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (variant, row) of the bundles: the key's bits, then the fingerprint's with up to ``left`` flips."""
    variants, rows = [], []
    for a in np.unique(at):
        low = np.uint64((1 << int(a)) - 1)
        for m in np.unique(left[at == a]):
            idx = np.flatnonzero((at == a) & (left == m))
            base = key[idx] | (fp[idx] & ~low)
            flips = np.array(_flips(64 - int(a), int(a), int(m)), np.int64).view(np.uint64)
            variants.append((base[:, None] ^ flips[None, :]).ravel())
            rows.append(np.repeat(idx, len(flips)))
    return np.concatenate(variants), np.concatenate(rows)


def _links(fp, key, left, at, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a, b) among complete groups of bundles, thinned to a spanning forest."""
    variant, row = _open(fp, key, left, at)
    order = np.argsort(variant, kind="stable")
    variant, row = variant[order], row[order]
    same = variant[1:] == variant[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    variant, f = variant[keep], fp[row[keep]]
    if not len(variant):
        return f, f
    begin = np.concatenate(([True], variant[1:] != variant[:-1]))
    group = np.cumsum(begin) - 1
    away = np.bitwise_count(variant ^ f)
    # centre: the smallest fingerprint one bit away, else the variant itself; within one bit only itself
    rank = np.array([1, 0, 2] if radius > 1 else [0, 1, 2], np.uint8)[np.minimum(away, 2)]
    best = np.lexsort((f, rank, group))
    first = best[np.searchsorted(group[best], np.arange(group[-1] + 1))]
    a, b = f[first][group], f
    ok = (a != b) & (np.bitwise_count(a ^ b) <= radius)
    # two emitters two bits away each are not linked by this variant alone, but a verified link is a link
    return spanning_forest(a[ok], b[ok])


def _open_bundles(radius: int):
    def run(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def emit(parts):
            fp, key, left, at = (np.concatenate(x) for x in zip(*parts))
            # open at most CHUNK_VARIANTS variants at a time, cut between groups
            cost = np.where(left >= 2, (64 - at) ** 2 // 2, np.where(left == 1, 65 - at, 1))
            total = np.cumsum(cost)
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (at[1:] != at[:-1])) + 1, [len(fp)]))
            lo = 0
            while lo < len(fp):
                limit = (total[lo - 1] if lo else 0) + CHUNK_VARIANTS
                ends = starts[starts > lo]
                fit = ends[total[ends - 1] <= limit]
                hi = int(fit[-1]) if len(fit) else int(ends[0])
                a, b = _links(fp[lo:hi], key[lo:hi], left[lo:hi], at[lo:hi], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
                lo = hi

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            left, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            # the last group may go on in the next batch
            tail = np.flatnonzero((key != key[-1]) | (at != at[-1]))
            end = int(tail[-1]) + 1 if len(tail) else 0
            columns = (fp, key, left, at)
            if end:
                yield from emit([*held, tuple(c[:end] for c in columns)])
                held = []
            held.append(tuple(c[end:] for c in columns))
        if held:
            yield from emit(held)

    return run


def links(fingerprints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect all pairs within ``radius`` bits."""
    rows = bundles(fingerprints, n).select(
        "fp", "key", F.col("left").cast("int").alias("left"), F.col("at").cast("int").alias("at"))
    dealt = rows.repartition("key", "at").sortWithinPartitions("at", "key")
    return dealt.mapInArrow(_open_bundles(radius), "a bigint, b bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               radius: int = RADIUS) -> DataFrame:
    """Per document: id, fingerprint (signed long) and component_id (smallest id reachable over links)."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3: larger balls need more variants than this operator emits")
    tagged = tag_fingerprints(docs.select(id_col, text_col), text_col, [id_col], shingle)
    marks, _ = cut(tagged.select(F.col(id_col).alias("id"), F.col(f"{TAG}.fingerprint").alias("fp")), "simhash-marks")
    distinct, _ = cut(marks.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    n = distinct.count()
    parents = connected_components(links(distinct.select("fp"), n, radius))
    joined = distinct.join(parents, distinct["fp"] == parents["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = cut(joined.join(named, "root").select("fp", "component_id"), "simhash-components")
    return marks.join(of, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id, unchanged.

    Rows are told apart by their place in a written table, not by their ids, so ids may be null (they come after all
    others), shared by different texts, or repeated with the same text.
    """
    names = list(docs.columns)
    stored, _ = cut(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                                F.monotonically_increasing_id().alias("row")), "simhash-rows")
    ids = stored.select("row", F.col(f"c{names.index(id_col)}").alias("id"))
    found = components(stored, "row", f"c{names.index(text_col)}", shingle, radius).join(ids, "row")
    found, _ = cut(found.select("row", "component_id", F.struct(F.col("id").isNull().alias("last"), "id", "row").alias("place")), "simhash-found")
    # written, so that the join reads two shuffles and a crowded component can be split
    first, _ = cut(found.groupBy("component_id").agg(F.min("place").alias("first")), "simhash-first")
    dropped, _ = cut(found.join(first, "component_id").filter("row != first.row").select("row"), "simhash-dropped")
    return stored.join(dropped, "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
