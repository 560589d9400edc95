"""Removal of byte strings that occur more than once, found with suffix arrays.

A *window* is a byte string of ``length`` bytes.  Every byte that a window covers whose bytes also start at another
place, in the same document or in another one, is removed.  Windows lie within one document.

1. *Pieces.*  Each window is assigned to its anchor, the place of the lowest hash among the ``GRAM``-byte strings in
   it.  Equal windows have equal anchors at equal offsets.  Consecutive windows of one anchor form a piece, the bytes
   from the first window's start to the last one's end, so each window is in exactly one piece.
2. *Selection.*  Pieces whose anchor occurs once hold no repeated window.  The others are counted by (anchor, content),
   copies combined before the shuffle: one piece stands for all its copies, with their number as its weight.
3. *Suffix arrays.*  Pieces meet in buckets by anchor.  A bucket's pieces are read as symbols of ``BLOCK`` bytes,
   aligned to the anchors, and sorted by ``suffix_array`` (grouping on Lyndon prefixes).  Suffixes next to each other
   that agree in the symbols every window has in full form a class; the bytes before and after these symbols tell
   the windows of a class apart.  A window is repeated if the weights of its equals add up to two or more.
4. An anchor with over ``hot_bytes`` of different pieces does not go to one bucket.  Its pieces are cut into groups of at
   most ``BLOCK`` windows, which are keyed by all symbols that these windows share and take step 3 again.  Where even
   such a key has too many, its windows are counted one by one, by digest.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; rows with equal ids, null ids or equal
texts are different documents (their texts repeat each other); an empty table gives an empty result; all columns of the
input but the text are carried, whatever their names, and the text comes back as the bytes that stay.  Text lengths
are bounded only by what a row may hold.  Runs of one byte have an anchor at every place, so they cost about fifty
bytes of intermediate table per byte, not more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark import ship
from nnspark.llm.common import TAG, bucketed, cut, drop_table
from nnspark.llm.suffix_array import suffix_array

LENGTH = 400
GRAM = 128
BLOCK = 16
BUCKET_BYTES = 2 << 20       # of pieces in one suffix array
TABLE_BUCKET_BYTES = 32 << 20   # of text in one bucket of the stored documents
MAX_BUCKETS = 100_000        # Spark's own limit on a table's buckets
MAX_TASKS = 20_000
SLICE = 1 << 20              # windows whose hashes are in memory at once
POS_BITS = 24                # of a slice-local place in a sort key

_MULTIPLIER = 0x9E3779B97F4A7C15   # odd, so it has an inverse modulo 2^64


def shape(length: int) -> tuple[int, int, int]:
    """(anchor bytes, symbol bytes, symbols that every window holds in full) for windows of ``length`` bytes."""
    block = max(1, min(BLOCK, (length + 1) // 4))
    return max(1, min(GRAM, length // 3)), block, (length - block + 1) // block


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _gram_hashes(data: np.ndarray, gram: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of the ``gram`` bytes at every place: prefix sums of a polynomial modulo 2^64, then mixed."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[:n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive keys, from running minima of blocks in both directions."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2 ** 64 - 1))
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - width + 1
    return np.minimum(behind[:k], ahead[width - 1:width - 1 + k])


class Cutter:
    """Cuts the documents of a buffer into pieces; holds the powers that the rolling hash needs."""

    def __init__(self, length: int):
        self.length = length
        self.gram = shape(length)[0]
        self.width = length - self.gram + 1
        n = SLICE + length
        self.up = _powers(n, _MULTIPLIER)
        self.down = _powers(n, pow(_MULTIPLIER, -1, 1 << 64))

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """(start of the first window, windows, anchor place, anchor hash, document number) of every piece."""
        n, length = len(data), self.length
        found = []
        low = np.uint64((1 << POS_BITS) - 1)
        for a in range(0, n - length + 1, SLICE):
            part = data[a:a + SLICE + length - 1]
            h = _gram_hashes(part, self.gram, self.up, self.down)
            key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            at = (_sliding_min(key, self.width) & low).astype(np.int64)
            m = len(at)
            starts = offsets[:-1]
            first = int(np.searchsorted(starts, a, "right"))
            last = int(np.searchsorted(starts, a + m, "left"))
            doc = np.cumsum(np.bincount(starts[first:last] - a, minlength=m)[:m]) + (first - 1)
            ok = np.arange(a + length, a + length + m) <= offsets[doc + 1]
            step = np.concatenate(([True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]) | (doc[1:] != doc[:-1])))
            begin = np.flatnonzero(step)
            count = np.diff(np.append(begin, m))
            keep = ok[begin]
            begin, count = begin[keep], count[keep]
            found.append((begin + a, count, at[begin] + a, h[at[begin]].view(np.int64), doc[begin]))
        if not found:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty, empty
        begin, count, at, h, doc = (np.concatenate(x) for x in zip(*found))
        if len(begin):  # a piece that a slice's end cut in two
            joined = np.concatenate(([False], (begin[1:] == begin[:-1] + count[:-1]) & (at[1:] == at[:-1])))
            head = np.flatnonzero(~joined)
            count = np.add.reduceat(count, head)
            begin, at, h, doc = begin[head], at[head], h[head], doc[head]
        return begin, count, at, h, doc


def _sort_groups(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of a new group in that order) of rows by ``columns``, the first being the most significant."""
    order = np.lexsort(columns[::-1])
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, fresh


def _as_words(rows: np.ndarray) -> list[np.ndarray]:
    """The columns of a byte matrix as big-endian 64-bit words, so that they compare like the bytes."""
    pad = -rows.shape[1] % 8
    if pad:
        rows = np.concatenate((rows, np.zeros((len(rows), pad), np.uint8)), axis=1)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    return [words[:, i] for i in range(words.shape[1])]


def repeated_windows(raw: list[bytes], anchor_at: np.ndarray, windows: np.ndarray, weight: np.ndarray, length: int):
    """(piece, first window, windows) of every run of windows that occur twice or more among the weighted pieces."""
    _, block, full = shape(length)
    sizes = np.array([len(r) for r in raw], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    data = np.frombuffer(b"".join(raw), np.uint8)
    first = anchor_at % block
    blocks = (sizes - first) // block
    piece = np.repeat(np.arange(len(raw)), blocks)
    base = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    place = first[piece] + block * (np.arange(len(piece)) - base[piece])     # of a block in its piece
    order, fresh = _sort_groups(_as_words(data[(at[piece] + place)[:, None] + np.arange(block)]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    # one symbol string: ranks from 2, a 1 after each piece, a 0 at the end
    n = len(piece) + len(raw) + 1
    symbols = np.ones(n, np.int64)
    symbols[-1] = 0
    slot = np.arange(len(piece)) + piece
    symbols[slot] = rank + 1
    block_of = np.full(n, -1, np.int64)
    usable = (place + full * block <= sizes[piece]) & (place - (block - 1) < windows[piece])
    block_of[slot[usable]] = np.flatnonzero(usable)
    suffixes = np.array(suffix_array(symbols.tolist()), np.int64)
    suffixes = suffixes[block_of[suffixes] >= 0]
    same = np.ones(max(len(suffixes) - 1, 0), bool)
    for k in range(full):
        same &= symbols[suffixes[1:] + k] == symbols[suffixes[:-1] + k]
    known = np.concatenate(([0], np.cumsum(~same))) if len(suffixes) else np.zeros(0, np.int64)
    found = block_of[suffixes]
    alone = np.bincount(known, minlength=1)[known] == 1 if len(known) else np.zeros(0, bool)

    first_window = np.concatenate(([0], np.cumsum(windows)))
    marked = np.zeros(first_window[-1], bool)
    rest = length - full * block
    for d in range(block):  # the window that starts d bytes before its first whole block
        start = place[found] - d
        fits = (start >= 0) & (start < windows[piece[found]])
        single = fits & alone & (weight[piece[found]] >= 2)
        marked[first_window[piece[found[single]]] + start[single]] = True
        several = np.flatnonzero(fits & ~alone)
        if not len(several):
            continue
        rows, start, cls = found[several], start[several], known[several]
        inside = np.arange(rest) + np.where(np.arange(rest) < d, 0, full * block)
        order, fresh = _sort_groups([cls, *_as_words(data[(at[piece[rows]] + start)[:, None] + inside])])
        heads = np.flatnonzero(fresh)
        total = np.add.reduceat(weight[piece[rows[order]]], heads)
        often = order[np.repeat(total >= 2, np.diff(np.append(heads, len(order))))]
        marked[first_window[piece[rows[often]]] + start[often]] = True
    owner = np.repeat(np.arange(len(raw)), windows)
    turn = np.concatenate(([True], (marked[1:] != marked[:-1]) | (owner[1:] != owner[:-1]))) if len(marked) else marked
    begin = np.flatnonzero(turn)
    count = np.diff(np.append(begin, len(marked)))
    keep = marked[begin]
    begin, count = begin[keep], count[keep]
    return owner[begin], begin - first_window[owner[begin]], count


def _digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _key(data: bytes) -> int:
    return int.from_bytes(_digest(data, 8), "big", signed=True)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of a binary column, offsets), without a copy."""
    if pa.types.is_large_binary(col.type):
        offsets = np.frombuffer(col.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(col.buffers()[1], np.int32)
    offsets = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


PIECE = "row long, lo long, windows int, anchor_at int, anchor long, digest binary"


def _cut_pieces(length: int):
    def run(batches):
        cutter = Cutter(length)
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = _buffer(batch.column(1))
            begin, count, at, h, doc = cutter.pieces(data, offsets)
            view = data.data
            digests = [_digest(view[b:b + c + length - 1]) for b, c in zip(begin.tolist(), count.tolist())]
            row = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[doc]), pa.array(begin - offsets[doc]), pa.array(count.astype(np.int32)),
                 pa.array((at - begin).astype(np.int32)), pa.array(h), _binary(digests)],
                names=["row", "lo", "windows", "anchor_at", "anchor", "digest"])
    return run


WEIGHTED = "anchor long, digest binary, weight long, windows int, anchor_at int, body binary"


def _fetch(length: int):
    """Bytes of the pieces that stand for their copies, from the stored documents."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            data, offsets = _buffer(batch.column(0))
            lists = batch.column(1)
            doc = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            items = lists.flatten()
            lo, windows = items.field("lo").to_numpy(), items.field("windows").to_numpy()
            begin = offsets[doc] + lo
            view = data.data
            bodies = [bytes(view[b:e]) for b, e in zip(begin.tolist(), (begin + windows + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [items.field("anchor"), items.field("digest"), items.field("weight"), items.field("windows"),
                 items.field("anchor_at"), _binary(bodies)],
                names=["anchor", "digest", "weight", "windows", "anchor_at", "body"])
    return run


MARKS = "anchor long, digest binary, runs array<int>"


def _sort_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        piece, begin, count = repeated_windows(
            table["body"].to_pylist(), table["anchor_at"].to_numpy().astype(np.int64),
            table["windows"].to_numpy().astype(np.int64), table["weight"].to_numpy(), length)
        pieces, head = np.unique(piece, return_index=True)
        flat = np.stack((begin, count), axis=1).astype(np.int32).ravel()
        runs = pa.ListArray.from_arrays(pa.array(np.append(head, len(piece)).astype(np.int32) * 2), pa.array(flat))
        taken = pa.array(pieces)
        return pa.table({"anchor": table["anchor"].take(taken), "digest": table["digest"].take(taken), "runs": runs})
    return run


def _mark(pieces: DataFrame, length: int, bucket_bytes: int, total: int) -> DataFrame:
    """Repeated windows of pieces (``WEIGHTED``) that meet in buckets by anchor."""
    buckets = max(1, math.ceil(total / bucket_bytes))
    tasks = min(MAX_TASKS, max(8, buckets // 2))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).repartition(tasks, "bucket")
    return dealt.groupBy("bucket").applyInArrow(_sort_bucket(length), MARKS)


PART = "parent_anchor long, parent_digest binary, begin int, anchor long, digest binary, weight long, windows int, anchor_at int, body binary"


def _cut_finer(length: int, single: bool):
    """Groups of at most ``BLOCK`` windows, keyed by the symbols they share; or single windows, keyed by their bytes."""
    _, block, full = shape(length)

    def parts(body, windows, at):
        if single:
            for p in range(windows):
                yield p, 1, 0, body[p:p + length], body[p:p + length]
            return
        for place in range(at % block, windows + block - 1, block):
            begin = max(0, place - block + 1)
            count = min(windows - 1, place) - begin + 1
            yield begin, count, place - begin, body[place:place + full * block], body[begin:begin + count + length - 1]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for begin, count, at, core, body in parts(row["body"], row["windows"], row["anchor_at"]):
                    out.append((row["anchor"], row["digest"], begin, _key(core), _digest(body), row["weight"], count, at,
                                b"" if single else body))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in PART.split(", ")])
    return run


def _split_hot(pieces: DataFrame, length: int, hot_bytes: int):
    """(pieces of other anchors, their bytes, pieces of hot anchors or None).  ``pieces`` is a written table."""
    size = (F.col("windows") + length - 1).cast("long")
    groups = pieces.groupBy("anchor").agg(F.sum(size).alias("bytes"))
    hot = groups.filter(F.col("bytes") > hot_bytes).select("anchor")
    seen = groups.agg(F.sum(F.when(F.col("bytes") <= hot_bytes, F.col("bytes"))).alias("cool"),
                      F.count_if(F.col("bytes") > hot_bytes).alias("hot")).first()
    if not seen["hot"]:
        return pieces, seen["cool"] or 0, None
    return pieces.join(hot, "anchor", "left_anti"), seen["cool"] or 0, pieces.join(hot, "anchor", "left_semi")


def _mark_hot(hot: DataFrame, length: int, bucket_bytes: int, hot_bytes: int) -> DataFrame:
    """Repeated windows of the pieces (``WEIGHTED``) of hot anchors."""
    parts, _ = cut(hot.mapInArrow(_cut_finer(length, False), PART), "suffix-parts")
    distinct, _ = cut(parts.groupBy("anchor", "digest", "windows", "anchor_at", "body")
                      .agg(F.sum("weight").alias("weight")), "suffix-parts")
    cool, total, crowded = _split_hot(distinct, length, hot_bytes)
    names = [f.split()[0] for f in WEIGHTED.split(", ")]
    marks = _mark(cool.select(*names), length, bucket_bytes, total)
    if crowded is not None:
        ones = crowded.select(*names).mapInArrow(_cut_finer(length, True), PART)
        ones, _ = cut(ones.select("parent_anchor", "parent_digest", "begin", "anchor", "digest", "weight"), "suffix-windows")
        often = ones.groupBy("anchor", "digest").agg(F.sum("weight").alias("n")).filter("n >= 2").drop("n")
        single = ones.join(often, ["anchor", "digest"], "left_semi").groupBy("parent_anchor", "parent_digest").agg(
            F.flatten(F.collect_list(F.array(F.col("begin"), F.lit(1)))).alias("runs"))
        marks = marks.union(single)
    back = parts.select("parent_anchor", "parent_digest", "begin", "anchor", "digest").join(marks, ["anchor", "digest"])
    moved = F.transform("runs", lambda x, i: F.when(i % 2 == 0, x + F.col("begin")).otherwise(x))
    return back.groupBy(F.col("parent_anchor").alias("anchor"), F.col("parent_digest").alias("digest")).agg(
        F.flatten(F.collect_list(moved)).alias("runs"))


def merged(lo: list[int], runs: list[list[int]], length: int) -> list[tuple[int, int]]:
    """Disjoint byte spans that the windows of the runs cover, in order."""
    spans = sorted((a + r[i], a + r[i] + r[i + 1] + length - 1) for a, r in zip(lo, runs) for i in range(0, len(r), 2))
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _apply_spans(length: int, carried: int, names: list[str]):
    def run(batches):
        for batch in batches:
            bodies, found = batch.column(carried), batch.column(carried + 1).to_pylist()
            size, removed, spans, kept = [], [], [], []
            for i, hits in enumerate(found):
                body = bodies[i].as_py()
                cover = merged([h["lo"] for h in hits], [h["runs"] for h in hits], length) if hits else []
                parts, last = [], 0
                for s, e in cover:
                    parts.append(body[last:s])
                    last = e
                size.append(len(body))
                removed.append(sum(e - s for s, e in cover))
                spans.append([{"start": s, "end": e} for s, e in cover])
                kept.append(b"".join([*parts, body[last:]]) if cover else body)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), _binary(kept)],
                names=names)
    return run


def find_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES,
                 hot_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` plus ``TAG``: a struct of n_bytes, n_removed, spans (array of start, end) and kept (the bytes that stay)."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    ship(spark)
    names = list(docs.columns)
    stored = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col],
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"),
                         F.monotonically_increasing_id().alias("row"))
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(8, math.ceil(total / TABLE_BUCKET_BYTES)))
    base = bucketed(stored, "row", buckets, "suffix_documents")

    pieces, all_path = cut(base.select("row", "body").mapInArrow(_cut_pieces(length), PIECE), "suffix-pieces")
    # written, so that the join below reads two shuffles and its hot anchors can be split
    anchors, _ = cut(pieces.groupBy("anchor").count().filter("count > 1").select("anchor"), "suffix-anchors")
    shared, _ = cut(pieces.join(anchors, "anchor", "left_semi"), "suffix-shared")
    drop_table(spark, all_path)
    chosen = shared.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("row", "lo", "windows", "anchor_at")).alias("one"))
    chosen, _ = cut(chosen.select("anchor", "digest", "weight", "one.*"), "suffix-chosen")

    def fetch(some: DataFrame) -> DataFrame:
        wanted = some.repartition(buckets, "row").groupBy("row").agg(F.collect_list(
            F.struct("lo", "windows", "anchor_at", "anchor", "digest", "weight")).alias("wanted"))
        return base.select("row", "body").join(wanted, "row").select("body", "wanted").mapInArrow(_fetch(length), WEIGHTED)

    cool, size, hot = _split_hot(chosen, length, hot_bytes)
    marks = _mark(fetch(cool), length, bucket_bytes, size)
    if hot is not None:
        marks = marks.unionByName(_mark_hot(fetch(hot), length, bucket_bytes, hot_bytes))
    marks, _ = cut(marks, "suffix-marks")

    # dealt like the stored documents, so that the join leaves their texts where they are
    hits = shared.join(marks, ["anchor", "digest"]).repartition(buckets, "row").groupBy("row").agg(
        F.collect_list(F.struct("lo", "runs")).alias("hits"))
    inner = base.join(hits, "row", "left").drop("row")
    carried = inner.drop("body", "hits")
    inner = inner.select(*carried.columns, "body", "hits")
    tags = T._parse_datatype_string("n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    schema = T.StructType([*carried.schema.fields, *tags.fields])
    out = inner.mapInArrow(_apply_spans(length, len(carried.columns), schema.fieldNames()), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != text_col],
                      F.struct(*tags.fieldNames()).alias(TAG))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    tagged = find_repeats(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", length)
    return tagged.select("doc_id", f"{TAG}.n_bytes", f"{TAG}.n_removed", F.size(f"{TAG}.spans").cast("long").alias("n_spans"),
                         F.sha2(f"{TAG}.kept", 256).alias("kept_sha256"))
