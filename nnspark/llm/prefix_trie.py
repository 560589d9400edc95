"""A prefix trie of rebuilt conversations: what several conversations share at their start is one path of nodes.

1. A turn's id is the first 16 bytes of the SHA-256 of its role and text, most significant byte first.  A conversation
   is the byte string of its turns' ids, so a prefix of d turns is a prefix of 16 d bytes.
2. Equal conversations are combined: their number, smallest id, and the hash of all their ids.  The ids go through
   blocks of 4,096 consecutive numbers, and one pass streams the blocks of a conversation in order, so that no task
   holds a crowded conversation's ids.
3. The distinct byte strings are range-partitioned and sorted.  A slot, one such range, builds an adaptive radix tree
   (``radix_tree``) and emits a node at every depth that is a multiple of 16 bytes.
4. A node is *open* if the slot before or after holds it too: it lies on the path that the slot's first string shares
   with the string before, or the last one with the string after.  A crowded first turn is thus an open node of many
   slots, not one task.  All columns of a node are sums or minima over its slots (an open node and its text are counted
   by the first slot that holds it), so a group by the path's digest completes the open nodes.

A conversation's turns are held together in a row (24 bytes a turn).  Defined results: rows with a null conv_id are
dropped; turns are ordered by turn, nulls first, equal ones by the hash of role and text; a null role or text is
empty; repeated rows are turns of their own; an empty table has no nodes, not even a root.  Further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nnspark import ship
from nnspark.llm.common import cut
from nnspark.llm.radix_tree import RadixTree

ID_BYTES = 16
MAX_HEAD = 5                 # turns that a rebuilt conversation may take over
STEP = 100                   # a conversation takes over from the one whose id is the next lower multiple
ID_BLOCK_BITS = 12           # ids hashed as one piece of text
KEYS_PER_SLOT = 2_000
MAX_SLOTS = 20_000


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits of a turn; the role's length keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, as structs of id (hex) and size (code points)."""
    t = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("conv_id", F.struct("known", "turn", turn_id(F.col("role"), F.col("text")).alias("id"),
                                     F.length("text").alias("size")).alias("one"))
    ordered = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("seq"))
    return ordered.select("conv_id", F.transform("seq", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("seq"))


def rebuild(seqs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of its group's first conversation (h from its id's CRC)."""
    heads = seqs.filter(F.col("conv_id") % STEP == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, MAX_HEAD).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % (MAX_HEAD + 1)).cast("int")
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP).withColumn("h", taken)
    none = F.expr("cast(array() as array<struct<id: string, size: int>>)")
    joined = own.join(heads, "base", "left")
    return joined.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
        F.slice("seq", F.col("h") + 1, F.size("seq"))).alias("seq"))


KEYS = "key binary, sizes array<int>, n long, least long, ends string"


def _stream_ends(batches):
    """One row per distinct conversation from its blocks of ids, which come in order."""
    key = sizes = digest = least = None
    n, done = 0, []

    def flush():
        arrays = [pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()))]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["key", "sizes", "n", "least", "ends"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    done.append((key, sizes, n, least, digest.hexdigest()))
                key, sizes, digest, least, n = row["key"], row["sizes"], hashlib.sha256(), row["least"], 0
            else:
                digest.update(b",")
            digest.update(row["ids"].encode())
            n += row["n"]
        if done:
            yield flush()
    if key is not None:
        done.append((key, sizes, n, least, digest.hexdigest()))
        yield flush()


def distinct_keys(rebuilt: DataFrame) -> DataFrame:
    """``KEYS``: a row per distinct sequence, with the number, smallest id and hashed ids of its conversations."""
    flat = rebuilt.select("conv_id", F.unhex(F.array_join(F.col("seq.id"), "")).alias("key"), F.col("seq.size").alias("sizes"),
                          F.shiftright("conv_id", ID_BLOCK_BITS).alias("block"))
    blocks = flat.groupBy("key", "sizes", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_stream_ends, KEYS)


def _shared_turns(batches):
    for batch in batches:
        a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        shared = [-1 if y is None else len(os.path.commonprefix([x, y])) // ID_BYTES for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int32())], names=["slot", "after"])


def slot_edges(keys: DataFrame) -> DataFrame:
    """(slot, before, after): turns that a slot's first and last key share with the neighbouring slot, -1 without one.

    Windows run over one row per slot, of which there are at most ``MAX_SLOTS``.
    """
    in_order = Window.orderBy("slot")
    ends = keys.groupBy("slot").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    pairs = ends.select("slot", "last", F.lead("first").over(in_order).alias("next"))
    after = pairs.mapInArrow(_shared_turns, "slot int, after int")
    return after.select("slot", "after", F.lag("after", 1, -1).over(in_order).alias("before"))


NODES = ("open boolean, path binary, parent_path binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string")
_NODE_TYPES = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _path(key: bytes, depth: int) -> bytes:
    return hashlib.blake2b(key[:depth * ID_BYTES], digest_size=16).digest()


def build_slot(table: pa.Table) -> pa.Table:
    """Nodes of one slot's keys.  Open nodes come with this slot's share of their sums."""
    tree = RadixTree()
    keys = table["key"].to_pylist()
    sizes, counts, least_of, ends_of = (table[c].to_pylist() for c in ("sizes", "n", "least", "ends"))
    for i, key in enumerate(keys):
        tree.insert(key, i)
    first, last = min(keys), max(keys)
    before, after = table["before"][0].as_py(), table["after"][0].as_py()

    parent, depth, ends, key_of, n, least = [], [], [], [], [], []
    for up, d, i in tree.aligned(ID_BYTES):
        parent.append(up)
        depth.append(d)
        key_of.append(i)      # a key below the node, once known
        ends.append(None if i is None else ends_of[i])
        n.append(0 if i is None else counts[i])
        least.append(None if i is None else least_of[i])
    children, leaves, saved = [0] * len(parent), [0] * len(parent), [0] * len(parent)
    opened, owned = [False] * len(parent), [True] * len(parent)
    for v in range(len(parent) - 1, -1, -1):  # children before parents
        d, key = depth[v], keys[key_of[v]]
        cut_at = d * ID_BYTES
        from_before = d <= before and first.startswith(key[:cut_at])
        opened[v] = from_before or (d <= after and last.startswith(key[:cut_at]))
        owned[v] = not from_before
        if not children[v] and not opened[v]:
            leaves[v] = 1
        if d:
            saved[v] += sizes[key_of[v]][d - 1] * (n[v] - owned[v])
        up = parent[v]
        if up >= 0:
            key_of[up] = key_of[v]
            n[up] += n[v]
            least[up] = least[v] if least[up] is None else min(least[up], least[v])
            children[up] += owned[v]
            leaves[up] += leaves[v]
            saved[up] += saved[v]
    rows = []
    for v, up in enumerate(parent):
        key = keys[key_of[v]]
        inner = up >= 0 and not opened[up]
        rows.append((opened[v], _path(key, depth[v]) if opened[v] else None,
                     _path(key, depth[up]) if up >= 0 and opened[up] else None,
                     least[v], depth[v], least[up] if inner else None, n[v], children[v], leaves[v], saved[v],
                     ends[v] if opened[v] else ends[v] or _NO_ENDS))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), _NODE_TYPES)], names=[f.split()[0] for f in NODES.split(", ")])


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def build(rebuilt: DataFrame, keys_per_slot: int = KEYS_PER_SLOT) -> DataFrame:
    """Nodes of the trie over (conv_id, seq) rows: columns ``OUT``."""
    ship(rebuilt.sparkSession)
    keys, _ = cut(distinct_keys(rebuilt), "trie-keys")
    slots = max(1, min(MAX_SLOTS, math.ceil(keys.count() / keys_per_slot)))
    dealt = keys.repartitionByRange(slots, "key").withColumn("slot", F.spark_partition_id())
    dealt, _ = cut(dealt, "trie-slots")
    edged = dealt.join(F.broadcast(slot_edges(dealt)), "slot")  # at most MAX_SLOTS rows of three integers
    nodes, _ = cut(edged.groupBy("slot").applyInArrow(build_slot, NODES), "trie-nodes")
    inner = nodes.filter(~F.col("open")).drop("open", "path").withColumnRenamed("ends", "ends_sha256")
    tops = nodes.filter("open").groupBy("path").agg(
        F.max("parent_path").alias("parent_path"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max("ends"), F.lit(_NO_ENDS)).alias("ends_sha256"))
    tops, _ = cut(tops, "trie-tops")
    parents = tops.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    settled = inner.filter(F.col("parent_path").isNull())
    below = inner.filter(F.col("parent_path").isNotNull()).drop("parent_conv_id").unionByName(
        tops.filter(F.col("parent_path").isNotNull()).drop("path")).join(parents, "parent_path")
    roots = tops.filter(F.col("parent_path").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return settled.select(*OUT).unionByName(below.select(*OUT)).unionByName(roots.select(*OUT))


def trie(turns: DataFrame) -> DataFrame:
    """The trie of rebuilt ``turns`` (conv_id, turn, role, text)."""
    return build(rebuild(sequences(turns)))
