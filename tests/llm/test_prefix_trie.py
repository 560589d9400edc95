"""The radix tree and the prefix trie against brute force and SQL; edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from helpers_llm import rows
from pyspark.sql import functions as F

from nnspark.llm import prefix_trie
from nnspark.llm.oracle import SQL
from nnspark.llm.radix_tree import Full, Indexed, Node, RadixTree, Sorted

SF001 = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def test_layouts_grow_and_keep_their_children():
    node, seen = Node(b""), []
    order = list(range(256))
    random.Random(1).shuffle(order)
    for i, byte in enumerate(order, 1):
        node.attach(byte, byte)
        layout = type(node.children), getattr(node.children, "room", None)
        if layout not in seen:
            seen.append(layout)
        assert [b for b, _ in node.children.items()] == sorted(order[:i])
    assert seen == [(Sorted, 4), (Sorted, 16), (Indexed, None), (Full, None)]
    assert all(node.children.find(b) == b for b in range(256))


@pytest.mark.parametrize("width", [1, 2, 4])
def test_tree_matches_a_dictionary(width):
    rng = random.Random(width)
    for _ in range(200):
        keys = {bytes(rng.choice(b"\x00ab\xff") for _ in range(width * rng.randint(0, 5))) for _ in range(rng.randint(1, 30))}
        keys |= {k + bytes(width) for k in list(keys)[:3]}
        tree = RadixTree()
        for k in rng.sample(sorted(keys), len(keys)):
            tree.insert(k, k)
        assert all(tree.find(k) == k for k in keys) and tree.find(b"z" * 40) is None
        places = list(tree.aligned(width))
        prefixes = {k[:i] for k in keys for i in range(0, len(k) + 1, width)}
        assert len(places) == len(prefixes)
        assert {v for _, _, v in places if v is not None} == keys
        assert all(d == 0 if p < 0 else places[p][1] == d - 1 for p, d, _ in places)


def brute(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            turn = (role or "", text or "")
            sort = hashlib.sha256(f"{len(turn[0].encode())}:{turn[0]}{turn[1]}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, sort, turn))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + seq[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


def found(spark, turns, **kw):
    table = spark.createDataFrame(turns, TURNS).repartition(3)
    built = prefix_trie.rebuild(prefix_trie.sequences(table))
    return sorted(tuple(r) for r in prefix_trie.build(built, **kw).collect())


def made(seed, convs, alphabet):
    rng, out = random.Random(seed), []
    ids = rng.sample(range(0, 900), convs) + [0, 100, 200]
    for c in set(ids):
        for t in range(rng.randint(1, 9)):
            out.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "user", None]), rng.choice(alphabet)))
    return out


@pytest.mark.parametrize("slot", [1, 7, 10_000])
def test_trie_matches_brute_force(spark, slot):
    turns = made(slot, 120, ["hi", "hi", "yes", "", None, "é漢😀", "no" * 50])
    assert found(spark, turns, keys_per_slot=slot) == brute(turns)


def test_crowded_first_turn_and_equal_conversations(spark):
    turns = [(c, t, "user", "same" if t < 3 else f"{c % 7}") for c in range(0, 300) for t in range(8)]
    turns += [(c, 0, "user", "lonely") for c in range(5_000, 13_000)]  # many blocks of ids
    assert found(spark, turns, keys_per_slot=2) == brute(turns)


def test_deep_conversations(spark):
    turns = [(c, t, "user", f"turn {t}" if t < 400 else f"{c}") for c in (7, 8, 109) for t in range(450)]
    assert found(spark, turns, keys_per_slot=1) == brute(turns)


def test_empty_table_null_ids_and_clashing_columns(spark):
    assert found(spark, []) == []
    turns = [(None, 1, "user", "x"), (5, None, None, None), (5, None, None, None), (-3, 0, "u", "x" * 100_000)]
    assert found(spark, turns) == brute(turns)
    table = spark.createDataFrame(turns, TURNS)
    for name in ("seq", "key", "slot", "path", "open", "depth"):
        table = table.withColumn(name, F.lit(1))
    assert sorted(tuple(r) for r in prefix_trie.trie(table).collect()) == brute(turns)


def test_whole_table_matches_sql(spark):
    table = spark.read.parquet(f"{SF001}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF001}/conversations.parquet')")
    want = con.sql(SQL["op11_prefix_trie"]).fetchall()
    got = sorted(tuple(r) for r in prefix_trie.trie(table).select(*[F.col(c) for c in prefix_trie.OUT]).collect())
    assert got == sorted(want)
    assert got == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()])
