"""SimHash, embedding and substring duplicates against brute force; components; edge cases."""

import random

import numpy as np
import pytest
import xxhash
from helpers_llm import TOKEN, docs, rows, words
from pyspark.sql import functions as F

from nnspark.llm import common, embedding_dedup, simhash, substring_dedup

SF001 = "/root/testdata/sf0.001"


def closure(n, pairs):
    """Smallest member of each node's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_hubs_and_noise(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (None, 7)]
    pairs += [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(150)]
    found = {r["node"]: r["component"] for r in common.connected_components(
        spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    want = closure(900, [p for p in pairs if p[0] is not None])
    assert found == {i: c for i, c in enumerate(want) if c != i}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text, k=3):
    w = words(text, TOKEN)
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_fingerprints_follow_the_definition():
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c a b c", "Ünïcode É É x y z", "w " * 70_000]
    for text in texts:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == _fingerprint(text)


def _bits(ids, marks, radius):
    f = np.array(marks, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    order = np.argsort(ids)
    f, near = f[order], near[np.ix_(order, order)]
    lab = closure(len(f), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    return {int(np.array(ids)[order][i]): int(np.array(ids)[order][c]) for i, c in enumerate(lab)}


def _linked(spark, marks, radius=3):
    table = spark.createDataFrame([(int(np.uint64(m).astype(np.int64)),) for m in set(marks)], "fp long").repartition(4)
    edges = simhash.links(table, table.count(), radius).collect()
    ids = {m: i for i, m in enumerate(sorted(set(marks)))}
    pairs = []
    for a, b in edges:
        a, b = int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))
        pairs.append((ids[a], ids[b]))
    return closure(len(ids), pairs), _bits(list(range(len(ids))), sorted(set(marks)), radius)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_balls_meet_for_every_pair_within_the_radius(spark, radius):
    rng = random.Random(radius)
    marks = []
    for _ in range(60):  # families with members at chosen distances, in odd and even fingerprints
        base = rng.getrandbits(64)
        marks.append(base)
        for d in (1, 2, 3, 4, 5):
            flip = 0
            for b in rng.sample(range(64), d):
                flip |= 1 << b
            marks.append(base ^ flip)
    got, want = _linked(spark, marks, radius)
    assert dict(enumerate(got)) == want


def test_crowded_bundles_are_routed_on(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_GROUP", 40)
    rng = random.Random(9)
    base = rng.getrandbits(64)
    marks = [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(250)]
    got, want = _linked(spark, marks)
    assert dict(enumerate(got)) == want


def test_simhash_documents(spark):
    table = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    edge = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " "), (10**6 + 3, "zz"), (10**6 + 3, "zz")], "doc_id long, text string")
    table = table.union(edge).withColumn("fingerprint", F.lit("clash")).withColumn("key", F.lit(0))
    data = table.collect()
    want = _bits([r["doc_id"] for r in data if True], [_fingerprint(r["text"]) for r in data], 3)
    found = simhash.components(table).collect()
    assert len(found) == len(data)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert simhash.components(table.filter("false")).count() == 0


def test_null_ids_take_part_without_naming(spark):
    table = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "other text")], "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.components(table).collect()}
    assert sorted(got.values(), key=str) == [4, 4, None]
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(table).collect()]
    assert sorted(kept, key=str) == [(4, "a b c d"), (None, "other text")]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    """Shared and repeated ids, null ids and clashing columns: exactly one row per group of equal texts, the smallest id's."""
    data = [(5, "text a one two"), (5, "text b one two"), (3, "text b one two"), (5, "text a one two"), (None, "text c x y"),
            (None, "text c x y"), (None, "text a one two"), (7, None), (7, ""), (8, None)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    for name in ("row", "id", "c0", "place", "component_id", "first"):
        table = table.withColumn(name, F.lit(name))
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns and {r["row"] for r in kept.collect()} == {"row"}
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    blank = [g for g in got if not g[1]]
    assert [g for g in got if g[1]] == sorted([(5, "text a one two"), (3, "text b one two"), (None, "text c x y")], key=str)
    assert len(blank) == 1 and blank[0][0] == 7
    assert simhash.deduplicate(table.filter("false")).count() == 0


# ------------------------------------------------------------------ vectors

def _cosine(table, threshold=0.98):
    out = {}
    good = [(i, label, np.array(v, float)) for i, (_, v, label) in enumerate(table)
            if table[i][0] is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = [0] * len(table), []
    for a, la, x in good:
        for b, lb, y in good:
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                pairs.append((a, b))
    ids = [r[0] for r in table]
    comp = closure(len(table), pairs)
    smallest = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            smallest[c] = min(smallest.get(c, ids[i]), ids[i])
    for i in range(len(table)):
        out.setdefault(ids[i], []).append((links[i], smallest.get(comp[i]) if ids[i] is not None else None))
    return {k: sorted(v, key=str) for k, v in out.items()}


def _vectors(seed, n=300, dim=8, spread=0.07):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    table = []
    for i in range(n):
        c = centres[rng.integers(12)]
        v = c / np.linalg.norm(c) + spread * rng.normal(size=dim)
        table.append((i * 3, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(rng.integers(3))))
    return table


def _near(spark, table):
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(3)
    df = df.withColumn("cell", F.lit(1)).withColumn("vec", F.lit("x")).withColumn("n_links", F.lit(0))
    got = {}
    for r in embedding_dedup.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
        assert r["kept"] == (r["vec_id"] is not None and r["component_id"] == r["vec_id"])
    return {k: sorted(v, key=str) for k, v in got.items()}


@pytest.mark.parametrize("cell, block, copies", [(4096, 4096, 4.0), (20, 16, 50.0), (20, 16, 1.0)])
def test_links_and_components_are_exact(spark, monkeypatch, cell, block, copies):
    """One cell, cells split over and over, and cells that are not worth splitting."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "MAX_COPIES", copies)
    monkeypatch.setattr(embedding_dedup, "PIVOTS", 4)
    monkeypatch.setattr(embedding_dedup, "SALT_ROWS", 30)
    table = _vectors(5)
    table += [(10_000 + i, table[7][1], table[7][2]) for i in range(5)]  # exact copies
    assert _near(spark, table) == _cosine(table)


def test_cells_of_replicas_are_split_or_stay_whole(spark, monkeypatch):
    """Cells over the limit with none, one or a few homes among their rows: no row is lost, all links of homes are found."""
    monkeypatch.setattr(embedding_dedup, "CELL", 100)
    rng = np.random.default_rng(11)
    table, want = [], {}
    for cell, homes in enumerate((0, 1, 2, 3, 8)):
        x = rng.normal(size=(6, 8))[rng.integers(6, size=1500)] + 0.1 * rng.normal(size=(1500, 8))
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, v in enumerate(x):
            table.append((cell, i < homes, cell, i, cell * 10_000 + i, 1, v.tolist()))
        want |= {(cell, i): int((x @ x[i] >= 0.98).sum()) - 1 for i in range(homes)}
    found = spark.createDataFrame(table, "cell bigint, home boolean, k1 bigint, k2 bigint, rep bigint, n bigint, vec array<double>").repartition(4)
    dealt = embedding_dedup.cells(found).collect()
    assert {(r["k1"], r["k2"]) for r in dealt} == {(r[2], r[3]) for r in table}
    assert sorted((r["k1"], r["k2"]) for r in dealt if r["home"]) == sorted(want)
    counts, _ = embedding_dedup.links(found)
    assert {(r["k1"], r["k2"]): r["n_links"] for r in counts.collect()} == want


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    table = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0] * 3, 0), (7, [1.0, None, 3.0], 0),
             (8, [1.0, float("nan"), 3.0], 0), (9, [1.0, float("inf"), 3.0], 0), (10, [1.0, 2.0], 0), (None, v, 0), (11, [1e30, 2e30, 3e30], 0),
             (12, [1e-30, 2e-30, 3e-30], 0), (13, v, 1)]
    got = _near(spark, table)
    assert {k for k, x in got.items() if x[0][0]} == {1, 2, 11, 12}
    assert got[11] == [(3, 1)] and got[None] == [(0, None)] and got[13] == [(0, 13)]
    assert _near(spark, table[:1]) == {1: [(0, 1)]}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0


# ------------------------------------------------------------------- spans

def _removed(texts):
    """Sentences to remove per text, from the definition of spans."""
    found = []
    for i, text in enumerate(texts):
        cuts = substring_dedup.sentences(text) if text else []
        norm = [" ".join(text[a:b].lower().split()) for a, b in cuts]
        size = [len(x.split()) for x in norm]
        runs = set()
        for a in range(len(cuts)):
            for b in range(a + substring_dedup.MIN_SENTENCES, len(cuts) + 1):
                if sum(size[a:b]) >= substring_dedup.MIN_WORDS:
                    runs.add((a, b))
                    break
        for b in range(len(cuts), 0, -1):
            for a in range(b - substring_dedup.MIN_SENTENCES, -1, -1):
                if sum(size[a:b]) >= substring_dedup.MIN_WORDS:
                    runs.add((a, b))
                    break
        found += [(tuple(norm[a:b]), i, a, b) for a, b in runs]
    first, drop = {}, [set() for _ in texts]
    for run, i, a, b in sorted(found, key=lambda x: (x[1], x[2], x[3])):
        if first.setdefault(run, (i, a, b)) != (i, a, b):
            drop[i] |= set(range(a, b))
    return drop


def _prose(rng, n):
    return " ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(900)) for _ in range(rng.randrange(3, 14))).capitalize()
                    + rng.choice([".", "!", ".\n"]) for _ in range(n))


def test_repeated_spans_are_removed_but_for_the_first(spark):
    rng = random.Random(4)
    passages = [_prose(rng, 9) for _ in range(3)]
    texts = [None, "", "One. Two. Three.", "One. Two. Three."]
    for i in range(40):
        parts = _prose(rng, 6).split(" ")
        at = rng.randrange(len(parts))
        texts.append(" ".join([*parts[:at], passages[i % 3], *parts[at:]]))
    texts += [texts[5], texts[6].upper(), passages[0] + "\n" + passages[0]]
    table = docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("at", F.lit(2))
    found = rows(substring_dedup.remove_repeats(table), "doc_id")
    want = _removed(texts)
    assert [r["n_removed"] for r in found] == [len(x) for x in want]
    assert [r["text"] for r in found][:4] == texts[:4]
    for r, text, drop in zip(found, texts, want):
        if drop and r["n_removed"] < r["n_sentences"]:
            pieces = [tuple(map(int, x.split(":"))) for x in r["removed"].split(",")]
            cuts = substring_dedup.sentences(text)
            assert {k for k, c in enumerate(cuts) if any(a <= c[0] and c[1] <= b for a, b in pieces)} == drop
    # a passage stays in the first document that has it, and nowhere else
    core = " ".join(passages[1].split("\n")[0].split()[3:-3])
    assert sum(core in (r["text"] or "").replace("\n", " ") for r in found) <= 1
    assert substring_dedup.remove_repeats(table.filter("false")).count() == 0


def test_sentences_of_odd_texts():
    assert substring_dedup.sentences(" \n ") == []
    assert substring_dedup.sentences("no end") == [(0, 6)]
    assert ["Éa b.", "c", "Dé"] == ["x Éa b. c\nDé"[a:b] for a, b in substring_dedup.sentences("x Éa b. c\nDé")][1:]


def _lower_case(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def test_every_passage_of_over_fifty_words_holds_an_equal_span():
    """Lower-case passages between differing words, without sentence ends or with a few."""
    rng = random.Random(6)
    for k in range(300):
        passage = _lower_case(rng, 51)
        for at in rng.sample(range(51), k % 4):
            passage[at] += "."
        a, b = (set(substring_dedup.spans(" ".join([*_lower_case(rng, rng.randrange(1, 40)), *passage, *_lower_case(rng, rng.randrange(1, 40))]))[0].tolist())
                for _ in range(2))
        assert a & b, k


def test_passages_without_several_sentences_are_removed(spark):
    rng = random.Random(8)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    words = {"one": _lower_case(rng, 90), "two": [*_lower_case(rng, 29), "end.", *_lower_case(rng, 29), "end."]}
    words["arabic"] = ["".join(chr(rng.randrange(0x627, 0x64A)) for _ in range(5)) + ("؟" if i % 12 == 11 else "") for i in range(72)]
    words["hindi"] = ["".join(chr(rng.randrange(0x915, 0x939)) for _ in range(4)) + (" ।" if i % 12 == 11 else "") for i in range(72)]
    passages = {k: " ".join(v) for k, v in words.items()} | {"han": han, "han ends": "。".join(han[i:i + 15] for i in range(0, 400, 15))}
    texts = []
    for passage in passages.values():
        glue = "" if "一" <= passage[0] <= "鿿" else " "
        texts += [glue.join([" ".join(_lower_case(rng, 20)), passage, " ".join(_lower_case(rng, 20))]) for _ in range(2)]
    found = rows(substring_dedup.remove_repeats(docs(spark, texts)), "doc_id")
    for (name, passage), first, later in zip(passages.items(), found[::2], found[1::2]):
        assert first["n_removed"] == 0 and first["text"] == texts[first["doc_id"]], name
        gone = sum(hi - lo for lo, hi in (map(int, x.split(":")) for x in later["removed"].split(",") if x))
        # at most 13 words stay at either end
        assert gone >= len(passage) * (0.9 if name.startswith("han") else 0.5), name


def test_sentence_ends_of_other_scripts():
    for text, want in (("你好。再见！？好", ["你好。", "再见！？", "好"]),
                       ("कख । ग", ["कख ।", "ग"]), ("اب؟ ت", ["اب؟", "ت"])):
        assert [text[a:b] for a, b in substring_dedup.sentences(text)] == want
