"""Source mixing and temporal URL filters; SQL oracles; the pipeline's stages."""

import datetime as dt
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers_llm import TOKEN, docs, rows
from pyspark.sql import functions as F

from nnspark.llm import decontamination, mixing, oracle, queries, secrets, simhash, toxicity, url_filters

SF001 = "/root/testdata/sf0.001"


def _targets(sizes, weights, share=1.5):
    """Weights per source, capped at twice the size, the excess shared again until none is above."""
    total, full = share * sum(sizes), set()
    while True:
        rest = total - sum(2 * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        each = {i: weights[i] * rest / sum(weights[j] for j in open_) for i in open_} if open_ else {}
        over = {i for i in open_ if each[i] > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in full else each[i] for i in range(len(sizes))]
        full |= over


TEXTS = ["a b c", None, "", " \n", "w " * 5000, "one", "x y", "z " * 37, "é è  ê", "long " * 900, "t " * 64, "u v w x y z"]
SOURCES = ["b", "b", None, "a", "hot", "hot", "hot", "a", "Ω", None, "é", "zz"]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_reaches_its_targets(spark, block):
    table = docs(spark, TEXTS * 3, SOURCES * 3).withColumn("size", F.lit("clash")).withColumn("src", F.lit(1)).withColumn("target", F.lit(0))
    found = rows(mixing.mix(table, block_words=block), "doc_id")
    again = rows(mixing.mix(table.repartition(7), block_words=block), "doc_id")
    assert found == again
    names = sorted({s for s in SOURCES if s is not None}, key=lambda s: s.encode()) + [None]
    size = [len(TOKEN.findall(t or "")) for t in TEXTS * 3]
    per = [sum(n for n, s in zip(size, SOURCES * 3) if s == name) for name in names]
    want = _targets(per, [(3, 1, 2)[i % 3] for i in range(len(names))])
    for r, n, s in zip(found, size, SOURCES * 3, strict=True):
        i = names.index(s)
        assert (r["size"], r["source_size"]) == (n, per[i]) and r["target"] == pytest.approx(want[i])
        assert 0 <= r["taken"] <= 2 * n
    for i, name in enumerate(names):
        taken = sum(r["taken"] for r, s in zip(found, SOURCES * 3) if s == name)
        assert taken == min(int(want[i] + 0.5), 2 * per[i])


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    table = docs(spark, [f"{'w ' * (i % 11)}" for i in range(300)], [("hot" if i % 3 else f"s{i % 7}") for i in range(300)])
    whole = rows(mixing.mix(table, block_words=5), "doc_id")
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(mixing, "SLOTS_PER_CHUNK", 16)
    assert rows(mixing.mix(table, block_words=5), "doc_id") == whole


def test_schedule_interleaves_sources(spark):
    """Any stretch of the schedule holds every source near its share: the points have low discrepancy."""
    table = docs(spark, ["w " * 3000, "w " * 3000, "w " * 6000], ["a", "b", "c"])
    sources = mixing.source_targets(mixing.sized(table))
    slots = mixing.schedule(sources, 10).filter("slot is not null").orderBy("slot").collect()
    share = {r["src"]: r["target"] for r in sources.collect()}
    total = sum(share.values())
    for begin in range(0, len(slots) - 200, 150):
        part = [r["src"] for r in slots[begin:begin + 200]]
        for src, t in share.items():
            assert abs(part.count(src) / 200 - t / total) < 0.03
    assert len({(r["src"], r["rank"]) for r in slots}) == len(slots)


def test_golden_points_keep_precision(spark):
    i = [0, 1, 2, 1 << 20, (1 << 33) + 5, 10**11 + 7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in i], "i long").select(mixing.golden_point(F.col("i"))).collect()]
    assert got == pytest.approx([float(mixing._PHI * x % 1) for x in i], abs=1e-9)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, ["a"]).filter("false")).count() == 0
    empty = mixing.mix(docs(spark, [None, "", " "], ["a", None, "b"])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 3


# --------------------------------------------------------------------- urls

def _time(text):
    return dt.datetime.fromisoformat(text)


ENTRIES = [
    ("bad.com", "block", "add", "2024-01-10"), ("bad.com", "block", "remove", "2024-03-01"), ("bad.com", "block", "add", "2024-05-01"),
    ("ok.bad.com", "allow", "add", "2024-02-01"), ("SPAM.net", "block", "add", "2023-06-01"), ("late.org", "block", "add", "2030-01-01"),
    ("same.org", "block", "add", "2024-01-01"), ("same.org", "block", "remove", "2024-01-01"), (None, "block", "add", "2024-01-01"), ("x.org", "block", "add", None),
]
CAPTURES = [
    ("http://bad.com/a", "2024-01-09T23:59:59"), ("http://bad.com/a", "2024-01-10T00:00:00"), ("https://u:p@WWW.bad.com:80/?q", "2024-02-20T01:00:00"),
    ("http://ok.bad.com", "2024-01-20T00:00:00"), ("http://ok.bad.com", "2024-02-20T00:00:00"), ("http://ok.bad.com", "2024-04-01T00:00:00"),
    ("http://bad.com", "2024-02-29T23:59:59"), ("http://bad.com", "2024-03-01T00:00:00"), ("http://bad.com.", "2024-06-01T00:00:00"),
    ("http://notbad.com", "2024-06-01T00:00:00"), ("http://a.b.spam.net/x", "2024-06-01T00:00:00"), ("ftp://late.org", "2024-06-01T00:00:00"),
    ("http://same.org", "2024-06-01T00:00:00"), (None, "2024-06-01T00:00:00"), ("no url", "2024-06-01T00:00:00"), ("", None), ("http://bad.com", None),
    ("http://bad.com", "2024-06-01T00:00:00"), ("http://bad.com", "2024-06-01T00:00:00"),
]


def _as_of(url, time):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    host = m[1].lower().rstrip(".") if m else None
    if not host or time is None:
        return None if not host else host, 0, None, False
    active = []
    labels = host.split(".")
    for p in {".".join(labels[i:]) for i in range(len(labels))}:
        past = [(d, a, k) for q, k, a, d in ENTRIES if q and d and q.lower() == p and _time(d) <= _time(time)]
        if past and max(past)[1] == "add":
            active.append((len(p), p, max(past)[2]))
    best = max(active, default=None)
    return host, len(active), best and best[1], bool(best and best[2] == "block")


def test_as_of_join_matches_brute_force(spark):
    entries = spark.createDataFrame([(p, k, a, dt.date.fromisoformat(d) if d else None) for p, k, a, d in ENTRIES],
                                    "pattern string, kind string, action string, dated date")
    table = spark.createDataFrame([(i, u, _time(t) if t else None) for i, (u, t) in enumerate(CAPTURES)], "page_id long, url string, fetched_at timestamp_ntz")
    table = table.withColumn("month", F.lit(1)).withColumn("pattern", F.lit("clash")).repartition(3)
    found = rows(url_filters.judge(table, entries), "page_id")
    assert [(r["host"], r["n_active"], r["matched"], r["blocked"]) for r in found] == [_as_of(u, t) for u, t in CAPTURES]
    kept = url_filters.keep_allowed(table, entries)
    assert kept.columns == table.columns and kept.count() == sum(not _as_of(u, t)[3] for u, t in CAPTURES)
    assert not any(r["blocked"] for r in url_filters.judge(table, entries.filter("false")).collect())
    assert url_filters.judge(table.filter("false"), entries).count() == 0


# ------------------------------------------------------------------ oracles

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_queries_match_their_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF001).toPandas(), con.sql(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda df: sorted(repr([None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
                                      for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(want)


# ----------------------------------------------------------------- pipeline

def test_pipeline_stages_apply_their_operators(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "mix"]
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = docs(spark, [None, "", "password=abcdef0123", "password=abcdef0123"], first=10**6).select(*table.columns)
    table = table.union(extra)
    out = [table]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF001).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in out]
    assert all(d.columns == table.columns for d in out[1:5])
    model = toxicity.train(table, spark.read.parquet(f"{SF001}/labels.parquet"))
    assert ids[1] == {r["doc_id"] for r in toxicity.score(table, model).filter("predicted = 0").collect()}
    assert ids[2] == {r["component_id"] for r in simhash.components(out[1]).collect()}
    items = spark.read.parquet(f"{SF001}/benchmark.parquet")
    assert ids[3] == {r["doc_id"] for r in decontamination.report(out[2], items).filter("not contaminated").collect()}
    assert ids[4] == ids[3]
    before, after = ({r["doc_id"]: r for r in out[k].collect()} for k in (3, 4))
    scanned = {r["doc_id"]: r["spans"] for r in secrets.scan(out[3]).collect()}
    for i, r in after.items():
        if scanned[i]:
            assert secrets.MASK in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r == before[i]
    assert rows(out[5], "doc_id") == rows(mixing.mix(out[4]), "doc_id")
    final = corpus_pipeline.run(spark, SF001)
    assert final.columns == out[5].columns and final.count() == len(ids[5]) - len([i for i in ids[5] if i >= 10**6])
