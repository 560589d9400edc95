"""Registered queries against their SQL oracles at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from helpers import SF001

NAMES = ["knn_exact_top20", "knn_k_sweep_sums", "result_spread", "ivf_search_nprobe10", "forest_leaf_sizes",
         "compare_baseline", "parse_keyword_lines", "expand_entity_queries", "hash_split_85", "embed_texts",
         "keyword_file_scan", "entity_list_scan", "ranked_csv_scan", "comparison_csv_scan", "vector_table_scan",
         "ivf_reopened_search"]
TABLES = "nation part events documents embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _canon(df):
    import pandas as pd

    def norm(v):
        if v is None or v is pd.NA:
            return None
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        return v.item() if hasattr(v, "item") else v

    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF001).toPandas()
    want = con.sql(E.oracle_sql()[name]).df()
    assert _canon(got) == _canon(want)


def test_every_query_has_a_callable_and_entry_runs(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert E.entry(spark).count() > 0
