"""Physical-plan properties the design relies on at scale."""

import contextlib
import io

import pytest

from nnspark.operators import exact, forest, ivf


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_exact_plan_has_no_cross_join_and_prunes_columns(emb):
    p = plan_text(exact.exact_knn(emb.withColumn("extra", emb.label * 2), exact.self_queries(emb), 20))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p
    tree = [line for line in p.split("\n\n")[0].splitlines()]
    assert "MapInArrow" in p and sum("Exchange" in line for line in tree) == 1


@pytest.fixture(scope="module")
def index(emb):
    return ivf.build(emb, nlist=16, n_iter=2)


def test_ivf_plan_partial_topk_before_shuffle_and_bucket_pruning(index, emb):
    few = exact.self_queries(emb).orderBy("query_id").limit(2)
    p = plan_text(ivf.search(index, few, 5, 2))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BroadcastHashJoin" in p
    # a partial WindowGroupLimit sits below the exchange that feeds the final ranking
    lines = [line for line in p.splitlines() if "WindowGroupLimit" in line or "Exchange" in line]
    assert any("WindowGroupLimit" in line for line in lines)
    assert "list_bucket" in p and " IN (" in p          # static pruning to the probed buckets


def test_forest_search_has_no_cross_join(emb):
    fo = forest.build(emb, n_trees=2, max_leaf=40)
    p = plan_text(forest.search(fo, exact.self_queries(emb), 5, 50, corpus=emb))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
