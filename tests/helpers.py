import numpy as np

SF001 = "/root/testdata/sf0.001"


def brute_topk(qids, Q, ids, V, k, exclude_self=False):
    """Reference top-k by (squared L2, id) with numpy; dict query -> [(id, d2)]."""
    out = {}
    for qi, q in zip(qids, Q):
        d2 = ((V - q) ** 2).sum(axis=1)
        order = np.lexsort((ids, d2))
        rows = [(int(ids[j]), float(d2[j])) for j in order if not (exclude_self and ids[j] == qi)]
        out[int(qi)] = rows[:k]
    return out


def ranked_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(int(r["query_id"]), []).append((int(r["id"]), float(r["d2"])))
    return out


def assert_same_ranking(got, want, tol=1e-9):
    assert set(got) == set(want)
    for q in want:
        g, w = got[q], want[q]
        assert [i for i, _ in g] == [i for i, _ in w], q
        assert all(abs(a - b) <= tol for (_, a), (_, b) in zip(g, w)), q
