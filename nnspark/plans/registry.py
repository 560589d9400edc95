"""Method registry (X3) and the method sweep.

Any search that returns the ranked-result contract (query_id, rank, id,
dist, d2, cost, n_hits) can be registered under a name; a sweep runs each
method once at max(k) and derives every smaller k as a prefix, unless the
method's work follows k: such a method is searched once per k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnspark.operators import compare, exact, forest, graph, ivf, layered, quality

SearchFn = Callable[..., DataFrame]
_METHODS: dict[str, SearchFn] = {}


def register(name: str):
    def deco(fn: SearchFn) -> SearchFn:
        _METHODS[name] = fn
        return fn

    return deco


def methods() -> list[str]:
    return sorted(_METHODS)


def search(name: str, corpus: DataFrame, queries: DataFrame, k: int, **params) -> DataFrame:
    """Run a registered method; the result carries an ``algo`` column."""
    if name not in _METHODS:
        raise KeyError(f"unknown method {name!r}; known: {methods()}")
    return _METHODS[name](corpus, queries, k, **params).withColumn("algo", F.lit(name))


@register("exact")
def _exact(corpus, queries, k, with_vectors=False, **kw):
    return exact.exact_knn(corpus, queries, k, with_vectors=with_vectors, **kw)


@register("ivf")
def _ivf(corpus, queries, k, index=None, nprobe=10, nlist=None, n_iter=10, with_vectors=False, **kw):
    index = index or ivf.build(corpus, nlist=nlist, n_iter=n_iter)
    return ivf.search(index, queries, k, nprobe, with_vectors=with_vectors, **kw)


@register("forest")
def _forest(corpus, queries, k, index=None, search_k=-1, n_trees=forest.DEFAULT_TREES,
            max_leaf=forest.DEFAULT_MAX_LEAF, with_vectors=False, **kw):
    index = index or forest.build(corpus, n_trees, max_leaf)
    return forest.search(index, queries, k, search_k, corpus=corpus, with_vectors=with_vectors, **kw)


@register("graph")
def _graph(corpus, queries, k, index=None, ef=graph.DEFAULT_EF, m=graph.DEFAULT_M, **kw):
    index = index or graph.build(corpus, m)
    return graph.search(index, queries, k, ef, corpus=corpus, **kw)


@register("layered")
def _layered(corpus, queries, k, index=None, ef=layered.DEFAULT_EF, m=layered.DEFAULT_M, **kw):
    index = index or layered.build(corpus, m)
    return layered.search(index, queries, k, ef, **kw)


def _prefix_stable(name: str, params: dict, kmax: int) -> bool:
    """Whether the first k hits of a search for ``kmax`` are those of a search for k: the forest's
    default budget is k per tree, and the graph's beam is at least k wide."""
    if name == "forest":
        search_k = params.get("search_k", -1)
        return search_k is not None and search_k >= 0
    return name not in ("graph", "layered") or params.get("ef", graph.DEFAULT_EF) >= kmax


def _with_index(name: str, corpus: DataFrame, params: dict) -> dict:
    """``params`` with the index built, so that searches for several k share it."""
    if params.get("index") is not None:
        return params
    if name == "forest":
        index = forest.build(corpus, params.get("n_trees", forest.DEFAULT_TREES),
                             params.get("max_leaf", forest.DEFAULT_MAX_LEAF))
    else:
        index = (layered if name == "layered" else graph).build(corpus, params.get("m", graph.DEFAULT_M))
    return {**params, "index": index}


def sweep(corpus: DataFrame, queries: DataFrame, ks: list[int], plan: dict[str, dict],
          with_spread: bool = True) -> DataFrame:
    """U5 + T2 (+ A1, A2, A7): long metrics (algo, k, query_id, sum_dist, n_hits, cost, spread)
    of every method in ``plan`` ({name: params}) for every k; a smaller k always gives what a search
    for it alone would."""
    kmax = max(ks)
    frames = []
    for name, params in plan.items():
        params = dict(params)
        if with_spread:
            params["with_vectors"] = True
        if _prefix_stable(name, params, kmax):
            sw = exact.k_sweep(search(name, corpus, queries, kmax, **params).drop("algo"), ks)
        else:
            params = _with_index(name, corpus, params)
            sw = reduce(DataFrame.unionByName, [
                exact.k_sweep(search(name, corpus, queries, k, **params).drop("algo"), [k]) for k in ks])
        sp = quality.spread(sw, ["k", "query_id"]) if with_spread else None
        frames.append(compare.metrics(sw, name, ["k"], sp))
    return compare.union_methods(frames)
