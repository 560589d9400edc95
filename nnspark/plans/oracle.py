"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark plans: brute-force cross joins and
``row_number()`` where Spark uses kernels, broadcast joins and partial top-k.
Tables are the driver's pre-registered views.
"""

from __future__ import annotations

from nnspark.plans import catalog as C


def d2(a: str, b: str) -> str:
    """Squared L2 of two lists, summed left to right in double."""
    return (f"list_sum(list_transform(list_zip(({a})::DOUBLE[], ({b})::DOUBLE[]), "
            f"lambda p: (p[1] - p[2]) * (p[1] - p[2])))")


def dist(x: str) -> str:
    return f"sqrt(greatest({x}, 0))"


def md5_key(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def exact_topk(k: int, vec: bool = False) -> str:
    extra = ", c.embedding AS v" if vec else ""
    return f"""
    SELECT q.vec_id AS query_id, c.vec_id AS id, {d2('q.embedding', 'c.embedding')} AS d2{extra},
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {d2('q.embedding', 'c.embedding')}, c.vec_id) AS rank
    FROM embeddings q, embeddings c
    WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL
    QUALIFY rank <= {k}"""


def knn_exact_top20() -> str:
    return f"""
    SELECT query_id, rank::INTEGER AS rank, id, round({dist('d2')}, 6) AS dist
    FROM ({exact_topk(C.K_MAIN)})"""


def knn_exact_pruned() -> str:
    return knn_exact_top20()


def knn_sq_l2_top10() -> str:
    return f"""
    SELECT query_id, rank::INTEGER AS rank, id, round(d2, 6) AS d2
    FROM ({exact_topk(10)})"""


def knn_k_sweep_sums() -> str:
    ks = ", ".join(str(k) for k in C.K_SWEEP)
    return f"""
    WITH r AS ({exact_topk(max(C.K_SWEEP))}),
         ks AS (SELECT unnest([{ks}])::INTEGER AS k)
    SELECT ks.k, r.query_id, count(*)::INTEGER AS n_hits, round(sum({dist('r.d2')}), 6) AS sum_dist
    FROM r JOIN ks ON r.rank <= ks.k
    GROUP BY ks.k, r.query_id"""


def knn_with_text() -> str:
    return f"""
    SELECT r.query_id, r.rank::INTEGER AS rank, r.id, coalesce(p.p_name, 'ID ' || r.id::VARCHAR) AS text
    FROM ({exact_topk(10)}) r LEFT JOIN part p ON p.p_partkey = r.id"""


def result_spread() -> str:
    return f"""
    WITH r AS ({exact_topk(C.K_MAIN, vec=True)}),
         pairs AS (SELECT a.query_id, {dist(d2('a.v', 'b.v'))} AS d
                   FROM r a JOIN r b ON a.query_id = b.query_id AND a.rank < b.rank),
         agg AS (SELECT query_id, sum(d) AS s, max(d) AS mx FROM pairs GROUP BY query_id),
         n AS (SELECT query_id, count(*) AS n FROM r GROUP BY query_id)
    SELECT n.query_id,
           round(CASE WHEN n.n < 2 OR coalesce(agg.mx, 0) <= 0 THEN 0.0
                      ELSE agg.s / (agg.mx * n.n * n.n / 2.0) END, 6) AS spread,
           n.n::INTEGER AS n_hits
    FROM n LEFT JOIN agg USING (query_id)"""


def result_proportionality() -> str:
    return f"""
    WITH r AS ({exact_topk(C.K_MAIN, vec=True)}),
         pf AS (SELECT a.query_id, a.id, a.rank, b.rank AS rb, {dist(d2('a.v', 'b.v'))} AS d
                FROM r a JOIN r b ON a.query_id = b.query_id),
         mx AS (SELECT query_id, max(d) AS mx FROM pf GROUP BY query_id)
    SELECT pf.query_id, pf.rank::INTEGER AS rank, pf.id,
           round(sum(CASE WHEN pf.rank = pf.rb THEN 0.0
                          ELSE 1.0 - pf.d / (CASE WHEN mx.mx = 0 THEN 1e-9 ELSE mx.mx END) END), 6)
             AS proportionality
    FROM pf JOIN mx USING (query_id)
    GROUP BY pf.query_id, pf.rank, pf.id"""


# ------------------------------------------------------------------ IVF

def _ivf_base(seed: str = "ivf") -> str:
    return f"""
    base AS (SELECT vec_id, embedding::DOUBLE[] AS v, {md5_key(f"'{seed}:' || vec_id::VARCHAR")} AS h
             FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
    nn AS (SELECT count(*) AS n, floor(4 * sqrt(count(*)))::INTEGER AS nlist FROM base),
    sample AS (SELECT * FROM base
               QUALIFY row_number() OVER (ORDER BY h, vec_id) <= (SELECT least(greatest(100000, 64 * nlist), n) FROM nn))"""


def _round_list(expr: str) -> str:
    return f"list_transform({expr}, lambda x: round(x, 9))"


def _ivf_rounds(n_iter: int) -> str:
    ctes = [f"""
    c0 AS (SELECT (row_number() OVER (ORDER BY h, vec_id) - 1)::INTEGER AS list_id, {_round_list('v')} AS c
           FROM sample QUALIFY row_number() OVER (ORDER BY h, vec_id) <= (SELECT nlist FROM nn))"""]
    for r in range(1, n_iter + 1):
        p = f"c{r - 1}"
        ctes.append(f"""
    a{r} AS (SELECT s.vec_id, s.v, c.list_id FROM sample s, {p} c
             QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY {d2('s.v', 'c.c')}, c.list_id) = 1),
    u{r} AS (SELECT list_id, i, sum(x) / count(*) AS x
             FROM (SELECT list_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r})
             GROUP BY list_id, i),
    c{r} AS (SELECT list_id, list(round(x, 9) ORDER BY i) AS c FROM u{r} GROUP BY list_id
             UNION ALL
             SELECT list_id, c FROM {p} WHERE list_id NOT IN (SELECT list_id FROM u{r}))""")
    return ",".join(ctes)


def ivf_chain(n_iter: int = C.IVF_ITER) -> str:
    """CTEs: base, nn, sample, c0..c{n}, cf (final centroids), post (postings)."""
    return f"""{_ivf_base()},{_ivf_rounds(n_iter)},
    cf AS (SELECT * FROM c{n_iter}),
    post AS (SELECT b.vec_id AS id, b.v, c.list_id FROM base b, cf c
             QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {d2('b.v', 'c.c')}, c.list_id) = 1)"""


def ivf_probe(nprobe: int) -> str:
    return f"""
    SELECT b.vec_id AS query_id, b.v AS qv, c.list_id FROM base b, cf c
    QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {d2('b.v', 'c.c')}, c.list_id) <= {nprobe}"""


def ivf_topk(nprobe: int, k: int) -> str:
    return f"""
    SELECT pr.query_id, p.id, {d2('pr.qv', 'p.v')} AS d2,
           row_number() OVER (PARTITION BY pr.query_id ORDER BY {d2('pr.qv', 'p.v')}, p.id) AS rank
    FROM ({ivf_probe(nprobe)}) pr JOIN post p ON p.list_id = pr.list_id
    QUALIFY rank <= {k}"""


def ivf_train_sample() -> str:
    return f"""
    SELECT vec_id, {md5_key("'ivf:' || vec_id::VARCHAR")} AS h FROM embeddings WHERE vec_id IS NOT NULL
    QUALIFY row_number() OVER (ORDER BY h, vec_id) <= {C.SAMPLE_M}"""


def ivf_lloyd_round() -> str:
    return f"""
    WITH {_ivf_base()},{_ivf_rounds(1)}
    SELECT list_id, (i)::INTEGER AS dim, round(x, 6) AS x
    FROM (SELECT list_id, unnest(c) AS x, unnest(range(len(c))) AS i FROM c1)"""


def ivf_assign_sizes() -> str:
    return f"""
    WITH {ivf_chain()}
    SELECT list_id, count(*)::BIGINT AS size FROM post GROUP BY list_id"""


def ivf_search_nprobe10() -> str:
    return f"""
    WITH {ivf_chain()}
    SELECT query_id, rank::INTEGER AS rank, id, round({dist('d2')}, 6) AS dist FROM ({ivf_topk(10, C.K_MAIN)})"""


def ivf_recall_sweep() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {p} AS nprobe, query_id, id FROM ({ivf_topk(p, C.K_MAIN)})" for p in C.NPROBES
    )
    return f"""
    WITH {ivf_chain()},
         ex AS ({exact_topk(C.K_MAIN)}),
         ap AS ({parts}),
         ne AS (SELECT query_id, count(*) AS n FROM ex GROUP BY query_id),
         sets AS (SELECT p.nprobe, ne.query_id FROM (VALUES (1), (10), (50)) AS p(nprobe), ne),
         hit AS (SELECT ap.nprobe, ap.query_id, count(*) AS c FROM ap JOIN ex USING (query_id, id)
                 GROUP BY ap.nprobe, ap.query_id),
         rec AS (SELECT s.nprobe, s.query_id, coalesce(hit.c, 0) / ne.n AS recall
                 FROM sets s JOIN ne USING (query_id) LEFT JOIN hit USING (nprobe, query_id))
    SELECT nprobe::INTEGER AS nprobe, round(avg(recall), 6) AS recall, count(*)::BIGINT AS n_queries
    FROM rec GROUP BY nprobe"""


def ivf_candidate_cost() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {p} AS nprobe, query_id, list_id FROM ({ivf_probe(p)})" for p in C.NPROBES
    )
    return f"""
    WITH {ivf_chain()},
         sizes AS (SELECT list_id, count(*) AS size FROM post GROUP BY list_id),
         pr AS ({parts})
    SELECT pr.nprobe::INTEGER AS nprobe, pr.query_id, sum(sizes.size)::BIGINT AS cost
    FROM pr JOIN sizes USING (list_id) GROUP BY pr.nprobe, pr.query_id"""


# ------------------------------------------------------------------ forest

def _depth(node: str) -> str:
    return f"(length(bin(({node}) + 1)) - 1)"


FOREST_LEVELS = 40  # levels the SQL writes out; trees over these tables end well before


def forest_chain(levels: int | None = None) -> str:
    """CTEs: fb (vectors), s0..s{L} (membership per level), p0..p{L-1} (splits),
    inner_nodes, node_sizes."""
    L = levels or FOREST_LEVELS
    T, ML = C.FOREST_TREES, C.FOREST_MAX_LEAF
    ctes = [f"""
    fb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    s0 AS (SELECT fb.id, fb.v, t.tree::INTEGER AS tree, 0::BIGINT AS node FROM fb, range({T}) t(tree))"""]
    for lv in range(L):
        h = md5_key("'forest:' || tree::VARCHAR || ':' || node::VARCHAR || ':' || id::VARCHAR")
        ctes.append(f"""
    p{lv} AS (SELECT tree, node, any_value(a0) AS a, arg_max(v, (h, id)) FILTER (v <> a0) AS b
              FROM (SELECT *, first_value(v) OVER (PARTITION BY tree, node ORDER BY h, id) AS a0
                    FROM (SELECT *, {h} AS h FROM s{lv} WHERE {_depth('node')} = {lv}))
              GROUP BY tree, node
              HAVING count(*) > {ML} AND bool_or(v <> a0)),
    s{lv + 1} AS (SELECT s.id, s.v, s.tree,
                  CASE WHEN p.node IS NULL THEN s.node
                       ELSE 2 * s.node + 1 + (CASE WHEN {d2('s.v', 'p.a')} > {d2('s.v', 'p.b')} THEN 1 ELSE 0 END)
                  END AS node
                  FROM s{lv} s LEFT JOIN p{lv} p ON s.tree = p.tree AND s.node = p.node)""")
    splits = " UNION ALL ".join(f"SELECT tree, node, a, b FROM p{lv}" for lv in range(L))
    sizes = " UNION ALL ".join(
        f"SELECT tree, node, count(*) AS size FROM s{lv} WHERE {_depth('node')} = {lv} GROUP BY tree, node"
        for lv in range(L + 1))
    ctes.append(f"""
    inner_nodes AS (SELECT tree, node, a, b, sqrt({d2('a', 'b')}) AS wnorm FROM ({splits})),
    node_sizes AS ({sizes}),
    fpost AS (SELECT tree, node AS leaf, id FROM s{L})""")
    return ",".join(ctes)


def forest_search_ctes(search_k: int, levels: int | None = None) -> str:
    L = levels or FOREST_LEVELS
    T = C.FOREST_TREES
    ctes = [f"""
    f0 AS (SELECT q.id AS query_id, q.v AS qv, t.tree::INTEGER AS tree, 0::BIGINT AS node, 'inf'::DOUBLE AS prio
           FROM fb q, range({T}) t(tree))"""]
    for lv in range(L):
        ctes.append(f"""
    j{lv} AS (SELECT f.*, n.a, n.b, n.wnorm,
                     ({d2('f.qv', 'n.b')} - {d2('f.qv', 'n.a')}) / (2.0 * n.wnorm) AS m
              FROM f{lv} f LEFT JOIN inner_nodes n ON f.tree = n.tree AND f.node = n.node),
    x{lv} AS (SELECT query_id, qv, tree, node, prio FROM j{lv} WHERE a IS NULL
              UNION ALL SELECT query_id, qv, tree, 2 * node + 1, least(prio, m) FROM j{lv} WHERE a IS NOT NULL
              UNION ALL SELECT query_id, qv, tree, 2 * node + 2, least(prio, -m) FROM j{lv} WHERE a IS NOT NULL),
    f{lv + 1} AS (SELECT x.query_id, x.qv, x.tree, x.node, x.prio
                  FROM x{lv} x JOIN node_sizes z ON x.tree = z.tree AND x.node = z.node
                  QUALIFY coalesce(sum(z.size) OVER (PARTITION BY x.query_id ORDER BY x.prio DESC, x.tree, x.node
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {search_k})""")
    ctes.append(f"""
    fcand AS (SELECT DISTINCT f.query_id, p.id FROM f{L} f JOIN fpost p ON p.tree = f.tree AND p.leaf = f.node)""")
    return ",".join(ctes)


def forest_best_first() -> str:
    """Every leaf of every tree by falling priority, up to 400 members; no search order is involved."""
    ctes = [f"""
    f0 AS (SELECT q.id AS query_id, q.v AS qv, t.tree::INTEGER AS tree, 0::BIGINT AS node, 'inf'::DOUBLE AS prio
           FROM fb q, range({C.FOREST_TREES}) t(tree))"""]
    for lv in range(FOREST_LEVELS):
        ctes.append(f"""
    j{lv} AS (SELECT f.*, n.a, ({d2('f.qv', 'n.b')} - {d2('f.qv', 'n.a')}) / (2.0 * n.wnorm) AS m
              FROM f{lv} f LEFT JOIN inner_nodes n ON f.tree = n.tree AND f.node = n.node),
    f{lv + 1} AS (SELECT query_id, qv, tree, node, prio FROM j{lv} WHERE a IS NULL
              UNION ALL SELECT query_id, qv, tree, 2 * node + 1, least(prio, m) FROM j{lv} WHERE a IS NOT NULL
              UNION ALL SELECT query_id, qv, tree, 2 * node + 2, least(prio, -m) FROM j{lv} WHERE a IS NOT NULL)""")
    return f"""
    WITH {forest_chain()},{",".join(ctes)},
         opened AS (SELECT x.query_id, x.tree, x.node FROM f{FOREST_LEVELS} x
                    JOIN node_sizes z ON x.tree = z.tree AND x.node = z.node
                    QUALIFY coalesce(sum(z.size) OVER (PARTITION BY x.query_id ORDER BY x.prio DESC, x.tree, x.node
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 400),
         cand AS (SELECT DISTINCT o.query_id, p.id FROM opened o JOIN fpost p ON p.tree = o.tree AND p.leaf = o.node),
         fd AS (SELECT c.query_id, c.id, {d2('q.v', 'b.v')} AS d2
                FROM cand c JOIN fb q ON q.id = c.query_id JOIN fb b ON b.id = c.id),
         fc AS (SELECT query_id, count(*) AS cost FROM fd GROUP BY query_id)
    SELECT fd.query_id, rank::INTEGER AS rank, fd.id, round({dist('fd.d2')}, 6) AS dist, fc.cost::BIGINT AS cost
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rank FROM fd QUALIFY rank <= 20) fd
    JOIN fc USING (query_id)"""


def forest_leaf_sizes() -> str:
    return f"""
    WITH {forest_chain()}
    SELECT tree, leaf, count(*)::BIGINT AS size FROM fpost GROUP BY tree, leaf"""


def forest_search_budget() -> str:
    return f"""
    WITH {forest_chain()},{forest_search_ctes(C.FOREST_SEARCH_K)},
         fd AS (SELECT c.query_id, c.id, {d2('q.v', 'b.v')} AS d2
                FROM fcand c JOIN fb q ON q.id = c.query_id JOIN fb b ON b.id = c.id),
         fc AS (SELECT query_id, count(*) AS cost FROM fd GROUP BY query_id)
    SELECT fd.query_id, rank::INTEGER AS rank, fd.id, round({dist('fd.d2')}, 6) AS dist, fc.cost::BIGINT AS cost
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rank FROM fd QUALIFY rank <= {C.K_MAIN}) fd
    JOIN fc USING (query_id)"""


# ------------------------------------------------------------------ comparison

def _ivf_cost(nprobe: int) -> str:
    return f"""SELECT pr.query_id, sum(z.size) AS cost
               FROM ({ivf_probe(nprobe)}) pr JOIN (SELECT list_id, count(*) AS size FROM post GROUP BY list_id) z
               USING (list_id) GROUP BY pr.query_id"""


def compare_baseline_ctes() -> str:
    return f"""{ivf_chain()},
         ex AS ({exact_topk(C.K_MAIN)}),
         ap AS ({ivf_topk(C.IVF_NPROBE, C.K_MAIN)}),
         nb AS (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL),
         bs AS (SELECT query_id, sum({dist('d2')}) AS s, count(*) AS n FROM ex GROUP BY query_id),
         cs AS (SELECT query_id, sum({dist('d2')}) AS s, count(*) AS n FROM ap GROUP BY query_id),
         cc AS ({_ivf_cost(C.IVF_NPROBE)}),
         cmp AS (SELECT bs.query_id, bs.s AS base_sum, coalesce(cs.s, 0.0) AS cand_sum,
                        CASE WHEN bs.s > 0 THEN (coalesce(cs.s, 0.0) - bs.s) / bs.s * 100.0 ELSE 0.0 END AS pct_diff,
                        nb.n AS base_cost, coalesce(cc.cost, 0) AS cand_cost,
                        CASE WHEN coalesce(cc.cost, 0) > 0 THEN nb.n / cc.cost ELSE 1.0 END AS speedup,
                        coalesce(cs.n, 0) AS cand_n_hits
                 FROM bs CROSS JOIN nb LEFT JOIN cs USING (query_id) LEFT JOIN cc USING (query_id))"""


def compare_baseline() -> str:
    return f"""
    WITH {compare_baseline_ctes()}
    SELECT query_id, round(base_sum, 6) AS base_sum, round(cand_sum, 6) AS cand_sum, round(pct_diff, 6) AS pct_diff,
           base_cost::BIGINT AS base_cost, cand_cost::BIGINT AS cand_cost, round(speedup, 6) AS speedup,
           cand_n_hits::INTEGER AS cand_n_hits
    FROM cmp"""


def compare_totals() -> str:
    return f"""
    WITH {compare_baseline_ctes()},
         t AS (SELECT count(*) AS n, coalesce(avg(pct_diff), 0.0) AS p, coalesce(avg(base_cost), 0.0) AS b,
                      coalesce(avg(cand_cost), 0.0) AS c, coalesce(avg(speedup), 1.0) AS m FROM cmp)
    SELECT n::BIGINT AS n_queries, round(p, 6) AS avg_pct_diff, round(b, 6) AS avg_base_cost,
           round(c, 6) AS avg_cand_cost, round(m, 6) AS mean_of_speedups,
           round(CASE WHEN c > 0 THEN b / c ELSE 1.0 END, 6) AS speedup_of_means
    FROM t"""


def _topk_from(cands: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rank FROM ({cands}))
               WHERE rank <= {k}"""


def sweep_long_ctes(with_spread: bool = True) -> str:
    kmax = max(C.K_SWEEP)
    ks = ", ".join(str(k) for k in C.K_SWEEP)
    ivf_c = f"""SELECT pr.query_id, p.id, {d2('pr.qv', 'p.v')} AS d2, p.v
                FROM ({ivf_probe(C.IVF_NPROBE)}) pr JOIN post p ON p.list_id = pr.list_id"""
    fo_c = f"""SELECT c.query_id, c.id, {d2('q.v', 'b.v')} AS d2, b.v
               FROM fcand c JOIN fb q ON q.id = c.query_id JOIN fb b ON b.id = c.id"""
    ex_c = f"""SELECT q.vec_id AS query_id, c.vec_id AS id, {d2('q.embedding', 'c.embedding')} AS d2,
                      c.embedding::DOUBLE[] AS v
               FROM embeddings q, embeddings c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL"""
    spread_ctes = f""",
         pairs AS (SELECT a.algo, a.k, a.query_id, {dist(d2('a.v', 'b.v'))} AS d
                   FROM sw a JOIN sw b ON a.algo = b.algo AND a.k = b.k AND a.query_id = b.query_id AND a.rank < b.rank),
         sp AS (SELECT algo, k, query_id, sum(d) AS s, max(d) AS mx FROM pairs GROUP BY algo, k, query_id)""" \
        if with_spread else ""
    spread_col = ("CASE WHEN m.n < 2 OR coalesce(sp.mx, 0) <= 0 THEN 0.0 ELSE sp.s / (sp.mx * m.n * m.n / 2.0) END"
                  if with_spread else "NULL::DOUBLE")
    spread_join = "LEFT JOIN sp USING (algo, k, query_id)" if with_spread else ""
    return f"""{ivf_chain()},{forest_chain()},{forest_search_ctes(C.FOREST_SEARCH_K)},
         nb AS (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL),
         r AS (SELECT 'exact' AS algo, query_id, id, d2, v, rank FROM ({_topk_from(ex_c, kmax)})
               UNION ALL SELECT 'ivf', query_id, id, d2, v, rank FROM ({_topk_from(ivf_c, kmax)})
               UNION ALL SELECT 'forest', query_id, id, d2, v, rank FROM ({_topk_from(fo_c, kmax)})),
         costs AS (SELECT 'exact' AS algo, e.vec_id AS query_id, nb.n AS cost FROM embeddings e CROSS JOIN nb
                   WHERE e.embedding IS NOT NULL
                   UNION ALL SELECT 'ivf', query_id, cost FROM ({_ivf_cost(C.IVF_NPROBE)})
                   UNION ALL SELECT 'forest', query_id, count(*) FROM fcand GROUP BY query_id),
         ks AS (SELECT unnest([{ks}])::INTEGER AS k),
         sw AS (SELECT ks.k, r.* FROM r JOIN ks ON r.rank <= ks.k),
         m AS (SELECT algo, k, query_id, sum({dist('d2')}) AS sum_dist, count(*) AS n FROM sw
               GROUP BY algo, k, query_id){spread_ctes},
         lng AS (SELECT m.algo, m.k, m.query_id, m.sum_dist, m.n AS n_hits, costs.cost,
                        {spread_col} AS spread, 'label_' || e.label::VARCHAR AS dataset
                 FROM m JOIN costs USING (algo, query_id) {spread_join}
                 JOIN embeddings e ON e.vec_id = m.query_id)"""


def _wide_select() -> str:
    cols = []
    for a in C.ALGOS:
        cols.append(f"max(CASE WHEN algo = '{a}' THEN cost END) AS {a}_cost")
        cols.append(f"max(CASE WHEN algo = '{a}' THEN sum_dist END) AS {a}_sum_dist")
        cols.append(f"max(CASE WHEN algo = '{a}' THEN spread END) AS {a}_spread")
    return ", ".join(cols)


def _wide_cte() -> str:
    outer = ["dataset", "k", "query_id"]
    for a in C.ALGOS:
        outer += [f"{a}_cost", f"{a}_sum_dist", f"{a}_spread"]
    for a in C.ALGOS:
        if a == "exact":
            continue
        outer.append(f"""CASE WHEN {a}_cost IS NULL THEN NULL WHEN {a}_cost > 0 THEN exact_cost / {a}_cost
                         ELSE 1.0 END AS {a}_speedup""")
        outer.append(f"""CASE WHEN {a}_sum_dist IS NULL THEN NULL WHEN exact_sum_dist > 0
                         THEN ({a}_sum_dist - exact_sum_dist) / exact_sum_dist * 100.0 ELSE 0.0 END AS {a}_pct_diff""")
    return f"""wide AS (SELECT {", ".join(outer)} FROM (SELECT dataset, k, query_id, {_wide_select()} FROM lng
                     GROUP BY dataset, k, query_id) WHERE exact_sum_dist IS NOT NULL)"""


def _wide_numeric() -> list[str]:
    cols = []
    for a in C.ALGOS:
        cols += [f"{a}_cost", f"{a}_sum_dist", f"{a}_spread"]
    for a in C.ALGOS:
        if a != "exact":
            cols += [f"{a}_speedup", f"{a}_pct_diff"]
    return cols


def sweep_wide() -> str:
    sel = ["dataset", "k", "query_id"]
    for c in _wide_numeric():
        sel.append(f"{c}::BIGINT AS {c}" if c.endswith("_cost") else f"round({c}, 6) AS {c}")
    return f"""
    WITH {sweep_long_ctes()}, {_wide_cte()}
    SELECT {", ".join(sel)} FROM wide"""


def sweep_summary_stats() -> str:
    parts = []
    for t, fn in (("MEAN", "avg"), ("MAX", "max"), ("MIN", "min"), ("STD", "stddev_samp")):
        cols = ", ".join(f"round({fn}({c}::DOUBLE), 6) AS {c}" for c in _wide_numeric())
        parts.append(f"SELECT k, '{t}' AS type, {cols} FROM wide GROUP BY k")
    return f"""
    WITH {sweep_long_ctes()}, {_wide_cte()}
    {" UNION ALL ".join(parts)}"""


def cost_quartiles() -> str:
    return f"""
    WITH {sweep_long_ctes(with_spread=False)},
         q AS (SELECT algo, k, count(*) AS n, quantile_cont(cost::DOUBLE, [0.25, 0.5, 0.75]) AS qs
               FROM lng GROUP BY algo, k),
         j AS (SELECT lng.algo, lng.k, lng.cost::DOUBLE AS v, q.n, q.qs[1] AS q1, q.qs[2] AS med, q.qs[3] AS q3
               FROM lng JOIN q USING (algo, k))
    SELECT algo, k, n::BIGINT AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
           round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_lo,
           round(max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_hi,
           round(min(v), 6) AS min, round(max(v), 6) AS max
    FROM j GROUP BY algo, k, n, q1, med, q3"""


def dataset_change_marker() -> str:
    return f"""
    WITH m AS (SELECT ks.k, e.vec_id AS query_id, 'label_' || e.label::VARCHAR AS dataset
               FROM embeddings e, (SELECT unnest([{", ".join(str(k) for k in C.K_SWEEP)}])::INTEGER AS k) ks
               WHERE e.embedding IS NOT NULL)
    SELECT k, query_id, dataset,
           coalesce(dataset <> lag(dataset) OVER (ORDER BY k, query_id), false) AS marker
    FROM m"""


# ------------------------------------------------------------------ text, queries, datasets

# Python's whitespace, written out: the definition, not the parser's own pattern.
PY_SPACE = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
            r"\x{205F}\x{3000}")


def _keyword_lines() -> str:
    return """
        SELECT 'part' AS src, p_partkey AS key, 0 AS pos, concat_ws(' ', p_partkey::VARCHAR, p_name) AS line FROM part
        UNION ALL
        SELECT 'documents', doc_id, pos, line FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"""


def _split_lines(lines: str) -> str:
    """``lines`` plus tok and txt: the stripped line split once at whitespace; is_id: tok is a 64-bit integer."""
    return f"""
        SELECT *, regexp_full_match(tok, '[+-]?[0-9]+') AND TRY_CAST(tok AS BIGINT) IS NOT NULL AS is_id FROM (
            SELECT *, regexp_extract(s, '^[^{PY_SPACE}]+') AS tok,
                   regexp_replace(s, '^[^{PY_SPACE}]+[{PY_SPACE}]*', '') AS txt
            FROM (SELECT *, regexp_replace(line, '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g') AS s FROM ({lines})))"""


def parse_keyword_lines() -> str:
    return f"""
    SELECT src, key, pos::INTEGER AS pos,
           CASE WHEN coalesce(tok, '') = '' OR txt = '' THEN 'skip' WHEN is_id THEN 'ok' ELSE 'reject' END AS status,
           CASE WHEN txt <> '' AND is_id THEN tok::BIGINT END AS id, CASE WHEN txt <> '' AND is_id THEN txt END AS text
    FROM ({_split_lines(_keyword_lines())})"""


def keep_last_text() -> str:
    return "SELECT p_size AS id, arg_max(p_name, p_partkey) AS text FROM part GROUP BY p_size"


def distinct_first_seen() -> str:
    return "SELECT p_name AS value, min(p_partkey) AS ord, count(*)::BIGINT AS n FROM part GROUP BY p_name"


def expand_entity_queries() -> str:
    from nnspark.operators.querygen import EXPANSION_RULES, MAX_VARIANTS

    def fill(t: str) -> str:
        out, rest = [], t
        while rest:
            iy, i_f = rest.find("{year}"), rest.find("{frat}")
            c = [(i, g) for i, g in ((iy, "year"), (i_f, "frat")) if i >= 0]
            if not c:
                out.append("'" + rest.replace("'", "''") + "'")
                break
            i, g = min(c)
            if i:
                out.append("'" + rest[:i].replace("'", "''") + "'")
            out.append(g)
            rest = rest[i + 6:]
        return " || ".join(out)

    branches = " ".join(
        f"WHEN contains(e, '{p}') THEN [base, {', '.join(fill(t) for t in ts)}]" for p, ts in EXPANSION_RULES
    )
    return f"""
    WITH ents AS (SELECT n_name AS e, n_nationkey::BIGINT AS o FROM nation
                  UNION ALL SELECT p_name, 4294967296 + p_partkey FROM part),
         ent AS (SELECT e, min(o) AS o FROM ents WHERE e IS NOT NULL GROUP BY e),
         b AS (SELECT e, o, replace(replace(e, 'List_of_', ''), '_', ' ') AS base, split_part(e, '_', 1) AS year
               FROM ent),
         v AS (SELECT o, CASE {branches} ELSE [base] END AS arr
               FROM (SELECT *, replace(base, ' chapters', '') AS frat FROM b))
    SELECT q AS query, min(o * {MAX_VARIANTS} + i)::BIGINT AS ord
    FROM (SELECT o, unnest(arr) AS q, unnest(range(len(arr))) AS i FROM v)
    GROUP BY q"""


def corpus_shape() -> str:
    return """
    WITH d AS (SELECT max(len(embedding)) AS d FROM embeddings WHERE embedding IS NOT NULL)
    SELECT count(*)::BIGINT AS n, min(len(embedding))::INTEGER AS dim_min, max(len(embedding))::INTEGER AS dim_max,
           count(DISTINCT label)::BIGINT AS n_labels,
           sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null,
           sum(CASE WHEN len(embedding) = (SELECT d FROM d) THEN 1 ELSE 0 END)::BIGINT AS n_width_ok
    FROM embeddings"""


def hash_split_85() -> str:
    key = ("concat_ws('|', coalesce(user_id::VARCHAR, ''), coalesce(event_type, ''), "
           "coalesce(round(value * 100)::BIGINT::VARCHAR, ''), coalesce(props, ''))")
    return f"""
    SELECT event_id,
           CASE WHEN {md5_key("'split:' || " + key)} / 4294967296.0 < 0.85 THEN 'train' ELSE 'test' END AS split
    FROM events"""


def class_codes() -> str:
    names = ", ".join(f"'{n}'" for n in C.EVENT_TYPES)
    return f"""
    SELECT event_type, (coalesce(list_position([{names}], event_type), 0) - 1)::INTEGER AS code,
           count(*)::BIGINT AS n
    FROM events GROUP BY event_type"""


# ------------------------------------------------------------------ embedding

def _trigram_counts(table: str, id_col: str, text_col: str) -> str:
    from nnspark.operators.embed import DEFAULT_DIM

    return f"""
    SELECT id, j, count(*) AS cnt FROM (
        SELECT id, ({md5_key("'tri:' || gram")} % {DEFAULT_DIM})::INTEGER AS j FROM (
            SELECT {id_col} AS id,
                   unnest(list_transform(range(1, greatest(length(lower({text_col})) - 2, 1) + 1),
                                         lambda i: substr(lower({text_col}), i, 3))) AS gram
            FROM {table}))
    GROUP BY id, j"""


def embed_texts() -> str:
    return f"""
    WITH c AS ({_trigram_counts('part', 'p_partkey', 'p_name')}),
         nrm AS (SELECT id, sqrt(sum(cnt * cnt)) AS nrm FROM c GROUP BY id)
    SELECT id, j AS dim, round(cnt / nrm, 6) AS weight FROM c JOIN nrm USING (id)"""


def _embedded(table: str, id_col: str, text_col: str) -> str:
    from nnspark.operators.embed import DEFAULT_DIM

    return f"""
    SELECT g.id, list((coalesce(c.cnt, 0) / nrm.nrm)::FLOAT ORDER BY g.j) AS v
    FROM (SELECT {id_col} AS id, unnest(range({DEFAULT_DIM}))::INTEGER AS j FROM {table}) g
    LEFT JOIN ({_trigram_counts(table, id_col, text_col)}) c ON c.id = g.id AND c.j = g.j
    JOIN (SELECT id, sqrt(sum(cnt * cnt)) AS nrm FROM ({_trigram_counts(table, id_col, text_col)}) GROUP BY id) nrm
      ON nrm.id = g.id
    GROUP BY g.id"""


def text_query_search() -> str:
    return f"""
    WITH cv AS ({_embedded('part', 'p_partkey', 'p_name')}),
         qv AS ({_embedded('nation', 'n_nationkey::BIGINT', 'n_name')}),
         r AS (SELECT q.id AS query_id, c.id, {d2('q.v', 'c.v')} AS d2,
                      row_number() OVER (PARTITION BY q.id ORDER BY {d2('q.v', 'c.v')}, c.id) AS rank
               FROM qv q, cv c QUALIFY rank <= {C.TEXT_K})
    SELECT r.query_id, r.rank::INTEGER AS rank, r.id, round({dist('r.d2')}, 6) AS dist,
           coalesce(p.p_name, 'ID ' || r.id::VARCHAR) AS text
    FROM r LEFT JOIN part p ON p.p_partkey = r.id"""


# ------------------------------------------------------------------ graph

def graph_knn_edges() -> str:
    return f"""
    SELECT q.vec_id AS src, c.vec_id AS dst,
           (row_number() OVER (PARTITION BY q.vec_id ORDER BY {d2('q.embedding', 'c.embedding')}, c.vec_id))::INTEGER
             AS rank
    FROM embeddings q, embeddings c
    WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL AND q.vec_id <> c.vec_id
    QUALIFY rank <= {C.GRAPH_M}"""


def _level(ident: str) -> str:
    """Level of a vector: u is one less the hash over 2^32, and layers thin out by 16."""
    return f"floor(-ln(1.0 - {md5_key(f"'layer:' || {ident}::VARCHAR")} / 4294967296.0) / ln(16))::INTEGER"


def graph_levels() -> str:
    return f"SELECT vec_id, {_level('vec_id')} AS level FROM embeddings"


def graph_layer_edges() -> str:
    return f"""
    WITH RECURSIVE
    node AS (SELECT min(vec_id) AS id, embedding AS v FROM embeddings
             WHERE embedding IS NOT NULL AND vec_id IS NOT NULL GROUP BY embedding),
    lay AS (SELECT id, v, unnest(generate_series(0, {_level('id')})) AS layer FROM node),
    cand AS (
      SELECT a.layer, a.id AS src, b.id AS dst, b.v, {d2('a.v', 'b.v')} AS d,
             row_number() OVER (PARTITION BY a.layer, a.id ORDER BY {d2('a.v', 'b.v')}, b.id) AS r
      FROM lay a JOIN lay b ON a.layer = b.layer AND a.id <> b.id QUALIFY r <= 24),
    walk AS (
      SELECT layer, src, r, [{{'dst': dst, 'v': v, 'd': d}}] AS kept FROM cand WHERE r = 1
      UNION ALL
      SELECT c.layer, c.src, c.r,
             CASE WHEN len(kept) < 16 AND len(list_filter(kept, lambda k: {d2('k.v', 'c.v')} <= c.d)) = 0
                  THEN list_append(kept, {{'dst': c.dst, 'v': c.v, 'd': c.d}}) ELSE kept END
      FROM walk w JOIN cand c ON c.layer = w.layer AND c.src = w.src AND c.r = w.r + 1),
    last AS (SELECT layer, src, kept FROM walk QUALIFY row_number() OVER (PARTITION BY layer, src ORDER BY r DESC) = 1)
    SELECT layer::INTEGER AS layer, src, e.dst AS dst, round(e.d, 6) AS d2
    FROM (SELECT layer, src, unnest(kept) AS e FROM last)"""


# ------------------------------------------------------------------ file sources and sinks

def _fixed(expr: str, places: int) -> str:
    """A double as a fixed-point number rounds: half away from zero on its shortest decimal form."""
    return f"round(({expr})::DOUBLE::VARCHAR::DECIMAL(38, 18), {places})::DOUBLE"


def keyword_file_scan() -> str:
    numbered = f"""SELECT row_number() OVER (ORDER BY src, key, pos) - 1 AS line_no, replace(line, chr(13), ' ') AS line
                   FROM ({_keyword_lines()})"""
    return f"""
    SELECT line_no::BIGINT AS line_no, CASE WHEN is_id THEN 'ok' ELSE 'reject' END AS status,
           CASE WHEN is_id THEN tok::BIGINT END AS id, CASE WHEN is_id THEN txt ELSE line END AS text
    FROM ({_split_lines(numbered)})
    WHERE tok <> '' AND txt <> ''"""


def entity_list_scan() -> str:
    return """
    SELECT entity, min(ord)::BIGINT AS ord, count(*)::BIGINT AS n
    FROM (SELECT trim(p_name) || chr(10) || '""' AS entity, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part)
    GROUP BY entity"""


def ranked_csv_scan() -> str:
    return f"""
    WITH c AS (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL)
    SELECT 'q' || query_id AS query, round(sum({_fixed(dist('d2'), 6)}), 6) AS sum_dist, max(c.n)::BIGINT AS cost,
           count(*)::INTEGER AS n_hits
    FROM ({exact_topk(5)}), c GROUP BY query_id"""


def ranked_csv_rejects() -> str:
    good = "id % 11 <> 0 AND id % 7 <> 0"
    return f"""
    SELECT 'q' || query_id AS query, count(*) FILTER ({good})::BIGINT AS n_good,
           round(coalesce(sum({_fixed(dist('d2'), 6)}) FILTER ({good}), 0), 6) AS sum_dist,
           count(*) FILTER (id % 11 = 0)::BIGINT AS n_rank, count(*) FILTER (id % 11 <> 0 AND id % 7 = 0)::BIGINT AS n_dist
    FROM ({exact_topk(10)}) GROUP BY query_id"""


def labelled_partition_scan() -> str:
    devices = """['Danmini_Doorbell', 'Ecobee_Thermostat', 'Ennio_Doorbell', 'Philips_B120N10_Baby_Monitor',
        'Provision_PT_737E_Security_Camera', 'Provision_PT_838_Security_Camera', 'Samsung_SNH_1011_N_Webcam',
        'SimpleHome_XCS7_1002_WHT_Security_Camera', 'SimpleHome_XCS7_1003_WHT_Security_Camera', 'odd / name=1%']"""
    attacks = """['benign_traffic', 'combo', 'junk', 'mirai-ack', 'mirai-scan', 'mirai-syn', 'mirai-udp', 'mirai-udpplain',
        'scan', 'tcp', 'udp']"""
    return f"""
    SELECT event_id::FLOAT::BIGINT AS event_id, user_id::FLOAT::BIGINT AS user_id, ({devices})[user_id % 10 + 1] AS device,
           CASE WHEN user_id % 10 = 9 THEN -1 ELSE user_id % 10 END::INTEGER AS device_code,
           ({attacks})[event_id % 11 + 1] AS attack, (event_id % 11)::INTEGER AS attack_code, n_values,
           n_values = 4 AND event_id % 13 <> 0 AS width_ok
    FROM (SELECT *, (3 + (event_id % 10 <> 0)::INTEGER + (event_id % 17 = 0)::INTEGER)::INTEGER AS n_values FROM events)"""


def ivf_appended_assignment() -> str:
    """Two rounds of 16 lists over the earlier half; then every vector in its nearest list."""
    key = md5_key("'ivf:' || vec_id::VARCHAR")
    near = lambda v, c: f"arg_min(c.list_id, ({d2(v, c)}, c.list_id))"
    rounds = "".join(f"""
    l{i} AS (SELECT s.id, s.v, {near('s.v', 'c.c')} AS list_id FROM s, c{i} c GROUP BY s.id, s.v),
    x{i} AS (SELECT list_id, j, round(avg(v[j]), 9) AS x FROM (SELECT list_id, v, unnest(range(1, len(v) + 1)) AS j FROM l{i})
             GROUP BY list_id, j),
    c{i + 1} AS (SELECT c.list_id, coalesce(m.c, c.c) AS c
                 FROM c{i} c LEFT JOIN (SELECT list_id, list(x ORDER BY j) AS c FROM x{i} GROUP BY list_id) m USING (list_id)),"""
                     for i in range(2))
    return f"""
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {key} AS h FROM embeddings WHERE embedding IS NOT NULL),
    mid AS (SELECT max(id) AS m FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n
            FROM embeddings) WHERE r <= ceil(n * 0.5)),
    s AS (SELECT e.* FROM e, mid WHERE e.id <= mid.m),
    c0 AS (SELECT row_number() OVER (ORDER BY h, id) - 1 AS list_id, list_transform(v, lambda x: round(x, 9)) AS c
           FROM s QUALIFY list_id < 16),{rounds}
    post AS (SELECT e.id, {near('e.v', 'c.c')} AS list_id FROM e, c2 c GROUP BY e.id)
    SELECT id AS vec_id, list_id::INTEGER AS list_id, 'appended' AS how FROM post"""


def registry_sweep() -> str:
    return f"""
    WITH {ivf_chain()},
         hits AS (SELECT 'exact' AS algo, query_id, rank, d2 FROM ({exact_topk(C.K_MAIN)})
                  UNION ALL SELECT 'ivf', query_id, rank, d2 FROM ({ivf_topk(10, C.K_MAIN)})),
         ks AS (SELECT unnest([5, 20])::INTEGER AS k)
    SELECT algo, k, query_id, count(*)::INTEGER AS n_hits, round(sum({dist('d2')}), 6) AS sum_dist
    FROM hits JOIN ks ON rank <= k GROUP BY algo, k, query_id"""


def comparison_csv_scan() -> str:
    return f"""
    WITH {compare_baseline_ctes()}
    SELECT 'q' || query_id AS query, {_fixed('base_sum', 4)} AS base_sum, {_fixed('cand_sum', 4)} AS cand_sum,
           {_fixed('pct_diff', 2)} AS pct_diff, base_cost::DOUBLE AS base_cost, cand_cost::DOUBLE AS cand_cost,
           {_fixed('speedup', 2)} AS speedup
    FROM cmp"""


def vector_table_scan() -> str:
    return """
    SELECT vec_id, label, len(embedding)::INTEGER AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total
    FROM embeddings"""


def sweep_tables_scan() -> str:
    return f"""
    SELECT s.*, d.n_diffs FROM ({sweep_summary_stats()}) s
    JOIN (SELECT k, count(*)::BIGINT AS n_diffs FROM ({sweep_wide()}) GROUP BY k) d USING (k)"""


def ivf_reopened_search() -> str:
    return ivf_search_nprobe10()


def forest_reopened_leaf_sizes() -> str:
    return forest_leaf_sizes()


def all_sql() -> dict[str, str]:
    names = [
        "knn_exact_top20", "knn_exact_pruned", "knn_sq_l2_top10", "knn_k_sweep_sums", "knn_with_text", "result_spread",
        "result_proportionality", "ivf_train_sample", "ivf_lloyd_round", "ivf_assign_sizes",
        "ivf_search_nprobe10", "ivf_recall_sweep", "ivf_candidate_cost",
        "forest_leaf_sizes", "forest_search_budget", "forest_best_first",
        "compare_baseline", "compare_totals", "sweep_wide", "sweep_summary_stats", "cost_quartiles",
        "dataset_change_marker", "parse_keyword_lines", "keep_last_text", "distinct_first_seen",
        "expand_entity_queries", "corpus_shape", "hash_split_85", "class_codes", "embed_texts",
        "text_query_search", "graph_knn_edges", "graph_levels", "graph_layer_edges",
        "keyword_file_scan", "entity_list_scan", "ranked_csv_scan", "comparison_csv_scan", "vector_table_scan",
        "sweep_tables_scan", "ivf_reopened_search", "forest_reopened_leaf_sizes", "ranked_csv_rejects", "labelled_partition_scan",
        "ivf_appended_assignment", "registry_sweep",
    ]
    g = globals()
    return {n: g[n]() for n in names if n in g}
