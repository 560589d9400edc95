"""Print the formatted physical plans of the headline searches.

    python tools/explain_plans.py [sf_dir]

Look for: a pruned ReadSchema on the corpus scan, no CartesianProduct or
BroadcastNestedLoopJoin, a partial WindowGroupLimit below each exchange that
feeds a top-k, and PartitionFilters on list_bucket for the IVF postings.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nnspark.operators import exact, ivf  # noqa: E402
from nnspark.plans import catalog as C  # noqa: E402
from nnspark.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    emb = C.corpus(spark, sf)
    few = exact.self_queries(emb).orderBy("query_id").limit(5)
    plans = {
        "exact top-20 (all vectors as queries)": C.exact_ranked(spark, sf),
        "IVF nprobe 10, five queries": ivf.search(C.ivf_index(spark, sf), few, 20, 10),
        "forest search_k 400, five queries": C.forest.search(C.forest_index(spark, sf), few, 20, 400, corpus=emb),
    }
    for title, df in plans.items():
        print(f"\n===== {title}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
