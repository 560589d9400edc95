import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from helpers import SF001  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    from nnspark.session import checkpoint_dir, local_session

    s = local_session(4, shuffle_partitions=8, app="nnspark-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def emb(spark):
    return spark.read.parquet(f"{SF001}/embeddings.parquet")


@pytest.fixture(scope="session")
def emb_np(emb):
    pdf = emb.orderBy("vec_id").toPandas()
    import numpy as np

    return pdf.vec_id.to_numpy(), np.stack(pdf.embedding.values).astype(np.float64)
