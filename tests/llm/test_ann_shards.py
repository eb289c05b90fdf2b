"""op10 over several shards and rounds of queries, and where no plan reaches the recall."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ravelin.llm import ann


def vectors(spark, n, width, seed=9):
    x = np.random.default_rng(seed).normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)})).repartition(4)


def neighbours(x, got, k, by):
    """Share of the true neighbours that were found; every score is checked."""
    own = {}
    for g in got:
        own.setdefault(g.query_id, []).append(g)
    assert set(own) == set(range(0, len(x), by))
    caught = 0
    for q, rows in own.items():
        rows.sort(key=lambda g: g["rank"])
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        assert [g["rank"] for g in rows] == list(range(1, k + 1)) and all(g.score == scores[g.vec_id] for g in rows)
        caught += len({g.vec_id for g in rows} & set(np.lexsort((np.arange(len(x)), -scores))[:k].tolist()))
    return caught / k / len(own)


def test_several_shards_and_rounds(spark, monkeypatch):
    x, frame = vectors(spark, 50_000, 24)
    monkeypatch.setattr(ann, "QUERY_BYTES", 40 * 24 * 8)
    assert ann.n_shards(len(x)) >= 3
    assert neighbours(x, ann.nearest(frame, F.col("vec_id") % 500 == 0, 20).collect(), 20, 500) >= 0.9


def test_scans_where_no_plan_reaches_the_recall(spark, monkeypatch):
    x, frame = vectors(spark, 2_000, 16)
    monkeypatch.setattr(ann, "RECALL", 1.1)
    monkeypatch.setattr(ann, "MEASURED", 16)  # several scans
    assert neighbours(x, ann.nearest(frame, F.col("vec_id") % 50 == 0, 10).collect(), 10, 50) == 1.0
