import numpy as np
import pytest

from quillspark.operators import vectors as V


def frame(spark, x):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"key": np.arange(len(x)), "embedding": x.astype(float).tolist()}), "key bigint, embedding array<double>")


def pairs(df):
    return {(r["query_id"], r["key"]) for r in df.collect()}


def test_inverted_file_at_100000_vectors(spark):
    """Neighbourhoods of about 50 vectors: recall of at least 0.9, while at most 5 % of the vectors are read."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2000, 64))
    v = frame(spark, base[rng.integers(0, 2000, 100_000)] + 0.4 * rng.standard_normal((100_000, 64))).repartition(8).cache()
    q = v.where("key % 1000 = 0").withColumnRenamed("key", "query_id")
    lists = V.inverted_lists(v)
    exact, found = pairs(V.vector_topk(q, v, 12)), pairs(V.ivf_topk(q, lists, 12))
    assert len(exact & found) >= 0.9 * len(exact)
    more, _ = V.probed_lists(q, lists, 12)
    size = {r["list"]: r["count"] for r in lists.vectors.groupBy("list").count().collect()}
    near = np.argsort(-(V._array(q.toPandas()["embedding"]) @ lists.centres.T), axis=1)[:, :8]
    read = sum(size.get(r["list"], 0) for r in more.collect()) + sum(size.get(int(i), 0) for row in near for i in row)
    assert read <= 0.05 * 100 * 100_000
    v.unpersist()


@pytest.mark.parametrize("block", [16_384, 50])
def test_full_reach_is_exact(spark, monkeypatch, block):
    """Random vectors, equal ones, zero ones, several slots a list, more asked for than there are."""
    monkeypatch.setattr(V, "VECTOR_BLOCK", block)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((400, 8)), np.tile(rng.standard_normal(8), (200, 1)), np.zeros((3, 8))])
    v = frame(spark, x)
    q = v.where("key % 50 = 0").withColumnRenamed("key", "query_id")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["key"], r["distance"]) for r in df.collect())
    lists = V.inverted_lists(v)
    assert rows(V.ivf_topk(q, lists, 7, first=2, reach=1.0)) == rows(V.vector_topk(q, v, 7))
    few = v.where("key < 5")
    assert rows(V.ivf_topk(q, V.inverted_lists(few), 12, reach=1.0)) == rows(V.vector_topk(q, few, 12))
    assert V.ivf_topk(q, V.inverted_lists(v.where("false")), 3).collect() == []
