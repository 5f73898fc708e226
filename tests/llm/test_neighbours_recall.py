"""The index against brute force where it is not exhaustive: vectors with and without structure, and of several lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import neighbours


def recall(spark, x, tmp_path, **options):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = neighbours.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 50 == 0, **options).toPandas()
    y = x.astype(np.float32).astype(float)
    y /= np.sqrt((y**2).sum(1, keepdims=True))
    hits = 0
    for q, found in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -2
        hits += len(set(np.argpartition(-s, 5)[:5]) & set(found.vec_id))
    return hits / (5 * -(-len(x) // 50))


def test_measured_share_follows_the_structure():
    rng = np.random.default_rng(1)

    def share(x):
        x = x / np.sqrt((x**2).sum(1, keepdims=True))
        index = neighbours.MultiIndex(neighbours._kmeans(x[:, :16], 40, rng), neighbours._kmeans(x[:, 16:], 40, rng), np.zeros(1600, np.int64))
        return neighbours.needed_share(index, x, 5, 0.95)

    centres = rng.normal(size=(60, 32)) * 4
    assert share(centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 32))) < 0.1 < share(rng.normal(size=(4000, 32)))


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_where_most_of_the_index_may_be_left_out(spark, tmp_path, clustered, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)  # cells larger than a block
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 32))
    if clustered:
        x += (rng.normal(size=(30, 32)) * 4)[rng.integers(0, 30, 9000)]
    assert recall(spark, x, tmp_path) >= 0.9


def test_each_length_has_its_own_neighbours(spark):
    rows = [(k, [float(k + 1), 1.0]) for k in range(60)] + [(100 + k, [float(k + 1), 1.0, 2.0]) for k in range(7)] + [(150, [1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    near = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100, 150)}
    assert near[0] == [1, 2, 3, 4, 5] and near[100] == [101, 102, 103, 104, 105] and len(near[50]) == 5 and near[150] == []
