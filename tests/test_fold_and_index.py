"""Aggregates of the user's own, and the index of vectors against the exact answer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanyalah.operators import fold as folding
from tanyalah.operators import vector_index
from tanyalah.operators.fold import Fold, fold_groups, partial_states
from tanyalah.operators.similarity import top_k_similar


def middle():
    """A trimmed mean: the state is a histogram, which no built-in aggregate keeps."""

    def update(state, rows):
        values, counts = np.unique(rows.column("x").drop_null().to_numpy(), return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist()):
            state[v] = state.get(v, 0) + c
        return state

    def merge(a, b):
        for v, c in b.items():
            a[v] = a.get(v, 0) + c
        return a

    def finish(state):
        rows = [v for v in sorted(state) for _ in range(state[v])]
        cut = len(rows) // 10
        kept = rows[cut : len(rows) - cut]
        return sum(kept) / len(kept) if kept else None

    return Fold(dict, update, merge, finish)


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds nine tenths of the rows; some keys and values are missing."""
    number = F.col("id")
    key = F.when(number % 10 > 0, "hot").when(number % 100 == 0, None).otherwise(F.concat(F.lit("k"), number % 70))
    value = F.when(number % 13 > 0, (number * 7919) % 50)
    return spark.range(0, 40_000, 1, 25).select(key.alias("key"), (number % 2).alias("side"), value.alias("x"))


def expected(hot, keys):
    groups = {}
    for row in hot.collect():
        key = tuple(row[k] for k in keys)
        if None not in key:
            groups.setdefault(key, []).append(row["x"])
    out = {}
    for key, values in groups.items():
        rows = sorted(v for v in values if v is not None)
        cut = len(rows) // 10
        out[key] = sum(rows[cut : len(rows) - cut]) / len(rows[cut : len(rows) - cut])
    return out


@pytest.mark.parametrize("keys", [["key"], ["key", "side"]])
def test_fold_equals_plain_python(spark, hot, keys):
    got = fold_groups(hot, keys, middle(), ["x"], "double", "mean")
    assert got.columns == [*keys, "mean"]
    assert {tuple(r)[:-1]: r["mean"] for r in got.collect()} == pytest.approx(expected(hot, keys))


def test_no_merge_sees_more_than_a_few_states(spark, hot, monkeypatch):
    states = partial_states(hot, ["key"], middle(), ["x"])
    assert states.filter("key = 'hot'").count() <= 25
    monkeypatch.setattr(folding, "HELD", 2)
    sizes = Fold(lambda: (1, 1), lambda s, _: s, lambda a, b: (a[0] + 1, max(a[1], b[1], a[0] + 1)), lambda s: s[1])
    most = fold_groups(hot, "key", sizes, [], "int").filter("key = 'hot'").first()["value"]
    assert most <= 2 * math.isqrt(25) + 1


def test_fold_of_nothing(spark, hot):
    assert fold_groups(hot.filter("id < 0" if "id" in hot.columns else "false"), "key", middle(), ["x"], "double").count() == 0


def vectors(spark, rows, dims=16, groups=30, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    data = [(k, (centres[k % groups] + 0.4 * r.normal(size=dims)).tolist()) for k in range(rows)]
    data += [(rows + 1, None), (rows + 2, [0.0] * dims)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_recall_of_the_index(spark, sf_dir):
    for frame in (vectors(spark, 3000), spark.read.parquet(f"{sf_dir}/embeddings.parquet")):
        asked = frame.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
        exact = top_k_similar(asked, frame, 5)
        index = vector_index.build_index(frame)
        assert sum(index.sizes.values()) == frame.where("embedding is not null").count()
        assert vector_index.recall_of(vector_index.top_k_indexed(asked, index, 5), exact) >= 0.9
        every = vector_index.top_k_indexed(asked, index, 5, probes=10**6)
        assert sorted(map(str, every.collect())) == sorted(map(str, exact.collect()))


def test_clustered_vectors_need_few_lists_and_hot_lists_many_blocks(spark):
    frame = vectors(spark, 3000)
    index = vector_index.build_index(frame, lists=30)
    assert index.probes(0.95) < 10
    asked = frame.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    small = vector_index.top_k_indexed(asked, index, 5, block_bytes=8 * 16 * 20)
    assert sorted(map(str, small.collect())) == sorted(map(str, vector_index.top_k_indexed(asked, index, 5).collect()))


def test_index_of_nothing(spark):
    frame = vectors(spark, 3000).where("vec_id < 0")
    index = vector_index.build_index(frame)
    asked = vectors(spark, 40).where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert index.sizes == {}
    assert vector_index.top_k_indexed(asked.limit(0), index, 5).count() == 0
