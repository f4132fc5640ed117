import hashlib
import math

import pytest
from pyspark.sql import functions as F

from answerscope.operators import sampling as B


def digest(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n,fraction", [(1000, 0.3), (7, 0.5), (100, 0.999), (50, 0.0), (10, 1.0)])
def test_subsample_is_exact(spark, n, fraction):
    got = sorted(r["id"] for r in B.subsample(spark.range(n), fraction, 5).collect())
    keep = n - math.ceil((1.0 - fraction) * n)
    assert got == sorted(sorted(range(n), key=lambda i: digest(5, i))[:keep])


def test_split_sizes_and_classes(spark):
    df = spark.range(7983).select("id", (F.col("id") % 10 < 3).cast("int").alias("label"))
    rows = B.stratified_split(df, "label", 0.2, 42).collect()
    test = [r for r in rows if r["split"] == "test"]
    assert len(rows) == 7983 and len(test) == 1597
    positives = sum(r["label"] for r in rows)
    assert sum(r["label"] for r in test) in (math.floor(positives * 1597 / 7983), math.ceil(positives * 1597 / 7983))
    for label in (0, 1):
        ids = [r["id"] for r in rows if r["label"] == label]
        chosen = [r["id"] for r in test if r["label"] == label]
        assert sorted(chosen) == sorted(sorted(ids, key=lambda i: digest(42, i))[: len(chosen)])


@pytest.mark.parametrize("per_bucket", [100, 1_000_000])
def test_shards(spark, per_bucket):
    df = spark.range(7983).select((F.col("id") * 31 % 7983).alias("id"))
    sizes, seen = [], []
    tagged = B.with_shard_id(df, 4, ["id"], per_bucket).groupBy("shard_id").agg(F.count("id"), F.min("id"), F.max("id")).orderBy("shard_id")
    for r in tagged.collect():
        sizes.append(r[1])
        seen.append((r[2], r[3]))
    assert sizes == [1995, 1995, 1995, 1998]  # the published shard sizes
    assert seen == [(0, 1994), (1995, 3989), (3990, 5984), (5985, 7982)]
    assert B.with_shard_id(spark.range(2), 4, ["id"]).select("shard_id").distinct().collect()[0][0] == 3


def test_resume_keeps_everything_once(spark):
    pending = spark.range(20)
    done = spark.range(5, 30).select("id", F.lit("old").alias("score"))
    out = {r["id"]: r["score"] for r in B.resume_union(pending, done, lambda w: w.withColumn("score", F.lit("new"))).collect()}
    assert out == {i: "old" if i >= 5 else "new" for i in range(20)}


def test_dedup_and_uniqueness(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, B.dedup_first(df, "k", ["v"]).collect())) == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError, match="up to 2"):
        B.assert_unique(df, "k")
    assert B.assert_unique(df.limit(0), "k").count() == 0


def test_merge_batches(spark):
    rows = [(1, b, g, t) for b, gens, steps in ((0, 2, 3), (1, 2, 2), (4, 1, 5)) for g in range(gens) for t in range(steps)]
    df = spark.createDataFrame(rows, "sample_id int, batch_id int, gen_id int, token_pos int")
    for per_bucket in (2, 1000):
        out = B.merge_batches(df, rows_per_bucket=per_bucket).collect()
        assert {(r["batch_id"], r["gen_id"]) for r in out} == {(0, 0), (0, 1), (1, 2), (1, 3), (4, 4)}
        assert len(out) == len(rows)


def test_generations_round_trip_and_features(spark):
    df = spark.createDataFrame([("x", ["c", "a", "b"]), ("y", ["z"])], "id string, generations array<string>")
    back = {r["id"]: r["generations"] for r in B.collect_generations(B.explode_generations(df)).collect()}
    assert back == {"x": ["c", "a", "b"], "y": ["z"]}
    for part_size in (1, 2, 100):
        parts = B.collect_generations(B.explode_generations(df), part_size=part_size)
        assert sorted(map(tuple, B.explode_generations(parts).collect())) == sorted(map(tuple, B.explode_generations(df).collect()))
    f = spark.createDataFrame([(1, [1.0]), (2, []), (3, None)], "id int, layer_scores array<double>")
    assert [r["id"] for r in B.with_features(f).collect()] == [1]
