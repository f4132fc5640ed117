from pyspark.sql import functions as F

from answerscope.operators import groups as G


def totals(df, **kw):
    out = G.running_totals(df, ["g"], "x", ["v"], **kw)
    return sorted((r["g"], r["x"], r["v"], r["cum_v"]) for r in out.collect())


def test_bucketed_totals_equal_window(spark):
    # one group holds most rows, another a single one
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("g"),
        ((F.col("id") * 7919) % 5003).alias("x"),
        (F.col("id") % 13).alias("v"),
    )
    whole = totals(df)
    assert totals(df, rows_per_bucket=100) == whole
    assert totals(df, rows_per_bucket=10, cut_lineage=True) == whole  # several runs of boundaries


def test_bucketed_totals_without_keys_and_struct_order(spark):
    df = spark.range(1000).select(F.struct((F.col("id") % 10).alias("a"), F.col("id").alias("b")).alias("o"), F.lit(1).alias("v"))
    out = G.running_totals(df, [], "o", ["v"], rows_per_bucket=50)
    assert out.columns == ["o", "v", "cum_v"]
    rows = sorted((r["o"]["a"], r["o"]["b"], r["cum_v"]) for r in out.collect())
    assert [r[2] for r in rows] == list(range(1, 1001))


def test_positions(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    for per_bucket in (20, 10_000):
        out = G.positions(df, ["g"], ["x"], rows_per_bucket=per_bucket).collect()
        assert all(r["position"] == r["x"] // 2 + 1 for r in out)


def test_tiles_cover_every_pair_once(spark):
    df = spark.range(230).select(
        F.when(F.col("id") < 200, F.lit("hot")).otherwise((F.col("id") % 3).cast("string")).alias("g"), "id"
    )
    for limit in (8, 1000):
        tiles = G.pair_tiles(df, ["g"], F.col("id"), F.col("id"), limit).collect()
        seen = {}
        for t in tiles:
            a, b = t["left_items"], t["right_items"]
            pairs = (
                [(x, y) for i, x in enumerate(a) for y in b[i + 1 :]] if t["lo"] == t["hi"] else [(x, y) for x in a for y in b]
            )
            for x, y in pairs:
                key = (t["g"], min(x, y), max(x, y))
                seen[key] = seen.get(key, 0) + 1
            if limit == 8 and t["g"] == "hot":
                assert len(a) <= 40 and len(b) <= 40
        expected = 200 * 199 // 2 + 3 * (10 * 9 // 2)
        assert len(seen) == expected and set(seen.values()) == {1}


def test_pinned_falls_back_to_checkpoint(spark):
    df = spark.range(50)
    assert sorted(r["id"] for r in G.pinned(df, max_rows=10).collect()) == list(range(50))
    assert G.oversized_groups(df.withColumn("g", F.lit(1)), ["g"], 100) is None
    assert G.oversized_groups(df.withColumn("g", F.lit(1)), ["g"], 10).collect()[0]["group_rows"] == 50
