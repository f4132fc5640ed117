"""Keeping groups bounded: size checks, running totals and pair tiles.

Three devices the other operators share so that one sample, label or score holding a
third of all rows never ends up whole in one task:

* ``oversized_groups``  finds the groups that may not be collected,
* ``running_totals``    prefix sums without a window over a whole large group,
* ``pair_tiles``        cuts a group's n x n comparison into bounded blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.session import checkpointed, stored

GROUP_LIMIT = 1024
ROWS_PER_BUCKET = 1_000_000
BROADCAST_ROWS = 100_000
NARROW_BROADCAST_ROWS = 2_000_000  # a few integers per row: well below 100 MB


def pinned(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluates a table that is expected to be small, once.

    Up to ``max_rows`` rows become a local relation marked for broadcast, so later plans
    neither recompute nor shuffle it. A larger table goes to the shared checkpoint folder
    and is joined like any other. Rows hold a few numbers or short strings each; a table with
    wide columns needs a smaller ``max_rows``.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return checkpointed(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_narrow(df: DataFrame, rows: int) -> DataFrame:
    """Marks a table of a few integers per row for broadcast when ``rows``, an upper bound
    of its counted size, allows it; otherwise the join shuffles both sides."""
    return F.broadcast(df) if rows <= NARROW_BROADCAST_ROWS else df


def oversized_groups(df: DataFrame, keys: list[str], limit: int = GROUP_LIMIT) -> DataFrame | None:
    """Keys of groups with more than ``limit`` rows and their size, None when there are none.

    One job over the key columns only, pre-aggregated before the shuffle.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    big = pinned(sizes.filter(F.col("group_rows") > limit))
    return None if big.isEmpty() else big


def split_by_size(
    df: DataFrame, keys: list[str], limit: int = GROUP_LIMIT, probe: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups within the limit, rows of larger groups + ``group_rows`` or None).

    ``probe`` is a cheaper table with at least as many rows per group to measure instead.
    """
    big = oversized_groups(df if probe is None else probe, keys, limit)
    if big is None:
        return df, None
    return df.join(big, keys, "left_anti"), df.join(big, keys)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    size_bound: int | None = None,
    probe: DataFrame | None = None,
    cut_lineage: bool = False,
    steer: Column | None = None,
) -> DataFrame:
    """Inclusive prefix sums of ``values`` by ascending ``order`` within ``keys``.

    Adds ``cum_<value>`` columns. ``order`` must be unique within a group (aggregate
    equal values first) and may have any orderable type, structs included.

    A window is enough while every group has at most ``rows_per_bucket`` rows. That is
    known from ``size_bound`` (an upper bound of the total) or measured on ``probe``, a
    cheaper table with at least as many rows per group. Otherwise the rows are range-partitioned
    by (keys, order) into pieces of about ``rows_per_bucket`` and written to the shared folder
    with the piece's number, so the pieces cannot move afterwards; sums run inside each piece in
    parallel, and what a group has in earlier pieces is added from one row for each group and
    piece. ``steer`` is a short stand-in for a long ``order`` (monotone in it, such as a
    text's first characters) by which the ranges are drawn instead.
    """
    if size_bound is not None and size_bound <= rows_per_bucket:
        return _windowed(df, keys, order, values)
    sizes = (df if probe is None else probe).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("whole")).first()
    if (most["most"] or 0) <= rows_per_bucket:
        return _windowed(df, keys, order, values)
    own = df.columns
    pieces = -(-most["whole"] // rows_per_bucket)
    ranged = df.repartitionByRange(pieces, *keys, F.col(order) if steer is None else steer)
    cut = stored(ranged.withColumn("_piece", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*keys, "_piece").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_piece", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    summed = _windowed(cut, [*keys, "_piece"], order, values).join(pinned(offsets), [*keys, "_piece"])
    return summed.select(*own, *[(F.col(f"cum_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values])


def _windowed(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(v).over(w).alias(f"cum_{v}") for v in values])


def positions(df: DataFrame, keys: list[str], order: list[str], **sizes) -> DataFrame:
    """Adds ``position`` (1-based) by ``order`` within ``keys``; ``order`` must be unique.

    ``sizes`` are the size arguments of ``running_totals``.
    """
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    tagged = df.select("*", by.alias("_order"), F.lit(1).cast("bigint").alias("_one"))
    out = running_totals(tagged, keys, "_order", ["_one"], **sizes)
    return out.withColumnRenamed("cum__one", "position").drop("_order", "_one")


def hash_block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def pair_tiles(
    df: DataFrame, keys: list[str], item: Column, spread: Column, limit: int = GROUP_LIMIT, probe: DataFrame | None = None
) -> DataFrame:
    """Blocks (``left_items``, ``right_items``) that together cover every pair of a group.

    A group of at most ``limit`` rows is one tile ``(lo=0, hi=0)`` whose two sides are the
    same list. A larger group is dealt into ceil(n/limit) hash blocks of ``spread`` (unique
    per row) and each pair of blocks becomes one tile, so tasks hold bounded lists and the
    pairs themselves are only formed inside the consumer of a tile.
    """
    rows = df.select(*keys, item.alias("_item"), spread.alias("_spread"))
    small, big = split_by_size(rows, keys, limit, probe)
    whole = small.groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias("left_items"))
    tiles = whole.select(
        *keys,
        F.lit(0).alias("lo"),
        F.lit(0).alias("hi"),
        "left_items",
        F.col("left_items").alias("right_items"),
    )
    if big is None:
        return tiles
    blocks = F.ceil(F.col("group_rows") / F.lit(limit)).cast("int")
    dealt = big.select(*keys, "_item", blocks.alias("_nb"), hash_block(F.col("_spread"), blocks).alias("_b"))
    copies = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_o")).select(
        *keys, "_item", "_b", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi")
    )
    pick = lambda side: F.array_sort(F.collect_list(F.when(F.col("_b") == F.col(side), F.col("_item"))))
    cut = copies.groupBy(*keys, "lo", "hi").agg(pick("lo").alias("left_items"), pick("hi").alias("right_items"))
    return tiles.unionByName(cut)
