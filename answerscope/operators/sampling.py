"""Row-set operators: exact seeded samples, shards, splits, resume, deduplication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.functions.arrays import let
from answerscope.operators.groups import ROWS_PER_BUCKET, broadcast_narrow, pinned, positions

PREFIX_DIGITS = 4  # 65,536 histogram cells per group, whatever the number of rows


def seeded_digest(id_col: str, seed: int) -> Column:
    """Hex digest that orders rows pseudo-randomly but reproducibly."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _mark_lowest(df: DataFrame, quota: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Flags, per label, the ``quota`` rows with the smallest digest.

    No label is ever ranked whole: counts per digest prefix show in which prefix the quota
    falls; lower prefixes are taken entirely and only that prefix is ranked. Digests of
    distinct ids are uniform, so the ranked cell holds about n / 65,536 rows.
    """
    tagged = df.withColumn("_d", seeded_digest(id_col, seed)).withColumn("_p", F.substring("_d", 1, PREFIX_DIGITS))
    cells = tagged.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        cells.withColumn("_cum", F.sum("_n").over(upto))
        .join(quota, label)
        .filter((F.col("_cum") >= F.col("_quota")) & (F.col("_cum") - F.col("_n") < F.col("_quota")))
        .select(label, F.col("_p").alias("_cut"), (F.col("_quota") - F.col("_cum") + F.col("_n")).alias("_take"))
    )
    # one cut per label; a label with a quota of 0 has none and takes nothing
    cut = pinned(cut)
    edge = tagged.select(label, id_col, "_d", "_p").join(cut, label).filter(F.col("_p") == F.col("_cut"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_d", id_col))
    last = edge.withColumn("_place", place).filter(F.col("_place") == F.col("_take"))
    last = last.select(label, F.col("_d").alias("_last"))
    return (
        tagged.join(pinned(last), label, "left")
        .withColumn("_taken", F.coalesce(F.col("_d") <= F.col("_last"), F.lit(False)))
        .drop("_d", "_p", "_last")
    )


def subsample(df: DataFrame, fraction: float, seed: int, id_col: str = "id") -> DataFrame:
    """Exact-size seeded random subset: n - ceil((1-fraction)·n) rows; ids must be unique."""
    if fraction >= 1.0:
        return df
    digest = seeded_digest(id_col, seed)
    tagged = df.select(id_col, digest.alias("_d"), F.substring(digest, 1, PREFIX_DIGITS).alias("_p"))
    cells = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()  # at most 65,536
    n = sum(r["n"] for r in cells)
    quota, before = n - math.ceil((1.0 - fraction) * n), 0
    for cell in cells:
        if before + cell["n"] >= quota > before:
            edge = tagged.filter(F.col("_p") == cell["_p"]).orderBy("_d", id_col).limit(quota - before)
            return df.filter(digest <= F.lit(edge.agg(F.max("_d").alias("last")).first()["last"]))
        before += cell["n"]
    return df.limit(0)


def stratified_split(df: DataFrame, label: str, test_size: float, seed: int, id_col: str = "id") -> DataFrame:
    """Adds ``split`` = 'test' / 'train', keeping class proportions.

    ceil(n·test_size) rows are held out overall; each class gets the integer part of its
    share and the rest goes to the largest fractions (ties: smaller label first).
    """
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    share = F.col("_n") * F.col("_test") / F.col("_total")
    quota = (
        per.withColumn("_total", F.sum("_n").over(every))
        .withColumn("_test", F.ceil(F.col("_total") * F.lit(test_size)))
        .withColumn("_share", share)
        .withColumn("_floor", F.floor("_share"))
        .withColumn("_left", F.col("_test") - F.sum("_floor").over(every))
        .withColumn("_rank", F.row_number().over(every.orderBy((F.col("_floor") - F.col("_share")), label)))
        .select(label, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("bigint").alias("_quota"))
    )
    marked = _mark_lowest(df, quota, label, id_col, seed)
    return marked.withColumn("split", F.when(F.col("_taken"), "test").otherwise("train")).drop("_taken")


def row_index(df: DataFrame, order: list[str], **sizes) -> DataFrame:
    """Adds ``row_idx``, 0-based, by ``order`` (which must identify a row)."""
    out = positions(df, [], order, **sizes)
    return out.withColumn("row_idx", F.col("position") - 1).drop("position")


def _literal(df: DataFrame, columns: list[str], row) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in columns])


def _shard_cuts(df: DataFrame, num_shards: int, order: list[str], rows_per_bucket: int) -> list | None:
    """The first row (its order columns) of shards 1 .. S-1; None with fewer rows than shards.

    Only the order columns are numbered and S-1 rows are collected; the records themselves
    are never moved to be sharded.
    """
    n = df.count()
    size = n // num_shards
    if size == 0:
        return None
    index = row_index(df.select(*order), order, rows_per_bucket=rows_per_bucket, size_bound=n)
    first = (F.col("row_idx") % size == 0) & (F.col("row_idx") > 0) & (F.col("row_idx") <= size * (num_shards - 1))
    return index.filter(first).orderBy("row_idx").collect()


def shard(
    df: DataFrame, num_shards: int, shard_id: int, order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rows of one contiguous shard; sizes are n div S and the last shard takes the rest.

    A range filter on the order columns, which reaches the scan when there is one of them.
    """
    cuts = _shard_cuts(df, num_shards, order, rows_per_bucket)
    if cuts is None:
        return df if shard_id == num_shards - 1 else df.limit(0)
    single = len(order) == 1
    here = F.col(order[0]) if single else F.struct(*order)
    at = lambda row: _literal(df, order, row)[order[0]] if single else _literal(df, order, row)
    out = df
    if shard_id > 0:
        out = out.filter(here >= at(cuts[shard_id - 1]))
    if shard_id < num_shards - 1:
        out = out.filter(here < at(cuts[shard_id]))
    return out


def with_shard_id(
    df: DataFrame, num_shards: int, order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Adds ``shard_id`` to every row by comparing it with the shards' first rows."""
    cuts = _shard_cuts(df, num_shards, order, rows_per_bucket)
    if cuts is None:  # fewer rows than shards: everything lands in the last one
        return df.withColumn("shard_id", F.lit(num_shards - 1))
    if not cuts:
        return df.withColumn("shard_id", F.lit(0))
    single = len(order) == 1
    starts = F.array(*[_literal(df, order, row)[order[0]] if single else _literal(df, order, row) for row in cuts])
    here = F.col(order[0]) if single else F.struct(*order)
    return df.withColumn("shard_id", let(here, lambda x: F.size(F.filter(starts, lambda c: c <= x))))


def resume(pending: DataFrame, done: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows still to process, finished records that can be reused)."""
    work = pending.join(done.select(id_col), id_col, "left_anti")
    reuse = done.join(pending.select(id_col), id_col, "left_semi")
    return work, reuse


def resume_union(pending: DataFrame, done: DataFrame, process, id_col: str = "id") -> DataFrame:
    """Finished records plus ``process`` applied to the rest, missing fields as NULL."""
    work, reuse = resume(pending, done, id_col)
    return reuse.unionByName(process(work), allowMissingColumns=True)


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key; pre-aggregated before the shuffle, so a hot key is cheap."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def max_key_count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_count"))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Passes the rows on, failing the job when a key occurs twice."""
    worst = max_key_count(df, key).first()["max_count"]
    if worst is not None and worst > 1:
        raise ValueError(f"{key} occurs up to {worst} times")
    return df


def filter_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_semi")


def few_shot_block(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """One row ``block``: n seeded question-answer rows as ``\\nQ: ...\\nA: ...`` text."""
    digest = seeded_digest(id_col, seed)
    shots = df.select(digest.alias("_d"), id_col, "question", "answer").orderBy("_d", id_col).limit(n)
    line = F.concat(F.lit("\nQ: "), "question", F.lit("\nA: "), "answer")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_d"), F.col(id_col), line.alias("line"))))
    return shots.agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "").alias("block"))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def with_features(df: DataFrame, col: str = "layer_scores") -> DataFrame:
    """Drops rows whose feature array is missing or empty."""
    return df.filter(F.size(F.coalesce(F.col(col), F.array().cast("array<double>"))) > 0)


def zip_by_id(samples: DataFrame, evals: DataFrame, id_col: str = "id") -> DataFrame:
    return samples.join(evals, id_col)


def merge_batches(df: DataFrame, sample: str = "sample_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Replaces (batch_id, gen_id) by one gap-free generation number per sample.

    Token positions stay aligned and short batches are simply absent at late positions.
    Only the distinct (sample, batch, generation) triples are numbered; while they fit they
    are broadcast, so the rows with the vectors are not shuffled.
    """
    triples = df.select(sample, "batch_id", "gen_id").distinct()
    n = triples.count()
    numbered = positions(triples, [sample], ["batch_id", "gen_id"], rows_per_bucket=rows_per_bucket, size_bound=n)
    numbered = numbered.withColumn("merged_id", (F.col("position") - 1).cast("int")).drop("position")
    merged = df.join(broadcast_narrow(numbered, n), [sample, "batch_id", "gen_id"])
    return merged.withColumn("gen_id", F.col("merged_id")).drop("merged_id")


def explode_generations(results: DataFrame, col: str = "generations", id_col: str = "id") -> DataFrame:
    """One row (id, gen_id, text) per generation of a record, or of a part that names its ``first``."""
    place = F.col("_pos") + F.col("first") if "first" in results.columns else F.col("_pos")
    kept = [id_col, "first"] if "first" in results.columns else [id_col]
    rows = results.select(*kept, F.posexplode(col).alias("_pos", "text"))
    return rows.select(id_col, place.cast("int").alias("gen_id"), "text")


def collect_generations(rows: DataFrame, id_col: str = "id", part_size: int = 100_000) -> DataFrame:
    """The inverse of ``explode_generations``: ordered arrays (id, first, generations).

    A row holds the generations ``first``, ``first`` + 1, ...; at most ``part_size`` of them, so
    no array grows without bound. ``explode_generations`` gives the same rows back for any
    ``part_size``.
    """
    first = (F.col("gen_id") - F.col("gen_id") % F.lit(part_size)).cast("bigint").alias("first")
    packed = F.array_sort(F.collect_list(F.struct("gen_id", "text")))
    return rows.groupBy(id_col, first).agg(F.transform(packed, lambda s: s["text"]).alias("generations"))
