"""Mixing sources to target weights with the cube method.

Sources in code point order, null last, weigh 5, 2, 1, repeating; together they may take
``share`` of all words. A source's target stops at ``most`` times its size and the excess is
shared anew by weight. A source then takes every document target / size times: the whole
part for sure, the rest as an inclusion probability that the cube method turns into 0 or 1
while the source's totals of words and of documents stay (flight: moves along null vectors
of both totals until no three documents are undecided).

Scale: documents are dealt into blocks of about ``BLOCK`` by a hash, each block flies on its
own and leaves at most two undecided; those are pooled and fly again until one block a source
is left, where the landing drops the document total, then the word total. A hot source is
just more blocks. All draws are fixed functions of ids and the seed, so reruns agree.

Defined cases: null or empty text has size 0; a null source is a source; equal (id, source,
size) rows are taken or left together; a source without words has target 0 and takes nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import SPACE, id_back, id_key, stored
from answerscope.operators.groups import positions

WEIGHTS = (5, 2, 1)
SHARE, MOST, BLOCK, SEED = 1.5, 2.0, 4096, 17
BROADCAST_SOURCES = 100_000  # rows of (name, three numbers): a few MB
EPS = 1e-9


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE)), F.lit(0)).cast("long")


def source_key(source: str = "source"):
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(sk, source_size, units, target) from (sk, source_size, units), one row a source.

    The level at which the weights are met is found by a few sums over the table.
    """
    order = sizes.withColumn("last", (F.col("sk") == "").cast("int"))
    ranked = positions(order, [], ["last", "sk"])
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("position") - 1).cast("int") % len(WEIGHTS) + 1)
    table = stored(ranked.select("sk", "source_size", "units", weight.alias("weight")), "sources")
    whole = table.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    total = share * (whole["s"] or 0)
    level, capped = (total / whole["w"] if whole["w"] else 0.0), -1
    while True:
        above = F.col("weight") * F.lit(level) > F.lit(most) * F.col("source_size")
        now = table.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("s"),
            F.sum(F.when(~above, F.col("weight")).otherwise(0)).alias("w"),
        ).first()
        if now["n"] == capped or not now["w"]:
            break
        capped, level = now["n"], (total - most * (now["s"] or 0)) / now["w"]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.lit(most) * F.col("source_size")))


def _null_vector(size: list[float], count: list[float]) -> list[float]:
    """A vector along which neither total of the given documents changes; one more document
    than constraints that matter, so there is one."""
    if len(size) == 3:
        u = [
            size[1] * count[2] - size[2] * count[1],
            size[2] * count[0] - size[0] * count[2],
            size[0] * count[1] - size[1] * count[0],
        ]
        if any(abs(x) > EPS for x in u):
            return u
        row = size if any(size) else count  # the totals are in proportion: one constraint
        return [row[1], -row[0], 0.0] if row[0] or row[1] else [1.0, 0.0, 0.0]
    if len(size) == 2:
        return [size[1], -size[0]] if size[0] or size[1] else [1.0, 0.0]
    return [1.0]


def fly(prob: list[float], size: list[float], count: list[float], rng, land: bool) -> list[float]:
    """The probabilities after the flight: at most two are strictly between 0 and 1, none after landing."""
    prob = list(prob)
    waiting = [k for k in range(len(prob) - 1, -1, -1) if 0 < prob[k] < 1]
    active: list[int] = []
    least = 1 if land else 3
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < least:
            return prob
        u = _null_vector([size[k] for k in active], [count[k] for k in active])
        up = min((((1 - prob[k]) / x if x > 0 else prob[k] / -x) for k, x in zip(active, u) if x), default=0.0)
        down = min(((prob[k] / x if x > 0 else (1 - prob[k]) / -x) for k, x in zip(active, u) if x), default=0.0)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for k, x in zip(active, u):
            p = prob[k] + step * x
            prob[k] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
            if 0 < prob[k] < 1:
                left.append(k)
        active = left


def _flight(seed: int, level: int, land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "id", "size"], kind="stable")
        name = f"{seed}:{level}:{pdf['sk'].iloc[0]}:{pdf['block'].iloc[0]}"
        rng = np.random.default_rng(zlib.crc32(name.encode()))
        words = (pdf["size"] * pdf["rows"]).astype(float).tolist()
        return pdf.assign(prob=fly(pdf["prob"].tolist(), words, pdf["rows"].astype(float).tolist(), rng, land))

    return run


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(id, sk, size, rows, source_size, target, copies): how often each document is taken.

    One row for equal (id, source, size) rows, ``rows`` of them; ``id`` is the id key and ``sk``
    the source key.
    """
    rows = docs.select(id_key(doc_id).alias("id"), source_key(source).alias("sk"), size_of(text).alias("size"))
    units = stored(rows.groupBy("id", "sk", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    sizes = units.groupBy("sk").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    sources = source_targets(sizes)
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.xxhash64("id", "size", F.lit(seed))
    tagged = units.join(sources, "sk").select(
        "id", "sk", "size", "rows", "source_size", "target", "units", F.floor(times).alias("whole"),
        (times - F.floor(times)).alias("prob"), draw.alias("draw"),
    )
    done: DataFrame | None = None
    level, land = 0, False
    while not land:
        land = (tagged.agg(F.max("units")).first()[0] or 0) <= block
        dealt = tagged.withColumn("block", F.pmod("draw", F.greatest(F.lit(1), F.ceil(F.col("units") / block))).cast("long"))
        flown = stored(dealt.groupBy("sk", "block").applyInPandas(_flight(seed, level, land), dealt.schema), f"flight{level}")
        open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
        settled = flown.filter(~open_)
        done = settled if done is None else done.unionByName(settled)
        if not land:
            left = flown.filter(open_)
            counts = left.groupBy("sk").agg(F.count(F.lit(1)).alias("units"))
            counts = F.broadcast(counts) if counts.count() <= BROADCAST_SOURCES else counts
            again = F.xxhash64("draw", F.lit(level))
            tagged = left.drop("units", "block").join(counts, "sk").withColumn("draw", again)
        level += 1
    copies = (F.col("whole") + F.col("prob")).cast("long")
    return done.select("id", "sk", "size", "rows", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns as they were."""
    taken = mix(docs, doc_id, text, source).filter("copies > 0").select("id", "sk", "size", "copies")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        id_key(doc_id).alias("id"), source_key(source).alias("sk"), size_of(text).alias("size"),
    )
    chosen = rows.join(taken.hint("shuffle_hash"), ["id", "sk", "size"])  # texts need no sort
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken."""
    units = mix(docs)
    return units.select(
        id_back().alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_n"),
    ).drop("_n")
