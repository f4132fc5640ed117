"""Ranked lexical search by NRA: sorted reads with score intervals, no random access.

Terms are runs of letters and digits (A-Z lower-cased, every code point beyond ASCII counts as a
letter). A posting's impact, a term's weight times its saturated frequency, is fixed once the
corpus counts N, L and df are known, so each term has a list of postings in order of impact.

Method: documents are dealt into shards, each of which holds its own impact-sorted lists. For
every query the lists of its terms are read from the top, a block of each at a time. A document's
lower bound sums the impacts read for it; its upper bound adds, for each list it was not met in,
the impact at which reading stopped. A document leaves when its upper bound is below the k-th best
lower bound (equal ones stay, ids settle ties). Reading goes on until the intervals of all
documents left have closed (a list in which all of them were met is read no further). The threshold of a query goes on from shard to shard of a
task, and the best k of all tasks are merged, which is exact: scores depend on corpus counts alone.

Scale: texts are read once; stored are the frequencies of query terms only, a document a row.
Queries are taken in blocks of about ``BLOCK_CHARS`` characters of distinct text, which bounds the
vocabulary that tasks receive; df comes back for these terms only. A task sends k rows a query.

Defined cases: null or empty texts have no terms and are found by no query; a query without a
term in any document finds nothing; queries of equal text are ranked once; null ids come after
all others on ties, repeated rows are ranked side by side; no documents, no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerscope.llm.common import id_back, id_key, plain_text, segments, slices, stored

#: The ranking formula's constants.
WEIGHT_SCALE, TF_SCALE, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 20, 50
TOP = 50
BLOCK_CHARS = 16_000_000  # of query text at a time
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
FIRST_READ = 64  # postings read from each list in the first round; doubles each round

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str):
    """The terms of a text in order, in lists of bounded length."""
    for part in segments(text.encode().translate(_TERM)):
        yield part.split()


def _counted(vocabulary):
    """Term frequencies of the query terms, and the number of all terms."""

    def run(batches):
        get = vocabulary.value.get
        for batch in slices(batches, "text"):
            n, of, tf, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                total, found = 0, []
                for part in terms(text):
                    total += len(part)
                    ids = np.fromiter((get(t, -1) for t in part), np.int32, len(part))
                    found.append(ids[ids >= 0])
                own, times = np.unique(np.concatenate(found), return_counts=True)
                n.append(total)
                of.append(own)
                tf.append(times)
                ends.append(ends[-1] + len(own))
            join = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"), "n": pa.array(n, pa.int64()),
                    "terms": pa.ListArray.from_arrays(ends, join(of)), "tfs": pa.ListArray.from_arrays(ends, join(tf)),
                }
            )

    return run


def _held(size: int):
    """How many documents of the partition hold each term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": met, "df": total[met]})

    return run


def weights(df: np.ndarray, total: int) -> np.ndarray:
    return np.floor(WEIGHT_SCALE * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)


def length_norm(n: np.ndarray, total: int, length: int) -> np.ndarray:
    """100 - 50 + ((50 n N) div L), exact beyond 64 bits too."""
    if len(n) and int(n.max()) * LENGTH_SHARE * total >= 1 << 63:
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * total // length for x in n], np.int64)
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * total // max(length, 1)


class Shard:
    """Impact-sorted lists over some documents."""

    def __init__(self, ids, n, docs, term, tf, weight, total: int, length: int):
        """``docs``, ``term`` and ``tf``: one entry a posting; ids ascending."""
        self.ids = ids
        norm = length_norm(n, total, length)[docs]
        impact = weight[term] * (TF_SCALE * tf // (1000 * tf + SATURATION * norm))
        order = np.lexsort((docs, -impact, term))
        self.docs, self.impact = docs[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def best(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read): every document whose score is among the k best and
        at least ``floor``, ties included."""
        at, end = self.start[query], self.start[query + 1]
        some = (at < end) & (self.impact[np.minimum(at, len(self.impact) - 1)] > 0) if len(self.impact) else at < end
        at, end = at[some].copy(), end[some]
        lower = np.zeros(len(self.ids), np.int64)
        met = np.zeros((len(at), len(self.ids)), bool)
        left = np.arange(len(self.ids))
        first, step = at.copy(), FIRST_READ
        while True:
            for t in np.flatnonzero(~met[:, left].all(axis=1)):  # sequential reads, a block of each list that can still say something
                upto = min(at[t] + step, end[t])
                docs = self.docs[at[t] : upto]
                lower[docs] += self.impact[at[t] : upto]
                met[t, docs] = True
                at[t] = upto
            step *= 2
            bound = np.where(at < end, self.impact[np.minimum(at, len(self.impact) - 1)], 0) if len(at) else at
            open_ = np.flatnonzero(bound)
            upper = lower[left] + (bound[open_][:, None] * ~met[np.ix_(open_, left)]).sum(axis=0, dtype=np.int64)
            if len(left) > k:
                floor = max(floor, int(np.partition(lower[left], -k)[-k]))
            going = upper >= max(floor, 1)
            left, upper = left[going], upper[going]
            if np.array_equal(upper, lower[left]):
                # closed intervals; the last threshold may still be beaten by fewer than k
                return left, lower[left], int((at - first).sum())


def _ranked(index, k: int, total: int, length: int):
    """The best k of the partition's documents for each query: (query, id, score)."""

    def run(batches):
        queries, weight = index.value
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)  # ids and scores so far

        def search(parts) -> None:
            ids, n, sizes, term, tf = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            docs = np.repeat(place, sizes)
            shard = Shard(ids[order], n[order], docs, term, tf.astype(np.int64), weight, total, length)
            for q, query in enumerate(queries):
                old_ids, old = held[q]
                floor = int(old.min()) if len(old) >= k else 1
                docs, scores, _ = shard.best(query, k, floor)
                both_ids, both = np.concatenate((old_ids, shard.ids[docs])), np.concatenate((old, scores))
                top = np.lexsort((both_ids, -both))[:k]
                held[q] = both_ids[top], both[top]

        parts, docs, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                parts.append((part.column("id").to_numpy(), part.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), part.column("tfs").flatten().to_numpy()))
                docs, postings = docs + part.num_rows, postings + int(sizes.sum())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    search(parts)
                    parts, docs, postings = [], 0, 0
        if docs:
            search(parts)
        for q, (ids, scores) in enumerate(held):
            yield pa.RecordBatch.from_pydict({"query": np.full(len(ids), q, np.int32), "id": ids, "score": scores})

    return run


def _search_block(docs: DataFrame, texts: list, k: int) -> DataFrame:
    """(q1, q2, rank, id, score) for the queries ``texts``: rows of (q1, q2, text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary: dict[bytes, int] = {}
    queries = []
    for row in texts:
        own = {vocabulary.setdefault(t, len(vocabulary)) for part in terms(row["text"]) for t in part}
        queries.append(np.array(sorted(own), np.int64))
    table = stored(docs.mapInArrow(_counted(sc.broadcast(vocabulary)), "id long, n long, terms array<int>, tfs array<int>"), "postings")
    whole = table.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    counts = table.mapInArrow(_held(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    index = sc.broadcast((queries, weights(df, whole["N"])))
    best = table.filter("size(terms) > 0").mapInArrow(_ranked(index, k, whole["N"], whole["L"]), "query int, id long, score long")
    names = spark.createDataFrame([(i, r["q1"], r["q2"]) for i, r in enumerate(texts)], "query int, q1 long, q2 long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(names, "query").drop("query")


def search(
    docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text",
    query_id: str = "item_id", query_text: str = "text", k: int = TOP, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each row of ``queries``."""
    rows = docs.select(id_key(doc_id).alias("id"), plain_text(text).alias("text"))
    key = [F.xxhash64(plain_text(query_text)).alias("q1"), F.xxhash64(plain_text(query_text), F.lit(1)).alias("q2")]
    asked = stored(queries.select(F.col(query_id).alias("item_id"), *key, plain_text(query_text).alias("text")), "queries")
    distinct = asked.groupBy("q1", "q2").agg(F.first("text").alias("text"))
    blocks = 1 + (distinct.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    found = []
    for block in range(blocks):
        texts = distinct.filter(F.pmod("q2", F.lit(blocks)) == block).collect()  # a block's text at most
        if texts:
            found.append(_search_block(rows, texts, k))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = reduce(DataFrame.unionByName, found)
    return asked.drop("text").join(best, ["q1", "q2"]).select("item_id", "rank", id_back().alias("doc_id"), "score")
