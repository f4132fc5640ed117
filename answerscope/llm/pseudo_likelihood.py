"""Language-model scores: masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from the ``WINDOW`` tokens before and after it, never from itself; a
document's score is the sum of the conditional log-probabilities of its tokens.

Tokens are lower-cased runs without white space. Counting them over all documents gives the
vocabulary (the most frequent ones) and, for all others, buckets by their last letters with
the number of distinct tokens in each: a token outside the vocabulary has its bucket's
probability over that number. The network adds position-wise embeddings, applies tanh and
predicts in two softmax steps, a group of slots and a slot in the group. It is trained in
numpy inside Spark tasks: each task takes one pass of mini-batch gradient steps over all
windows of its partition from a common start, and the models, weighted by their tokens, are
averaged in Spark by stretches of parameters and in a tree of ``FAN`` branches, so no task holds
many models and nothing but one reaches the driver.

Defined cases: null or empty text has no token, score 0 and a null mean; repeated rows get equal
scores (and weigh in training as often as they come); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import plain_text, stored

WINDOW, HIDDEN = 2, 16
GROUPS, IN_GROUP = 32, 32
SLOTS = GROUPS * IN_GROUP
BUCKETS = 256  # slots for tokens outside the vocabulary
BATCH, RATE = 8192, 0.1
STRETCH = 1 << 12  # parameters averaged by one group
FAN = 256  # models averaged by one group
CACHED = 100_000


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def bucket_of(token: str) -> int:
    return zlib.crc32(token[-3:].encode()) % BUCKETS


def _counted(batches):
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column("text").to_pylist():
            seen.update(tokens_of(text))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _bucketed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket_of(t) for t in batch.column("token").to_pylist()], pa.int32()), "n": batch.column("n")})


class _Endings(dict):
    """Last letters of a token -> bucket; there are few, and their number is bounded all the same."""

    def __missing__(self, ending: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        bucket = self[ending] = bucket_of(ending)
        return bucket


class Vocabulary:
    """Token -> slot; tokens that are no words of the vocabulary fall in the slot of their bucket."""

    def __init__(self, words: list[str]):
        self.words = {w: BUCKETS + k for k, w in enumerate(words)}
        self.endings = _Endings()

    def slots(self, text: str) -> list[int]:
        known, endings = self.words.get, self.endings
        return [endings[t[-3:]] if (slot := known(t)) is None else slot for t in tokens_of(text)]


def count_tokens(docs: DataFrame, text: str = "text") -> tuple[list[str], list[int]]:
    """The vocabulary and the number of distinct other tokens in each bucket, over all documents."""
    rows = docs.select(plain_text(text).alias("text"))
    counts = stored(rows.mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    words = [r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(SLOTS - BUCKETS).collect()]
    floor = counts.orderBy(F.desc("n"), "token").limit(SLOTS - BUCKETS).agg(F.min("n").alias("n")).first()["n"]
    others = counts.filter(F.col("n") <= (floor or 0)).filter(~F.col("token").isin(words)) if words else counts
    sizes = others.mapInArrow(_bucketed, "bucket int, n long").groupBy("bucket").agg(F.count(F.lit(1)).alias("distinct"))
    distinct = [1] * BUCKETS
    for r in sizes.collect():
        distinct[r["bucket"]] = r["distinct"]
    return words, distinct


class Network:
    """Parameters as one float32 vector with named views."""

    SHAPES = {
        "embed": (2 * WINDOW * (SLOTS + 1), HIDDEN), "bias": (HIDDEN,),
        "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,),
        "slot": (GROUPS, HIDDEN, IN_GROUP), "slot_bias": (GROUPS, IN_GROUP),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, self.SIZE).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def windows(slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of the embedding table for each token's neighbours; slot ``SLOTS`` beyond the text's ends.

        ``starts``: where each document begins in ``slots``.
        """
        n = len(slots)
        doc = np.zeros(n, np.int64)
        doc[starts[starts < n]] = 1
        doc = np.cumsum(doc)
        out = np.full((n, 2 * WINDOW), SLOTS, np.int64)
        for column, shift in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
            here = slice(max(0, -shift), n - max(0, shift))
            there = slice(max(0, shift), n - max(0, -shift))
            same = doc[here] == doc[there]
            out[here, column] = np.where(same, slots[there], SLOTS)
        return out + np.arange(2 * WINDOW) * (SLOTS + 1)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        return np.tanh(self.embed[near].sum(axis=1) + self.bias)

    def _by_group(self, target: np.ndarray):
        """Token numbers of each group of slots that occurs."""
        group = (target // IN_GROUP).astype(np.uint8)  # short integers are sorted in linear time
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(GROUPS + 1))
        return [(g, order[cut[g] : cut[g + 1]]) for g in range(GROUPS) if cut[g] < cut[g + 1]]

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def log_probs(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.hidden(near)
        rows = np.arange(len(target))
        out = np.log(self._softmax(h @ self.group + self.group_bias)[rows, target // IN_GROUP])
        for g, own in self._by_group(target):
            p = self._softmax(h[own] @ self.slot[g] + self.slot_bias[g])
            out[own] += np.log(p[np.arange(len(own)), target[own] % IN_GROUP])
        return out

    def gradient(self, near: np.ndarray, target: np.ndarray) -> Network:
        """Of the mean negative log-probability."""
        n = len(target)
        out = Network(np.zeros(self.SIZE, np.float32))
        h = self.hidden(near)
        d = self._softmax(h @ self.group + self.group_bias)
        d[np.arange(n), target // IN_GROUP] -= 1
        d /= n
        out.group[...], out.group_bias[...] = h.T @ d, d.sum(axis=0)
        dh = d @ self.group.T
        for g, own in self._by_group(target):
            d = self._softmax(h[own] @ self.slot[g] + self.slot_bias[g])
            d[np.arange(len(own)), target[own] % IN_GROUP] -= 1
            d /= n
            out.slot[g], out.slot_bias[g] = h[own].T @ d, d.sum(axis=0)
            dh[own] += d @ self.slot[g].T
        dh *= 1 - h * h
        out.bias[...] = dh.sum(axis=0)
        order = np.argsort(near.astype(np.uint16), axis=None, kind="stable")
        row = near.ravel()[order]
        cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out.embed[row[cut]] = np.add.reduceat(dh[order // near.shape[1]], cut, axis=0)
        return out


def _documents(batches, vocabulary: Vocabulary, ids: bool = False):
    """Batches of whole documents as (ids, slots, sizes), of about ``BATCH`` tokens and more."""
    keys, slots, sizes = [], [], []
    for batch in batches:
        names = batch.column("doc_id").to_pylist() if ids else [None] * batch.num_rows
        for name, text in zip(names, batch.column("text").to_pylist()):
            own = vocabulary.slots(text)
            keys.append(name)
            slots += own
            sizes.append(len(own))
            if len(slots) >= 8 * BATCH or len(sizes) >= 8 * BATCH:
                yield keys, np.array(slots, np.int64), np.array(sizes, np.int64)
                keys, slots, sizes = [], [], []
    if keys:
        yield keys, np.array(slots, np.int64), np.array(sizes, np.int64)


def _trained(model):
    def run(batches):
        words, flat = model.value
        net, squares, seen = Network(flat.copy()), np.full(Network.SIZE, 1e-6, np.float32), 0
        for _, slots, sizes in _documents(batches, Vocabulary(words)):
            near = Network.windows(slots, np.cumsum(sizes) - sizes)
            for at in range(0, len(slots), BATCH):
                g = net.gradient(near[at : at + BATCH], slots[at : at + BATCH]).flat
                squares += g * g
                net.flat -= RATE * g / np.sqrt(squares)
            seen += len(slots)
        if seen:
            cuts = range(0, Network.SIZE, STRETCH)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"stretch": pa.array(list(cuts), pa.int32()), "part": pa.array([part] * len(cuts), pa.int64()), "seen": pa.array([seen] * len(cuts), pa.int64()), "values": pa.array([net.flat[c : c + STRETCH] for c in cuts], pa.list_(pa.float32()))}
            )

    return run


MODELS = "stretch int, part long, seen long, values array<float>"


def _averaged(table: pa.Table) -> pa.Table:
    """The mean of some models' stretch, weighted by tokens, with the number of their group."""
    table = table.sort_by("part")
    seen = table.column("seen").to_numpy()
    total = sum(float(n) * np.asarray(v.as_py(), np.float64) for n, v in zip(seen, table.column("values")))
    mean = (total / seen.sum()).astype(np.float32)
    return pa.table(
        {
            "stretch": table.column("stretch")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()),
            "seen": pa.array([int(seen.sum())], pa.int64()), "values": pa.array([mean], pa.list_(pa.float32())),
        }
    )


def train(docs: DataFrame, words: list[str], text: str = "text", rounds: int = 1) -> np.ndarray:
    """The network's parameters after ``rounds`` passes over all windows of all documents."""
    rows = docs.select(plain_text(text).alias("text"))
    flat = Network().flat
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((words, flat))  # of fixed size
        models = rows.mapInArrow(_trained(sent), MODELS)
        for _ in range(2):  # a task averages FAN models at most, whatever the number of partitions
            models = models.groupBy("stretch", F.floor(F.col("part") / FAN)).applyInArrow(_averaged, MODELS)
        mean = models.groupBy("stretch").applyInArrow(_averaged, MODELS).toArrow().sort_by("stretch")
        if mean.num_rows:
            flat = np.concatenate([np.asarray(v.as_py(), np.float32) for v in mean.column("values")])
    return flat


def _scored(model):
    def run(batches):
        words, distinct, flat = model.value
        net, spread = Network(flat), np.zeros(SLOTS)
        spread[:BUCKETS] = np.log(distinct)
        for keys, slots, sizes in _documents(batches, Vocabulary(words), ids=True):
            starts = np.cumsum(sizes) - sizes
            near, logs = Network.windows(slots, starts), np.empty(len(slots))
            for at in range(0, len(slots), BATCH):
                logs[at : at + BATCH] = net.log_probs(near[at : at + BATCH], slots[at : at + BATCH])
            sums = np.concatenate(([0.0], np.cumsum(logs - spread[slots])))
            total = sums[starts + sizes] - sums[starts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "n_tokens": sizes, "log_prob": total})

    return run


def score(docs: DataFrame, words: list[str], distinct: list[int], flat: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob): the summed conditional log-probabilities (natural)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), plain_text(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((words, distinct, flat))
    out = rows.mapInArrow(_scored(sent), "doc_id long, n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
