"""Language identification by prediction by partial matching.

Each learned language has a byte context tree of order ``ORDER``: how often each byte follows
each context of three, two, one and no bytes. A byte's probability is its share in the longest
known context, with escapes to the next shorter one (method C: distinct followers over all
followers plus distinct followers), down to one in 256. Statistics are frozen after learning,
so the probability of a byte depends on four bytes only and a text's exact code length is a
sum of table look-ups. The language with the shortest code wins; the score is its posterior
under equal priors.

Learning uses a bounded sample: about ``SAMPLE_DOCS`` whole documents a language, chosen by a
hash of the id, of those that are not held out. Four-byte counts are summed before the
shuffle. Only these counts are sent to the executors; each Python worker builds its tables
once (order-three contexts seen fewer than ``LEAST_SEEN`` times fall back to order two).

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every
text when nothing could be learned; a null id is not held out and not learned from; repeated
rows get equal answers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import plain_text

ORDER = 3
SAMPLE_DOCS = 2000
LEAST_SEEN = 32
CHUNK = 1 << 21
START = b"\n" * ORDER
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _grams(raw: bytes) -> np.ndarray:
    """Every byte with its three predecessors as one number; texts begin after line feeds."""
    b = np.frombuffer(START + raw, "u1").astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def _counted(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for lang in sorted(set(langs)):
            grams = [_grams(t.encode()) for t, own in zip(texts, langs) if own == lang]
            found, times = np.unique(np.concatenate(grams), return_counts=True)
            out[0].append(np.full(len(found), lang, dtype=object))
            out[1].append(found.astype(np.int64))
            out[2].append(times.astype(np.int64))
        if out[0]:
            lang, gram, n = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "gram": gram, "n": n})


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> dict:
    """{"langs": names, "lang": ..., "gram": ..., "n": ...}: four-byte counts by language, as arrays.

    Their number is bounded by the sampled bytes.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("id"), plain_text(text).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, int(min(1.0, sample / n) * (1 << 20))).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit("learn")), F.lit(1 << 20)) < share).select("lang", "text")
    counts = chosen.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    number = {name: k for k, name in enumerate(langs)}
    order = np.array([number[x] for x in table.column("lang").to_pylist()], dtype=np.int32)
    return {"langs": langs, "lang": order, "gram": table.column("gram").to_numpy().astype(np.uint32), "n": table.column("n").to_numpy()}


class Trees:
    """Code lengths in bits of every byte in every context, for all languages side by side."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        gram, n, lang = model["gram"], model["n"], model["lang"]
        seen = np.zeros(256, bool)
        for shift in (0, 8, 16, 24):
            seen[np.unique(gram >> shift & 255)] = True
        seen[10] = True
        self.lut = np.full(256, seen.sum(), np.int64)  # bytes never seen share one symbol
        self.lut[seen] = np.arange(seen.sum())
        size = self.size = int(seen.sum()) + 1
        a, b, c, d = (self.lut[gram >> s & 255] for s in (24, 16, 8, 0))
        three = (a * size + b) * size + c
        times = np.zeros(size**3)
        for k in range(len(self.langs)):  # a context is kept if any language knows it well
            own = lang == k
            times = np.maximum(times, np.bincount(three[own], n[own], size**3))
        deep = np.flatnonzero(times >= LEAST_SEEN)
        self.row = np.tile(np.arange(size**2, dtype=np.int32), size)  # order two unless known
        self.row[deep] = size**2 + np.arange(len(deep), dtype=np.int32)
        bits = np.empty(((size**2 + len(deep)), size, len(self.langs)), np.float32)
        at = np.full(size**3, -1, np.int64)
        at[deep] = np.arange(len(deep))
        for k in range(len(self.langs)):
            own = lang == k
            p = np.full(size, 1 / 256)
            p = self._level(np.bincount(d[own], n[own], size).reshape(1, size), p.reshape(1, size))
            p = self._level(np.bincount(c[own] * size + d[own], n[own], size**2).reshape(size, size), p)
            two = np.bincount((b[own] * size + c[own]) * size + d[own], n[own], size**3).reshape(size**2, size)
            p = self._level(two, np.tile(p, (size, 1)))
            node = at[three[own]]
            known = node >= 0
            last = np.bincount(node[known] * size + d[own][known], n[own][known], len(deep) * size).reshape(len(deep), size)
            bits[: size**2, :, k] = -np.log2(p)
            bits[size**2 :, :, k] = -np.log2(self._level(last, p[deep % size**2]))
        self.bits = bits.reshape(-1, len(self.langs))

    @staticmethod
    def _level(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities with escape: rows are contexts, ``shorter`` has those of the shorter ones."""
        followers = (counts > 0).sum(axis=1, keepdims=True)
        whole = counts.sum(axis=1, keepdims=True) + followers
        whole[whole == 0] = 1
        escape = np.where(followers > 0, followers / whole, 1.0)
        return np.where(counts > 0, counts / whole, escape * shorter)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        total = np.zeros((len(texts), len(self.langs)))
        first = 0
        while first < len(texts):
            last, held = first, 0
            while last < len(texts) and (last == first or held + len(texts[last]) <= CHUNK):
                held += len(texts[last]) + ORDER
                last += 1
            joined = self.lut[np.frombuffer(b"".join(x for t in texts[first:last] for x in (START, t)), "u1")]
            sizes = np.array([len(t) for t in texts[first:last]])
            ends = np.cumsum(sizes + ORDER)
            owner = np.repeat(np.arange(first, last), sizes + ORDER)
            start = ends - sizes - ORDER
            real = np.ones(len(joined), bool)
            for k in range(ORDER):
                real[start + k] = False
            place = np.flatnonzero(real)
            for lo in range(0, len(place), CHUNK):
                i = place[lo : lo + CHUNK]
                context = (joined[i - 3] * self.size + joined[i - 2]) * self.size + joined[i - 1]
                bits = self.bits[self.row[context].astype(np.int64) * self.size + joined[i]]
                own = owner[i]
                cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                total[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.float64)
            first = last
        return total


_trees: dict[int, Trees] = {}  # of this Python worker, by broadcast


def _predicted(model):
    def run(batches):
        if model.value["langs"] and id(model.value) not in _trees:
            _trees.clear()
            _trees[id(model.value)] = Trees(model.value)
        trees = _trees.get(id(model.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [k for k, t in enumerate(texts) if LETTER.search(t)] if trees else []
            if known:
                bits = trees.code_lengths([texts[k].encode() for k in known])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                for k, b, s in zip(known, best, share):
                    names[k], scores[k] = trees.langs[b], float(s)
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def identify(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), plain_text(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sampled bytes
    return rows.mapInArrow(_predicted(sent), "doc_id long, held_out boolean, lang_pred string, score double")
