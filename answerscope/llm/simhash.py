"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: words of the A-Z lower-cased text, shingles of ``shingle`` words with repeats
(fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed 42 of each, a bit
set if it is set in over half of the hashes.

Self-join: the distinct fingerprints are the leaves of a binary trie. Pairs of nodes are
traversed together from the root, breadth first: a pair's two children on each side give up to
four pairs, differing bits accumulate, and a pair is dropped as soon as they exceed the error
budget. A sorted array is the trie (a node is a range of it), and a whole frontier of node
pairs moves in a few numpy steps.

Distribution: two fingerprints within d bits agree on one of d + 1 equal stretches of bits, so
each stretch value has a trie of its own, which tasks join independently; a trie of over
``TRIE_LIMIT`` leaves is dealt again on stretches of its other bits, which lose no pair
for the same reason. A trie reports its links as a spanning forest of chains, not pairs, and
``components`` joins the forests. Copies are merged by fingerprint before all that.

Defined cases: null or empty text has fingerprint zero and links like any other; null ids are
one document after all others (null again in the result, also as component when alone);
repeated rows appear as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import id_back, id_key, plain_text, slices, stored
from answerscope.llm.components import components

BITS, SEED = 64, 42
SHINGLE, DISTANCE = 3, 3
TRIE_LIMIT = 50_000
FRONTIER = 1 << 20  # node pairs held at a time
LEAVES = 1 << 19  # leaves joined at a time; a trie is never cut


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: A-Z only, and [\\x20\\x09-\\x0D]+ between words
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())])
    total = np.zeros(BITS, np.int64)
    rows = np.frombuffer(hashes, "u1").reshape(n, 8)  # big-endian digests: bit 0 is the highest
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(shingle: int):
    def run(batches):
        for batch in slices(batches, "text"):
            prints = [_signed(fingerprint(t, shingle)) for t in batch.column("text").to_pylist()]
            kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(kept | {"fp": pa.array(prints, pa.int64())})

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row, ``id`` being the id key and ``fp`` the fingerprint's 64 bits as a long."""
    rows = docs.select(id_key(doc_id).alias("id"), plain_text(text).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Union-find over the leaves of the tries of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Vectorised: every end hangs on the smaller root until all links are inside."""
        while len(a):
            ra, rb = self._roots(a), self._roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))

    def _roots(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if np.array_equal(up, r):
                self.root[x] = r
                return r
            r = up


def join_tries(values: np.ndarray, tries: np.ndarray, distance: int, seen: dict | None = None) -> np.ndarray:
    """For each leaf the smallest leaf number it is linked with, through others too.

    ``values``: uint64, ascending within each trie; ``tries``: the trie's number, ascending. Only
    pairs of single leaves are compared as such. ``seen`` counts node pairs split and pruned, and leaf pairs.
    """
    seen = {} if seen is None else seen
    count = lambda name, n: seen.__setitem__(name, seen.get(name, 0) + int(n))
    n = len(values)
    forest = _Forest(n)
    lo = np.flatnonzero(np.concatenate(([True], tries[1:] != tries[:-1]))) if n else np.empty(0, int)
    hi = np.append(lo[1:], n) if n else lo
    zero = np.zeros(len(lo), np.int64)
    stack = [(lo, hi, lo, hi, zero, zero)]  # ranges of both nodes, their depth, differing bits so far
    while stack:
        a0, a1, b0, b1, depth, bits = stack.pop()
        if len(a0) > FRONTIER:  # depth first in slices keeps the frontier bounded
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, depth, bits)), tuple(x[half:] for x in (a0, a1, b0, b1, depth, bits))]
            continue
        few = ((a1 - a0) * (b1 - b0) == 1) | (depth >= BITS)
        count("leaf pairs", few.sum())
        count("split", (~few).sum())
        if few.any():
            _compare(values, forest, a0[few], a1[few], b0[few], b1[few], distance)
        a0, a1, b0, b1, depth, bits = (x[~few] for x in (a0, a1, b0, b1, depth, bits))
        if not len(a0):
            continue
        am, bm = _split(values, a0, a1, depth), _split(values, b0, b1, depth)
        same = (a0 == b0) & (a1 == b1)
        parts = []
        for left0, left1, right0, right1, cost, mirrored in (
            (a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False), (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, True),
        ):
            ok = (left0 < left1) & (right0 < right1)
            if mirrored:  # a node with itself: its children meet once
                ok &= ~same
            near = bits + cost <= distance
            count("pruned", (ok & ~near).sum())
            ok &= near
            parts.append(tuple(x[ok] for x in (left0, left1, right0, right1, depth + 1, bits + cost)))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts)))
    return forest._roots(np.arange(n))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where in each range the bit at ``depth`` turns from 0 to 1, by binary search."""
    shift = (BITS - 1 - depth).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy()
    while True:
        going = lo < hi
        if not going.any():
            return lo
        mid = (lo + hi) >> 1
        one = (values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(going & one, mid, hi)
        lo = np.where(going & ~one, mid + 1, lo)


def _compare(values, forest, a0, a1, b0, b1, distance: int) -> None:
    """Links among the leaves of small node pairs, all pairs of one node pair side by side."""
    sizes = (a1 - a0) * (b1 - b0)
    at = 0
    while at < len(sizes):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), FRONTIER * 4, "right")))
        n = sizes[at:upto]
        pair = np.repeat(np.arange(at, upto), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = (b1 - b0)[pair]
        left, right = a0[pair] + k // wide, b0[pair] + k % wide
        near = (left != right) & (_popcount(values[left] ^ values[right]) <= distance)
        forest.join(left[near], right[near])
        at = upto


def _links(distance: int):
    def joined(tries, values):
        order = np.lexsort((values, tries))
        tries, values = tries[order], values[order]
        roots = join_tries(values, tries, distance)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.RecordBatch.from_pydict({"a": values[roots[linked]].view(np.int64), "b": values[linked].view(np.int64)})

    def run(batches):
        """The tries of a task's partition, which come one after the other, some ``LEAVES`` leaves at a time."""
        held, count = [], 0
        for batch in batches:
            held.append((batch.column("trie").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            count += batch.num_rows
            if count >= LEAVES:
                tries, values = (np.concatenate(x) for x in zip(*held))
                whole = np.searchsorted(tries, tries[-1])  # the last one may go on
                if whole:
                    yield joined(tries[:whole], values[:whole])
                held, count = [(tries[whole:], values[whole:])], len(tries) - int(whole)
        if held:
            yield joined(*(np.concatenate(x) for x in zip(*held)))

    return run


def _stretches(free: list[int], distance: int) -> list[list[int]]:
    """The free bit positions in ``distance`` + 1 stretches of about equal length."""
    return [list(map(int, x)) for x in np.array_split(np.array(free), distance + 1)]


def _taken(bits: list[int], name: str = "fp"):
    """The given bits of a column as a masked long; equal masks, equal stretch."""
    mask = 0
    for b in bits:
        mask |= 1 << (BITS - 1 - b)
    return F.col(name).bitwiseAND(F.lit(_signed(mask)).cast("long"))


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE, limit: int = TRIE_LIMIT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``distance`` bits."""
    out = None
    waiting = [(prints.select("fp"), list(range(BITS)), ())]
    while waiting:
        rows, free, path = waiting.pop()
        for k, bits in enumerate(_stretches(free, distance)):
            at = (*path, k)
            # one trie for each value of the stretches taken so far
            taken = [b for b in range(BITS) if b not in free or b in bits]
            dealt = rows.withColumn("trie", F.xxhash64(F.lit(",".join(map(str, at))), _taken(taken)))
            rest = [b for b in free if b not in bits]
            if len(rest) > distance:
                large = stored(dealt.groupBy("trie").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit), "large")
                if not large.isEmpty():
                    waiting.append((stored(dealt.join(large, "trie", "left_semi").select("fp"), "dealt"), rest, at))
                    dealt = dealt.join(large, "trie", "left_anti")
            out = dealt if out is None else out.unionByName(dealt)
    return out.repartition("trie").sortWithinPartitions("trie").mapInArrow(_links(distance), "a long, b long")


def _named(first: DataFrame, distance: int, limit: int) -> DataFrame:
    """The distinct fingerprints with ``component``, the smallest fingerprint each reaches."""
    parts = components(fingerprint_links(first, distance, limit)).withColumnRenamed("node", "fp")
    return first.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, limit: int = TRIE_LIMIT
) -> DataFrame:
    """(id, fp, component) of every row: its fingerprint and the smallest id it reaches."""
    rows = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    first = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    named = _named(first, distance, limit)
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    found = named.join(least, "component").select("fp", F.col("least").alias("component"))
    return rows.join(found, "fp").select("id", "fp", "component")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, limit: int = TRIE_LIMIT
) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, all columns as they were.

    Ids name no row: null ids and repeated ones hold different texts. Of equal ids in a group the
    row with the smallest hash of its text, then of all its columns (maps aside), stays; rows
    alike in all of them are one.
    """
    other = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    key = [id_key(doc_id).alias("id"), F.xxhash64(plain_text(text)).alias("mark"), F.xxhash64(*other).alias("rest")]
    prints = docs.select(*key, plain_text(text).alias("text")).mapInArrow(_fingerprints(shingle), "id long, mark long, rest long, fp long")
    counted = prints.groupBy("fp", "id", "mark", "rest").agg(F.count(F.lit(1)).alias("times"))
    first = stored(counted.groupBy("fp").agg(F.min(F.struct("id", "mark", "rest", "times")).alias("first")), "distinct")
    best = stored(_named(first, distance, limit).groupBy("component").agg(F.min("first").alias("first")).select("first.*"), "best")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    names = ["id", "mark", "rest"]
    chosen = lambda some: rows.join(best.filter(some).select(*names).hint("shuffle_hash"), names)
    # only rows that come several times are sorted to leave one
    return chosen("times = 1").select("row.*").unionByName(chosen("times > 1").dropDuplicates(names).select("row.*"))
