"""Substring dedup: words inside a passage that an earlier document holds too are removed.

A window is ``window`` consecutive words of one document; a word goes if a window over it has the
same words as a window of a document with a smaller id. Windows are judged on the input.

Method, level-wise doubling: short windows first, and only those that repeat are extended to
twice their length. Lengths come from halving ``window`` (13: 4, 7, 13). Level one looks at seeds,
the windows of 4 words whose hash is the (leftmost) smallest among all those inside some window
of full length: equal windows have equal seeds at equal places, and two documents that share a
window share its seed. Neighbouring full windows with one seed form its stretch. A seed in one
document alone ends there. If all stretches of a seed are equal, they repeat or not as a whole and
are decided as one. Otherwise the seed grows to 7 words, forwards and backwards, and a full window is
looked at only if its seed and every grown seed inside it still repeat. The levels end when no candidate
survives or the full length is reached, where what repeats is told from first occurrences exactly.

Scale: a level is one read of the texts and one sum by hash with map-side combine (smallest and
largest id); about one word in five is a seed, later levels hold candidates only. The
hashes that repeat go back to the tasks as bitmaps of bounded size, whose mistakes only let
candidates through to the next level. Full windows and stretches (128-bit hashes) are range-partitioned and
sorted by (hash, document, position), so a passage of a third of all documents spreads over many
ranges; one pass over each streams first occurrences, and the others come back as compressed bitmaps for
4,096 positions each. Texts are shuffled once, against these bitmaps. Documents of any length are
read in slices that overlap by a window.

Defined cases: null or empty text has no words; null ids are one document after all others;
rows that repeat an id belong to one document and lose what it loses, each row by its own text;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.bitmaps import bitmap, bitmaps
from answerscope.llm.common import id_key, plain_text, segments, slices, stored

WINDOW, SEED = 13, 4
SLICE = 1 << 18  # words hashed at a time
PLACES = 4096  # positions for each bitmap
VOCABULARY = 1 << 19  # word hashes kept by a task

_BLANK = bytes(32 if c in b" \t\n\v\f\r" else c for c in range(256))
# odd multipliers, two pairs for the two halves of a 128-bit hash
_LEFT, _RIGHT, _ADD = (np.array(x, np.uint64) for x in (
    [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], [0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F], [0x165667B19E3779F9, 0xE7037ED1A0B428DB],
))


def lengths(window: int = WINDOW) -> list[int]:
    """Window lengths by level: the seed's, each at most double the one before, ``window`` last."""
    out = [window]
    while out[0] > SEED:
        out.insert(0, max(SEED, -(-out[0] // 2)))
    return out


def _both(a: np.ndarray, b: np.ndarray, half: int = 0) -> np.ndarray:
    x = a * _LEFT[half] ^ (b + _ADD[half]) * _RIGHT[half]
    x ^= x >> np.uint64(32)
    x *= _LEFT[half]
    return x ^ x >> np.uint64(29)


def window_hashes(words: np.ndarray, length: int, half: int = 0) -> np.ndarray:
    """The hash of the window that starts at each position, by doubling; fewer than the words."""
    now, size = words, 1
    while size < length:
        step = min(size, length - size)  # the halves may overlap
        if len(now) <= step:
            return now[:0]
        now, size = _both(now[:-step], now[step:], half), size + step
    return now


class Words(dict):
    """Word hashes, computed once a word while there is room."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < VOCABULARY:
            self[word] = value
        return value


def word_slices(text: str, known: Words, overlap: int):
    """(position, word hashes) of the text's slices; each overlaps the one before."""
    held, count, base = [], 0, 0
    for part in segments(text.encode().translate(_BLANK)):
        words = part.split()
        held.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        count += len(words)
        if count >= SLICE:
            now = np.concatenate(held)
            yield base, now
            held, base = [now[len(now) - overlap :]], base + len(now) - overlap
            count = overlap
    yield base, np.concatenate(held)


def _chunks(batches, window: int):
    """Word hashes of many rows side by side: (hashes, row numbers, positions, end of each row, batch)."""
    known = Words()
    for batch in slices(batches, "text"):
        held, owners, bases, count = [], [], [], 0
        for row, text in enumerate(batch.column("text").to_pylist()):
            for base, words in word_slices(text, known, window - 1):
                if len(words) < window:
                    continue
                held.append(words)
                owners.append(row)
                bases.append(base)
                count += len(words)
                if count >= SLICE:
                    yield _side_by_side(held, owners, bases, batch)
                    held, owners, bases, count = [], [], [], 0
        if held:
            yield _side_by_side(held, owners, bases, batch)


def _side_by_side(held, owners, bases, batch):
    sizes = np.array([len(x) for x in held])
    ends = np.cumsum(sizes)
    each = lambda x: np.repeat(np.array(x), sizes)
    place = np.arange(ends[-1]) - each(ends - sizes) + each(bases)
    return np.concatenate(held), each(owners), place, each(ends), batch


def _seeds(words, ends, window: int):
    """(start, seed) of all full windows, and the hashes of the seeds' length."""
    size = lengths(window)[0]
    start = np.flatnonzero(np.arange(len(words)) + window <= ends)
    seeds = window_hashes(words, size)
    among = np.lib.stride_tricks.sliding_window_view(seeds, window - size + 1)
    return start, start + among.argmin(axis=1)[start], seeds


def _candidates(words, start, seed, window: int, filters):
    """(start, seed) of the windows whose grown seeds all may repeat."""
    sizes = lengths(window)
    for size, known in zip(sizes[1:], filters):
        grown = known.has(window_hashes(words, size))
        back = np.maximum(seed + sizes[0] - size, 0)
        may = grown[np.minimum(seed, len(grown) - 1)] | (seed - start > window - size)
        may &= grown[np.minimum(back, len(grown) - 1)] | (seed - start < size - sizes[0])
        start, seed = start[may], seed[may]
    return start, seed


def _stretches(start, seed):
    """(first start, last start, seed) of the runs of windows with one seed."""
    head = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1]))) if len(seed) else np.empty(0, int)
    last = np.append(head[1:], len(seed)) - 1 if len(seed) else head
    return start[head], start[last], seed[head]


def _stretch_hash(words, first, last, window: int, half: int) -> np.ndarray:
    whole = window_hashes(words, window, half)
    return _both(_both(whole[first], whole[last], half), (last - first).astype(np.uint64), half)


def _first_level(window: int):
    """The seeds: (h, id, stretch), a row for each stretch."""

    def run(batches):
        for words, row, _, ends, batch in _chunks(batches, window):
            start, seed, hashes = _seeds(words, ends, window)
            first, last, seed = _stretches(start, seed)
            stretch = _both(_stretch_hash(words, first, last, window, 0), (seed - first).astype(np.uint64))
            ids = batch.column("id").to_numpy()[row[seed]]
            yield pa.RecordBatch.from_pydict({"h": hashes[seed].view(np.int64), "id": ids, "stretch": stretch.view(np.int64)})

    return run


def _level(window: int, mixed, filters):
    """The hashes of one level's candidates: (h, id), each once for a row at most a slice."""

    def run(batches):
        sizes, told = lengths(window), [f.value for f in filters]
        size = sizes[len(told) + 1]
        for words, row, _, ends, batch in _chunks(batches, window):
            start, seed, hashes = _seeds(words, ends, window)
            use = mixed.value.has(hashes)[seed]
            start, seed = _candidates(words, start[use], seed[use], window, told)
            offset = seed - start
            at = np.unique(np.concatenate((seed[offset <= window - size], (seed + sizes[0] - size)[offset >= size - sizes[0]])))
            ids = batch.column("id").to_numpy()[row[at]]
            yield pa.RecordBatch.from_pydict({"h": window_hashes(words, size)[at].view(np.int64), "id": ids})

    return run


def _windows(window: int, same, mixed, filters):
    """What may repeat: (h1, h2, id, pos, more, th), a full window and the ``more`` windows after it."""

    def run(batches):
        told = [f.value for f in filters]
        for words, row, place, ends, batch in _chunks(batches, window):
            start, seed, hashes = _seeds(words, ends, window)
            use = mixed.value.has(hashes)[seed] if mixed else np.ones(len(seed), bool)
            single, _ = _candidates(words, start[use], seed[use], window, told)
            first, last, seed = _stretches(start[~use], seed[~use])
            use = same.value.has(hashes)[seed] if same else np.zeros(len(seed), bool)
            first, last = first[use], last[use]
            both = np.concatenate((single, first))
            whole = [np.concatenate((window_hashes(words, window, half)[single], _stretch_hash(words, first, last, window, half))).view(np.int64) for half in (0, 1)]
            more = np.concatenate((np.zeros(len(single), np.int32), (last - first).astype(np.int32)))
            of = row[both]
            yield pa.RecordBatch.from_pydict(
                {
                    "h1": whole[0], "h2": whole[1], "id": batch.column("id").to_numpy()[of], "pos": place[both].astype(np.int32),
                    "more": more, "th": batch.column("th").to_numpy()[of],
                }
            )

    return run


AGAIN, OPEN, HEAD = 0, 1, 2
STREAMED = "kind int, h1 long, h2 long, id long, pos int, more int, th long"


def _firsts(batches):
    """One sorted range: AGAIN rows, whose hash an earlier document of the range holds; OPEN rows, those of the
    first hash, which may have begun before the range; HEAD, the smallest id of the first and the last hash."""
    last, holder, opened = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        h1, h2, ids = cols["h1"], cols["h2"], cols["id"]
        new = np.concatenate(([last != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        head = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: goes on from the batch before
        holders = np.concatenate(([holder], ids[head]))[run]
        if opened is None:
            opened = (h1[0], h2[0])
            yield _head_row(*opened, ids[0])
        open_ = (h1 == opened[0]) & (h2 == opened[1])
        told = open_ | (ids != holders)
        kind = np.where(open_, OPEN, AGAIN).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"kind": kind[told]} | {c: v[told] for c, v in cols.items()})
        last, holder = (h1[-1], h2[-1]), holders[-1]
    if last is not None and last != opened:
        yield _head_row(*last, holder)


def _settled(holders: dict):
    """The rows whose hash an earlier document holds: OPEN ones ask for the smallest id of all ranges."""

    def run(batches):
        for batch in batches:
            kind, h1, h2, ids = (batch.column(c).to_numpy() for c in ("kind", "h1", "h2", "id"))
            told = np.ones(len(ids), bool)
            at = np.flatnonzero(kind == OPEN)
            told[at] = ids[at] > np.array([holders[key] for key in zip(h1[at].tolist(), h2[at].tolist())], np.int64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(told)) for c in ("id", "th", "pos", "more")})

    return run


def _head_row(h1, h2, holder) -> pa.RecordBatch:
    row = {"kind": HEAD, "h1": int(h1), "h2": int(h2), "id": int(holder), "pos": 0, "more": 0, "th": 0}
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k in ("kind", "pos", "more") else pa.int64()) for k, v in row.items()})


def _repeated(batches):
    """One bitmap for each 4,096 positions: (id, th, block, starts)."""
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            bits = np.zeros(PLACES, bool)
            bits[places] = True
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        kept = {c: batch.column(c) for c in ("id", "th", "block")}
        yield pa.RecordBatch.from_pydict(kept | {"starts": pa.array(maps, pa.binary())})


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, places): for every document, the starts of its windows that an earlier document holds.

    ``id`` is the id key, ``th`` the text's hash, ``places`` an array of (block, starts), ``starts`` the
    zlib-compressed bitmap of the block's 4,096 positions.
    """
    rows = docs.select(id_key(doc_id).alias("id"), plain_text(text).alias("text"))
    sc = docs.sparkSession.sparkContext
    same = mixed = None
    filters = []
    if len(lengths(window)) > 1:
        ends = rows.mapInArrow(_first_level(window), "h long, id long, stretch long").groupBy("h").agg(
            F.min("id").alias("a"), F.max("id").alias("b"), F.min("stretch").alias("c"), F.max("stretch").alias("d")
        )
        again = stored(ends.filter("a < b").select("h", (F.col("c") < F.col("d")).cast("int").alias("mixed")), "repeated")
        same, mixed = (sc.broadcast(x) for x in bitmaps(again, F.col("h"), F.col("mixed"), 2))
        for _ in lengths(window)[1:-1]:
            ends = rows.mapInArrow(_level(window, mixed, filters), "h long, id long").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"))
            found = bitmap(stored(ends.filter("a < b").select("h"), "repeated"), F.col("h"))
            filters = [*filters, sc.broadcast(found)]
            if not found.words.any():  # no candidate survives
                break
    hashed = rows.withColumn("th", F.xxhash64("text"))
    windows = stored(hashed.mapInArrow(_windows(window, same, mixed, filters), "h1 long, h2 long, id long, pos int, more int, th long"), "windows")
    order = ["h1", "h2", "id", "pos"]
    told = stored(windows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_firsts, STREAMED), "repeats")
    heads = told.filter(F.col("kind") == HEAD).groupBy("h1", "h2").agg(F.min("id").alias("holder")).collect()  # two for each range at most
    holders = {(r["h1"], r["h2"]): r["holder"] for r in heads}
    found = told.filter(F.col("kind") != HEAD).mapInArrow(_settled(holders), "id long, th long, pos int, more int")
    starts = found.select("id", "th", F.explode(F.sequence("pos", F.col("pos") + F.col("more"))).alias("pos"))
    block, place = F.shiftright("pos", 12).alias("block"), F.col("pos").bitwiseAND(PLACES - 1)
    blocks = starts.groupBy("id", "th", block).agg(F.collect_set(place).alias("places"))
    maps = blocks.mapInArrow(_repeated, "id long, th long, block int, starts binary")
    return maps.groupBy("id", "th").agg(F.collect_list(F.struct("block", "starts")).alias("places"))


def covered(n: int, places, window: int) -> np.ndarray:
    """Which of ``n`` words lie inside a window that starts at one of ``places``."""
    step = np.zeros(n + 1, np.int32)
    for part in places:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(part["starts"]), np.uint8))
        at = part["block"] * PLACES + np.flatnonzero(bits)
        step[at] += 1
        step[at + window] -= 1
    return np.cumsum(step[:n]) > 0


def _kept(window: int):
    def run(batches):
        for batch in slices(batches, "text"):
            texts, total, gone = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                words = text.encode().translate(_BLANK).split()
                left = words
                if places:
                    left = [w for w, c in zip(words, covered(len(words), places, window).tolist()) if not c]
                texts.append(b" ".join(left).decode())
                total.append(len(words))
                gone.append(len(words) - len(left))
            kept = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "places")}
            yield pa.RecordBatch.from_pydict(
                kept | {"kept": pa.array(texts, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            )

    return run


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, kept, n_words, n_removed) for every row; ``key`` is a struct of all columns but the text.

    ``kept`` are the words that stay, joined by one space.
    """
    places = repeated_windows(docs, doc_id, text, window)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole = docs.select(
        F.struct(*rest, F.lit(0).alias("_")).alias("key"), id_key(doc_id).alias("id"), plain_text(text).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    # the bitmaps are the small side of every partition; texts need not be sorted
    joined = whole.join(places.hint("shuffle_hash"), ["id", "th"], "left").select("key", "text", "places")
    schema = joined.select("key").schema.add("kept", "string").add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(_kept(window), schema)
