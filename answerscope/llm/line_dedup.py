"""Line dedup: the first document holding a line keeps it, all others lose it.

Method: every line of at least ``min_chars`` code points becomes a 128-bit hash of its key
(stripped, A-Z lower-cased). The hashes are range-partitioned and sorted by (hash, document,
position); one pass over each sorted range streams the first occurrence of every hash and
reports the other documents' lines. Because document and position are part of the range key,
a line shared by a third of all documents spreads over many ranges; a hash that crosses
ranges is settled by two rows per range (the first holders of its first and last hash).
Results travel as one zlib-compressed keep bitmap per document, never as text.

Defined cases: null or empty text is one empty line; null ids are one document after all
others; rows that repeat an id belong to one document and keep what it keeps, each row by
its own text; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import id_key, plain_text, slices, stored, texts_in

BLANK = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() changes A-Z only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _hashed(least: int):
    def run(batches):
        for batch in slices(batches, "text"):
            ids, texts, hashes = batch.column("id").to_numpy(), batch.column("th").to_numpy(), []
            rows, places = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for place, line in enumerate(text.encode().split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, least):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        places.append(place)
            both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "h1": both[:, 0].copy(),
                    "h2": both[:, 1].copy(),
                    "id": ids[rows] if rows else np.empty(0, "i8"),
                    "pos": np.array(places, dtype="i4"),
                    "th": texts[rows] if rows else np.empty(0, "i8"),
                }
            )

    return run


DROPPED, OPEN, HEAD = 0, 1, 2


def _stream(batches):
    """Rows of one sorted range: DROPPED lines; OPEN lines, those of the range's first hash, which
    may have begun in an earlier range; HEAD rows, the first holders of the first and last hash."""
    run, holder, first = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, pos, th = (batch.column(c).to_numpy() for c in ("h1", "h2", "id", "pos", "th"))
        fresh = np.empty(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh[0] = run != (h1[0], h2[0])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), -1))
        holders = np.where(start >= 0, ids[np.maximum(start, 0)], holder)
        kind = np.where(ids != holders, DROPPED, -1)
        if run is None:
            yield _head(h1[0], h2[0], ids[0])
        if first:
            opened = np.flatnonzero(fresh)[1 if run is None else 0 :]
            end = opened[0] if len(opened) else len(h1)
            kind[:end] = OPEN
            first = not len(opened)
        run, holder = (h1[-1], h2[-1]), holders[-1]
        told = kind >= 0
        yield pa.RecordBatch.from_pydict(
            {"kind": kind[told].astype("i4"), "h1": h1[told], "h2": h2[told], "id": ids[told], "pos": pos[told], "th": th[told]}
        )
    if run is not None:
        yield _head(*run, holder)


def _head(h1, h2, holder) -> pa.RecordBatch:
    row = {"kind": HEAD, "h1": int(h1), "h2": int(h2), "id": int(holder), "pos": 0, "th": 0}
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k in ("kind", "pos") else pa.int64()) for k, v in row.items()})


def _bitmaps(batches):
    for batch in batches:
        maps = []
        for places in batch.column("dropped").to_pylist():
            keep = np.ones(max(places) // 8 * 8 + 8, bool)  # whole bytes
            keep[places] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_pydict(
            {"id": batch.column("id"), "th": batch.column("th"), "keep": pa.array(maps, pa.binary())}
        )


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, th, keep): for every document that loses a line, its compressed bitmap.

    ``id`` is the id key, ``th`` the hash of the row's text. Bit i says whether line i stays;
    lines past the bitmap's end stay.
    """
    rows = docs.select(id_key(doc_id).alias("id"), plain_text(text).alias("text")).withColumn("th", F.xxhash64("text"))
    lines = stored(rows.mapInArrow(_hashed(min_chars), "h1 long, h2 long, id long, pos int, th long"), "lines")
    order = ["h1", "h2", "id", "pos"]
    told = stored(
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_stream, "kind int, h1 long, h2 long, id long, pos int, th long"),
        "repeats",
    )
    # two rows for each range at most
    heads = told.filter(F.col("kind") == HEAD).groupBy("h1", "h2").agg(F.min("id").alias("holder"))
    late = told.filter(F.col("kind") == OPEN).join(F.broadcast(heads), ["h1", "h2"]).filter("id > holder")
    dropped = told.filter(F.col("kind") == DROPPED).select("id", "th", "pos").union(late.select("id", "th", "pos"))
    places = dropped.groupBy("id", "th").agg(F.collect_set("pos").alias("dropped"))
    return places.mapInArrow(_bitmaps, "id long, th long, keep binary")


def _kept(inside: int):
    def run(batches):
        for batch in slices(batches):
            texts, lines, lost = [], [], []
            for text, bitmap in zip(texts_in(batch, inside), batch.column("keep").to_pylist()):
                parts = text.split("\n")
                left = parts
                if bitmap is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1")).tolist()
                    left = [p for p, b in zip(parts, bits) if b] + parts[len(bits) :]
                texts.append("\n".join(left))
                lines.append(len(parts))
                lost.append(len(parts) - len(left))
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column("row"), "kept": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(lost, pa.int64())}
            )

    return run


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(row, kept, n_lines, n_dropped) for every input row; ``row`` is a struct of its columns."""
    maps = keep_bitmaps(docs, doc_id, text, min_chars)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key(doc_id).alias("id"), F.xxhash64(plain_text(text)).alias("th")
    )
    # bitmaps are the small side of every partition: rows with their texts, held once, need no sort
    joined = whole.join(maps.hint("shuffle_hash"), ["id", "th"], "left").select("row", "keep")
    schema = joined.select("row").schema.add("kept", "string").add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_kept(docs.columns.index(text)), schema)
