"""Hierarchical multi-length packing of tokenised documents.

A document's ids are those of the given tokenizer plus an end id. Each task tokenises its
rows and packs them in blocks of about ``BLOCK_TOKENS`` ids. In a block, whole 4096-id
stretches of long documents are sequences of their own; what remains is routed to the
smallest context size (512, 1024, 2048, 4096) that holds it. From the longest tier down, each
document opens a window; its gap is filled with the best-fitting documents of shorter tiers
and closed exactly by cutting one. The shortest tier fills its windows from itself. So every
window ends full, at a power of two, and needs no padding; what is left at the end (under
one window) joins the next block, and the last rest of every task is packed with the rests of
``RESTS`` other tasks. Sequences of a tier are dealt into step groups of ``STEP_TOKENS``
tokens with even attention cost.

Memory: one block of ids, and two bounded caches a Python worker (pieces between blanks, and
the tokenizer's own pre-tokens) that make the tokenizer run once for a word, not once for
each use.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; null
ids stay null; an empty table packs nothing.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import plain_text, stored

TIERS = (512, 1024, 2048, 4096)
LONGEST = TIERS[-1]
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
RESTS = 64
END_ID = 2
CACHED_PIECES, CACHED_WORDS = 400_000, 800_000
#: Fixed value: the pre-token pattern that the tokenizer's file names, for its lower-case letters.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The characters that stand for bytes in the tokenizer's vocabulary: printable Latin-1 bytes stand
#: for themselves, the others for the characters from 256 on, in order.
PLAIN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PLAIN_BYTES)}
LATIN_END = "ɐ"  # below it lower case and letter classes do not depend on the context or Unicode's version


class _Words(dict):
    """Normalised pre-token -> its ids as little-endian bytes, from the tokenizer's merge model."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARS))]
        out = np.asarray(ids, dtype="<u4").tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


class Pieces(dict):
    """Piece between blanks -> its ids as little-endian bytes.

    The tokenizer drops white space and never looks across it, so a text's ids are those of
    its pieces, in order. Plain Latin pieces are cut further, into pre-tokens; all others
    go to the tokenizer whole.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.words = _Words(tokenizer)

    def __missing__(self, piece: str) -> bytes:
        if "<|" in piece or not (piece.isascii() or (max(piece) < LATIN_END and unicodedata.is_normalized("NFC", piece))):
            out = np.asarray(self.words.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            out = b"".join(map(self.words.__getitem__, PRE_TOKENS.findall(piece.lower())))
        if len(self) >= CACHED_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_pieces: dict[str, Pieces] = {}  # of this Python worker, by file


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        from tokenizers import Tokenizer

        _pieces[path] = Pieces(Tokenizer.from_file(path))
    return _pieces[path]


def pack(items: list[tuple[int, int, int]]) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Full windows (size, [(document, start, length)]) and the items that fill none.

    ``items``: (document, start, length). The left items have fewer ids together than a window.
    """
    windows = []
    short: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for doc, start, length in items:
        while length >= LONGEST:
            windows.append((LONGEST, [(doc, start, LONGEST)]))
            start, length = start + LONGEST, length - LONGEST
        if length:
            short.append((length, doc, start))
    short.sort()
    left: list[tuple[int, int, int]] = []
    while short:
        length, doc, start = short.pop()
        size = next(t for t in TIERS if length <= t)
        held, gap = [(doc, start, length)], size - length
        while gap and short:
            at = bisect.bisect_right(short, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                length, doc, start = short.pop(at)
                held.append((doc, start, length))
                gap -= length
            else:  # all others are longer: the shortest one gives what is missing
                length, doc, start = short.pop(0)
                held.append((doc, start, gap))
                bisect.insort(short, (length - gap, doc, start + gap))
                gap = 0
        if gap:
            left = held
        else:
            windows.append((size, held))
    return windows, left


def step_groups(windows) -> list[int]:
    """A number for each window: windows of one size share steps of ``STEP_TOKENS`` ids, dealt
    out in turns by falling attention cost so that steps cost about the same."""
    groups, first = [0] * len(windows), 0
    for size in TIERS:
        own = [k for k, (s, _) in enumerate(windows) if s == size]
        n = -(-len(own) * size // STEP_TOKENS)
        own.sort(key=lambda k: (-sum(x[2] ** 2 for x in windows[k][1]), k))
        for turn, k in enumerate(own):
            lap, at = divmod(turn, n)
            groups[k] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return groups


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, part long, ids binary"
)
ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("tier", pa.int32()), ("step_group", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]
)


class _Packer:
    """Packs blocks of (document id, tokens of the document, start of these ids, ids)."""

    def __init__(self, part: int):
        self.part, self.sequences, self.steps = part, 0, 0
        self.docs: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, doc_tokens: int, start: int, ids: bytes) -> None:
        self.docs.append((doc_id, doc_tokens, start, ids))
        self.tokens += len(ids) // 4

    def _rows(self, windows, groups) -> pa.RecordBatch:
        out: list[list] = [[] for _ in ARROW]
        for (size, held), group in zip(windows, groups):
            offset = 0
            for doc, start, length in held:
                doc_id, doc_tokens, first, ids = self.docs[doc]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                row = (doc_id, first + start, length, crc, doc_tokens, (self.part << 32) + self.sequences, offset, size, (self.part << 32) + self.steps + group, self.part, None)
                for column, value in zip(out, row):
                    column.append(value)
                offset += length
            self.sequences += 1
        self.steps += max(groups, default=-1) + 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ARROW)], schema=ARROW)

    def flush(self) -> pa.RecordBatch:
        """The block's full windows; what fills none stays for the next block."""
        windows, left = pack([(k, 0, len(ids) // 4) for k, (_, _, _, ids) in enumerate(self.docs)])
        batch = self._rows(windows, step_groups(windows))
        self.docs = [(*self.docs[d][:2], self.docs[d][2] + s, bytes(memoryview(self.docs[d][3])[4 * s : 4 * (s + n)])) for d, s, n in left]
        self.tokens = sum(n for _, _, n in left)
        return batch

    def last_window(self) -> pa.RecordBatch:
        """The rest as one window, padded to the longest size unless its length is a power of two."""
        total = self.tokens
        size = total if total & (total - 1) == 0 else LONGEST
        return self._rows([(size, [(k, 0, len(d[3]) // 4) for k, d in enumerate(self.docs)])] if total else [], [0] * bool(total))

    def rest(self) -> pa.RecordBatch:
        rows = [(d, s, len(ids) // 4, None, n, None, None, None, None, self.part, ids) for d, n, s, ids in self.docs]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def _packed(path: str, end: bytes):
    def run(batches):
        known = pieces_of(path)
        packer = _Packer(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = known.ids(text) + end
                packer.add(doc_id, len(ids) // 4, 0, ids)
                if packer.tokens >= BLOCK_TOKENS:
                    yield packer.flush()
        yield packer.flush()
        yield packer.rest()

    return run


def _rests(table: pa.Table) -> pa.Table:
    rows = sorted(table.select(["part", "doc_id", "start", "doc_tokens", "ids"]).to_pylist(), key=lambda r: (r["part"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
    packer = _Packer((1 << 30) + rows[0]["part"] // RESTS)
    for r in rows:
        packer.add(r["doc_id"], r["doc_tokens"], r["start"], r["ids"])
    return pa.Table.from_batches([packer.flush(), packer.last_window()])


def packed_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (the window's size) and step_group."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), plain_text(text).alias("text"))
    end = np.asarray([end_id], dtype="<u4").tobytes()
    first = stored(rows.mapInArrow(_packed(path, end), PIECES), "packed")
    rests = first.filter(F.col("ids").isNotNull()).groupBy(F.floor(F.col("part") / RESTS)).applyInArrow(_rests, PIECES)
    return first.filter(F.col("ids").isNull()).unionByName(rests).drop("part", "ids")
