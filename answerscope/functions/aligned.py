"""Word-overlap scores of many text pairs at once, over numbered tokens.

A batch numbers its tokens and tokenises each distinct text once. N-gram overlaps are counts
over sorted (pair, gram) keys, linear in the texts but for the sort. Longest common subsequences
advance side by side among pairs of like lengths: bit-parallel rows of 64-bit words, one step of
all pairs for each token of their longer texts. Few pairs, and those whose shorter text exceeds
``WORDS`` words of bits, run one by one on big integers, which are faster there.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from answerscope.functions.stemming import stem_token

WORDS = 8  # 64-bit words of a row in lockstep
WORTH = 32  # pairs of like lengths, for each word of bits, from which lockstep is faster
WORK = 1 << 20  # tokens of pairs held at a time
PAIRS = 1 << 16  # pairs listed at a time
SLICE = 1 << 22  # bytes of a batch's rows read at a time
_TOKEN = re.compile("[a-z0-9]+")


class Tokens:
    """Token numbers of texts; each distinct text is read once, each distinct word stemmed once.

    For one slice of a batch: it holds all that it has read.
    """

    def __init__(self, stem: bool):
        self.stem, self.numbers, self.known, self.words = stem, {}, {}, {}

    def _number(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            token = stem_token(word) if self.stem else word
            at = self.words[word] = self.numbers.setdefault(token, len(self.numbers))
        return at

    def __call__(self, text: str) -> np.ndarray:
        found = self.known.get(text)
        if found is None:
            words = _TOKEN.findall(text.lower())
            found = self.known[text] = np.fromiter(map(self._number, words), np.int64, len(words))
        return found


def row_slices(*columns: pa.Array):
    """Rows of an Arrow batch, in order, in slices of at most ``SLICE`` bytes or of a single row.

    Spark fills a batch to 10,000 rows or 64 MB, as far as a task's rows go. Python objects, token
    numbers and pairs are made for one slice at a time, so they do not grow with the task.
    """
    n = len(columns[0])
    if n > 1 and sum(c.nbytes for c in columns) > SLICE:
        yield from row_slices(*(c.slice(0, n // 2) for c in columns))
        yield from row_slices(*(c.slice(n // 2) for c in columns))
    elif n:
        yield columns


def _flat(lists: list[np.ndarray]):
    """(values, owner of each value, sizes)."""
    sizes = np.array([len(x) for x in lists], np.int64)
    values = np.concatenate(lists) if lists else np.empty(0, np.int64)
    return values, np.repeat(np.arange(len(lists)), sizes), sizes


def common_grams(a: list[np.ndarray], b: list[np.ndarray], n: int):
    """(common, of a, of b): clipped number of shared n-grams and the numbers of n-grams, by pair."""
    values, owner, _ = _flat([*a, *b])
    grams = values
    if n == 2:
        same = owner[:-1] == owner[1:]
        grams = np.unique((values[:-1] * (int(values.max(initial=0)) + 1) + values[1:])[same], return_inverse=True)[1]
        owner = owner[:-1][same]
    size, pairs = int(grams.max(initial=0)) + 1, len(a)
    left = owner < pairs
    ka, ca = np.unique(owner[left] * size + grams[left], return_counts=True)
    kb, cb = np.unique((owner[~left] - pairs) * size + grams[~left], return_counts=True)
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = np.bincount(both // size, np.minimum(ca[ia], cb[ib]), pairs)
    count = np.bincount(owner, minlength=2 * pairs)
    return common, count[:pairs], count[pairs:]


def _lcs_alone(a: list[int], b: list[int]) -> int:
    places: dict[int, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lockstep(short: list[np.ndarray], long: list[np.ndarray], words: int) -> np.ndarray:
    """Longest common subsequence of every pair; the shorter texts have at most 64 * words tokens."""
    order = np.argsort([-len(x) for x in long], kind="stable")
    short, long = [short[i] for i in order], [long[i] for i in order]
    xs, x_of, x_size = _flat(short)
    ys, y_of, y_size = _flat(long)
    width = int(max(xs.max(initial=0), ys.max(initial=0))) + 1
    place = np.arange(len(xs)) - np.repeat(np.cumsum(x_size) - x_size, x_size)
    keys, at = np.unique(x_of * width + xs, return_inverse=True)
    masks = np.zeros((len(keys) + 1, words), np.uint64)  # the last row: a token that the shorter text lacks
    np.bitwise_or.at(masks, (at, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    wanted = y_of * width + ys
    hit_at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit_at = np.where(keys[hit_at] == wanted, hit_at, len(keys))
    start = np.cumsum(y_size) - y_size
    bits = np.clip(x_size[:, None] - 64 * np.arange(words), 0, 64).astype(np.uint64)
    full = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
    row = full.copy()
    for step in range(int(y_size[0])):
        going = int(np.searchsorted(-y_size, -step, "left"))  # pairs whose longer text goes on
        mask = masks[hit_at[start[:going] + step]]
        carry = np.zeros(going, np.uint64)
        for w in range(words):
            old = row[:going, w]
            hit = old & mask[:, w]
            added = old + hit
            over = added < old
            total = added + carry
            over |= total < added
            row[:going, w] = total | (old & ~hit)
            carry = over.astype(np.uint64)
    out = np.empty(len(order), np.int64)
    out[order] = x_size - np.bitwise_count(row & full).sum(axis=1, dtype=np.int64)
    return out


def lcs_lengths(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        least, most = sorted((len(x), len(y)))
        if least:
            groups.setdefault((-(-least // 64), most.bit_length()), []).append(i)
    for (words, _), members in groups.items():
        pairs = [(a[i], b[i]) if len(a[i]) <= len(b[i]) else (b[i], a[i]) for i in members]
        if words > WORDS or len(pairs) < WORTH * words:
            out[members] = [_lcs_alone(x.tolist(), y.tolist()) for x, y in pairs]
        else:
            out[members] = _lockstep([x for x, _ in pairs], [y for _, y in pairs], words)
    return out


def _f(common, n_a, n_b) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        p, r = common / n_a, common / n_b
        return np.where(common > 0, 2 * p * r / (p + r), 0.0)


def scores(a: list[np.ndarray], b: list[np.ndarray], measure: str) -> np.ndarray:
    """F-measure (rouge1, rouge2, rougeL) of the pairs (a[i], b[i]), in bounded pieces."""
    out, at = np.zeros(len(a)), 0
    sizes = np.cumsum([len(x) + len(y) + 1 for x, y in zip(a, b)]) if a else []
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + WORK, "right")))
        x, y = a[at:upto], b[at:upto]
        if measure == "rougeL":
            count = lambda z: np.array([len(t) for t in z], np.int64)
            out[at:upto] = _f(lcs_lengths(x, y), count(x), count(y))
        else:
            out[at:upto] = _f(*common_grams(x, y, int(measure[-1])))
        at = upto
    return out
