"""Sets of 64-bit keys as bitmaps of bounded size, which tasks test their own keys against.

A key sets the bit named by its lowest bits, so a foreign key may pass for a member, a member
never for a foreigner. Callers use a set only to leave out rows that cannot matter, and count
exactly what passes: the size of the bitmap (``MOST_BITS``: 32 MB) bounds what is broadcast at
any input, and a crowded bitmap costs rows, not results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 28
ROOM = 16  # bits for each key, while the bound allows


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (uint64) may be members."""
        at = keys & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bitmaps(keys: DataFrame, key: Column, group: Column, groups: int) -> list[Bitmap]:
    """The bitmap of ``key`` for each group (0, 1, ...) of the rows of ``keys``, a stored table: it is read twice.

    At most one row for each 64 bits of the bitmaps comes to the driver.
    """
    rows = keys.select(key.alias("key"), group.cast("int").alias("group"))
    sizes = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = [min(MOST_BITS, max(LEAST_BITS, (ROOM * sizes.get(g, 0)).bit_length())) for g in range(groups)]
    mask = F.element_at(F.array(*[F.lit((1 << b) - 1).cast("long") for b in bits]), F.col("group") + 1)
    slots = rows.select("group", F.col("key").bitwiseAND(mask).alias("at")).groupBy("group", F.shiftright("at", 6).alias("slot"))
    found = slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS INT))")).alias("word")).toArrow()
    of, slot, word = (found[c].to_numpy() for c in ("group", "slot", "word"))
    out = [np.zeros(1 << (b - 6), np.uint64) for b in bits]
    for g, words in enumerate(out):
        words[slot[of == g]] = word[of == g].view(np.uint64)
    return [Bitmap(words) for words in out]


def bitmap(keys: DataFrame, key: Column) -> Bitmap:
    return bitmaps(keys, key, F.lit(0), 1)[0]
