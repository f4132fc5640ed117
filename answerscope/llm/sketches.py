"""Document fingerprints: threshold-scaled sketches of word shingles.

A shingle (``SHINGLE`` words of the A-Z lower-cased text; fewer words: the whole sequence) is
hashed to 64 bits and kept if its hash lies below a fixed fraction of the range, 2**-``SHIFT``.
Where none lies below it, as in texts of a few words, the smallest stands alone, so that only texts
without a word have an empty sketch. Since the threshold does not depend on the document, sketches
of parts merge by union (a lone hash above the threshold stays only beside none below it), and the share of one sketch found in another estimates containment however unequal the
documents are. The fingerprint is the sorted list of kept hashes in hexadecimal digits.

Everything is built-in column expressions: words are hashed once each and a shingle's hash
combines the hashes of its words, so no shingle text is ever formed.

Defined cases: a text without a word, null or empty ones too, has no shingle and an empty fingerprint;
likeness is 1 for two such texts, 0 if only one is; null ids are one document after all
others; rows that repeat an id share the next document; a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.llm.common import id_back, id_key, plain_text, stored

SHINGLE, SHIFT = 5, 2
BLANK = "[\\x20\\x09-\\x0D]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RADIX = 16  # bits of an id settled by each level of ``successors``
RANGE = 10  # bits of an id inside a range of neighbours
BROADCAST_FIRSTS = 2_000_000  # rows of (id, range): some 50 MB; beyond, a shuffled join


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _below(hashes: Column, shift: int) -> Column:
    """The distinct hashes below the threshold, ascending; the smallest of all where there is none."""
    low = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - shift) == 0)
    flip = F.lit(-(1 << 63)).cast("long")  # unsigned order as signed order
    least = lambda: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(flip))).bitwiseXOR(flip)
    some = lambda kept: F.when((F.size(kept) > 0) | (F.size(hashes) == 0), F.array_sort(F.array_distinct(kept))).otherwise(F.array(least()))
    return _with(low, some)


def sketch(text: Column, shingle: int = SHINGLE, shift: int = SHIFT) -> Column:
    """The kept hashes of a text, distinct and ascending."""
    words = F.filter(F.split(F.translate(text, CAPITALS, SMALL), BLANK), lambda w: w != "")

    def kept(hashes: Column) -> Column:
        at = lambda i, k: F.get(hashes, i + k)
        whole = F.size(hashes) - shingle
        rolled = F.transform(
            F.slice(hashes, F.lit(1), F.greatest(whole + 1, F.least(F.size(hashes), F.lit(1)))),
            lambda _, i: F.xxhash64(*[at(i, k) for k in range(shingle)]),
        )
        return _with(rolled, lambda hashes: _below(hashes, shift))

    return _with(F.transform(words, lambda w: F.xxhash64(w)), kept)


def fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(a: Column, b: Column, shift: int = SHIFT) -> Column:
    """The sketch of two texts' shingles together."""
    return _below(F.array_union(a, b), shift)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty sketch."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from their sketches."""
    shared = F.size(F.array_intersect(a, b))
    together = F.size(a) + F.size(b) - shared
    return F.when(together == 0, 1.0).otherwise(shared / together)


def successors(keys: DataFrame) -> DataFrame:
    """(key, next): the next larger key of each; the largest is followed by the smallest.

    Distinct keys are ordered inside groups that share all but the last ``RADIX`` bits, the first
    keys of the groups inside groups of those, and so on, so no window holds more than
    2**RADIX rows however the keys are spread.
    """
    levels = [stored(keys.select("key").distinct(), "keys")]
    for _ in range(64 // RADIX - 1):
        groups = levels[-1].groupBy(F.shiftright("key", RADIX).alias("group")).agg(F.min("first" if "first" in levels[-1].columns else "key").alias("first"))
        levels.append(groups.withColumnRenamed("group", "key"))
    above = None
    for rows in reversed(levels):
        if "first" not in rows.columns:
            rows = rows.withColumn("first", F.col("key"))
        rows = rows.withColumn("group", F.shiftright("key", RADIX))
        by = Window.partitionBy("group").orderBy("key")
        rows = rows.withColumn("next", F.lead("first").over(by))
        if above is None:  # at most 2**RADIX groups are left at the top
            up = rows.agg(F.min("first").alias("least")).first()["least"]
            top = Window.partitionBy(F.lit(0)).orderBy("key")
            rows = rows.withColumn("next", F.coalesce(F.lead("first").over(top), F.lit(up)))
        else:
            rows = rows.join(above, "group", "left").withColumn("next", F.coalesce("next", "after"))
        above = rows.select(F.col("key").alias("group"), F.col("next").alias("after"))
    return above.select(F.col("group").alias("key"), F.col("after").alias("next"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, own, next_text, next_own): each text and its sketch beside those of the next document.

    Texts move once, to ranges of 2**``RANGE`` ids; the first document of a range also goes to the
    range before it. Rows that repeat an id share the next document, of whose rows the smallest
    text serves.
    """
    rows = docs.select(id_key(doc_id).alias("id"), plain_text(text).alias("text"), F.lit(0).alias("ahead"))
    rows = rows.withColumn("range", F.shiftright("id", RANGE))
    follow = successors(rows.select(F.col("id").alias("key")))
    firsts = stored(
        follow.select(F.col("next").alias("id"), F.shiftright("key", RANGE).alias("before"), (F.col("next") <= F.col("key")).alias("wraps"))
        .filter("wraps OR before <> shiftright(id, %d)" % RANGE),
        "firsts",
    )
    if firsts.count() <= BROADCAST_FIRSTS:
        firsts = F.broadcast(firsts)
    copies = rows.join(firsts, "id").select("id", "text", F.lit(1).alias("ahead"), F.col("before").alias("range"))
    dealt = rows.unionByName(copies).repartition("range").withColumn("own", sketch(F.col("text")))
    back = Window.partitionBy("range").orderBy(F.desc("ahead"), F.desc("id"), F.desc("text"))
    other = (F.lag("id").over(back) != F.col("id")) | (F.lag("ahead").over(back) != F.col("ahead"))
    passed = dealt.withColumn("passed", F.when(other, F.lag(F.struct("text", "own")).over(back)))
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = passed.withColumn("after", F.last("passed", ignorenulls=True).over(upto)).filter("ahead = 0")
    return found.select("id", "text", "own", F.col("after.text").alias("next_text"), F.col("after.own").alias("next_own"))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_of_edited).

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    both = with_next(docs, doc_id, text).withColumn("edited", edited)
    done = both.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.struct("own", sketch(F.col("edited")).alias("new"), F.col("next_own").alias("following")).alias("s"),
    )
    told = _with(
        F.col("s"),
        lambda s: F.struct(
            fingerprint(s["own"]).alias("fingerprint"), fingerprint(s["new"]).alias("edited_fingerprint"),
            likeness(s["own"], s["new"]).alias("near_edited"), likeness(s["own"], s["following"]).alias("near_next"),
            containment(s["own"], s["new"]).alias("kept_of_edited"),
        ),
    )
    return done.select(id_back().alias("doc_id"), "n_chars", "edited_sha256", F.inline(F.array(told)))
